from collections import Counter, defaultdict
from itertools import combinations

import pytest
from llm_cases import clashing, docs, odd_rows
from pyspark.sql import functions as F

from selenogrid.llm import mixing, packing
from selenogrid.llm.base import word_count

LEVELS = ("lang", "source")


def shared(given, rooms, weights):
    """Filling by weight, a full child at a time."""
    got, open_ = {c: 0.0 for c in rooms}, {c for c in rooms if weights[c] > 0}
    while open_ and given > 1e-9:
        rate = given / sum(weights[c] for c in open_)
        full = {c for c in open_ if rooms[c] <= rate * weights[c]}
        if not full:
            return got | {c: rate * weights[c] for c in open_}
        for c in full:
            got[c] = rooms[c]
            given -= rooms[c]
        open_ -= full
    return got


@pytest.mark.parametrize("share,epochs", [(0.3, 1), (0.9, 3), (2.5, 2), (1.0, 1)])
def test_budgets_fill_siblings_first(spark, share, epochs):
    leaves = [("en", "a", 5, 1000), ("en", "b", 5, 10), (None, "a", 5, 300), (None, None, 5, 0), ("de", "c", 2, 50), ("fr", "z", 1, 7)]
    weights = {"lang": {"en": 1.0, "de": 3.0, "fr": 0.0}}
    df = spark.createDataFrame(leaves, "lang string, source string, n_docs long, tokens long")
    got = {(r.lang, r.source): r.budget for r in mixing.budgets(df, LEVELS, weights, share, epochs).collect()}
    rooms = defaultdict(float)
    for lang, _, _, t in leaves:
        rooms[lang] += t * epochs
    top = shared(share * sum(x[3] for x in leaves), rooms, {c: weights["lang"].get(c, 1.0) for c in rooms})
    for lang in rooms:
        own = {s: t * epochs for la, s, _, t in leaves if la == lang}
        for s, b in shared(top[lang], own, dict.fromkeys(own, 1.0)).items():
            assert abs(got[lang, s] - b) <= 1


def test_mixture_takes_prefixes_of_seeded_epochs(spark):
    rows = odd_rows()
    df = clashing(docs(spark, rows))
    plan = mixing.plan(df, LEVELS, {}, 1.3, 3, 42)
    leaves = {(r.lang, r.source): r for r in plan.collect()}
    out = mixing.mix(df, plan, LEVELS, 42)
    assert out.columns == [c for c in df.columns] + ["epoch"] or "epoch" in df.columns
    got = out.drop("epoch").withColumn("words", word_count("text")).collect()
    used = Counter()
    for r in got:
        used[r.lang, r.source] += r.words
    for key, leaf in leaves.items():
        assert used[key] <= leaf.budget or leaf.budget == 0
        assert used[key] >= leaf.whole * leaf.tokens
    times = Counter((r.doc_id, r.text, r.lang, r.source) for r in got)
    assert max(times.values()) <= 6  # two rows are equal, three epochs
    again = mixing.mix(df.repartition(3), mixing.plan(df, LEVELS, {}, 1.3, 3, 42), LEVELS, 42).drop("epoch")
    assert Counter((r.doc_id, r.text, r.lang, r.source) for r in again.collect()) == times
    empty = docs(spark, [])
    assert mixing.mix(empty, mixing.plan(empty, LEVELS, {}, 1.0, 1, 42), LEVELS, 42).count() == 0


def padding(lengths, counts, chosen):
    return sum(n * (next(w for w in chosen if w >= x) - x) for x, n in zip(lengths, counts))


@pytest.mark.parametrize("buckets", [1, 2, 3, 4, 20])
def test_widths_are_the_best(buckets):
    lengths, counts = [1, 2, 5, 9, 10, 40, 41, 90], [5, 1, 7, 2, 2, 9, 1, 3]
    got = packing.widths(lengths, counts, buckets)
    best = min(padding(lengths, counts, [*c, 90]) for k in range(min(buckets, 8)) for c in combinations(lengths[:-1], k))
    assert len(got) <= buckets and got == sorted(got) and got[-1] == 90 and padding(lengths, counts, got) == best
    assert packing.widths([], [], buckets) == []


def test_batches_hold_every_piece_once(spark):
    rows = odd_rows()
    got = packing.pack(clashing(docs(spark, rows)), word_count("text"), longest=64, buckets=3, batch_tokens=256).collect()
    n = {i: len((r[1] or "").replace("\xa0", "x").replace("\x1c", "x").split()) for i, r in enumerate(rows)}
    assert sum(r.n_tokens for r in got) == sum(n.values())
    assert all((r.batch is None) == (r.n_tokens == 0) and r.n_tokens <= (r.width or 0) for r in got)
    places = Counter((r.width, r.batch, r.slot) for r in got if r.batch is not None)
    assert max(places.values()) == 1 and len({r.width for r in got if r.width}) <= 3
    for width in {r.width for r in got if r.width}:
        mine = sorted((r.batch, r.slot) for r in got if r.width == width)
        per = max(1, 256 // width)
        assert mine == [(i // per, i % per) for i in range(len(mine))]
    spans = defaultdict(list)
    for r in got:
        spans[r.doc_id].append((r.start, r.n_tokens))
    assert sorted(spans[7]) == [(s, min(64, 30_000 - s)) for s in range(0, 30_000, 64)]
    assert packing.pack(docs(spark, []), word_count("text")).count() == 0
    nothing = packing.pack(docs(spark, rows[:3]), F.lit(None)).collect()
    assert len(nothing) == 3 and all(r.batch is None for r in nothing)
