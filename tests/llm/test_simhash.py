import random
from collections import Counter

import pytest
import xxhash
from llm_cases import clashing, docs, odd_rows, rows_of, words

from selenogrid.llm import simhash
from selenogrid.llm.base import components


def brute(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps):
    """Smallest position reachable, by comparing all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprint_is_the_contract():
    for text in [None, "", " ", "One", "one two", "A B c", words(500, 3), "É É é x\x0by\x1cz", "a a a a a a"]:
        assert simhash.fingerprint(text, block=7) % 2**64 == brute(text)


def test_components_match_all_pairs(spark):
    rows = odd_rows()
    base = words(300, 99).split()
    for i in range(60):  # near copies of one text
        w = list(base)
        for k in range(i % 4):
            w[(17 * i + k) % 300] = f"new{i}"
        rows.append((1000 + i, " ".join(w), "en", "src0", 1))
    random.Random(5).shuffle(rows)
    df = docs(spark, rows)
    got = rows_of(simhash.near_duplicates(clashing(df)), "doc_id", "fp", "component_id")
    fps = [brute(r[1]) for r in rows]
    root = groups(fps)
    least = {}
    for r, g in zip(rows, root):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = [(r[0], f - 2**64 if f >> 63 else f, least.get(g)) for r, f, g in zip(rows, fps, root)]
    assert Counter(got) == Counter(want)
    kept = simhash.keep_one(clashing(df))
    assert kept.columns == clashing(df).columns
    assert kept.count() == len(set(root))
    assert {r.doc_id for r in kept.collect()} == set(least.values()) | ({None} if any(g not in least for g in root) else set())


@pytest.mark.parametrize("short", [8, 64])
def test_links_are_whole_when_entries_are_split(spark, monkeypatch, short):
    monkeypatch.setattr(simhash, "SHORT", short)
    r = random.Random(1)
    fps = {0, 2**64 - 1}
    for _ in range(25):
        centre = r.getrandbits(64)
        for _ in range(25):
            x = centre
            for _ in range(r.randrange(5)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    crowd = r.getrandbits(64)
    fps |= {crowd ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)}  # many that share most bytes
    fps = sorted(fps)
    sign = lambda x: x - 2**64 if x >> 63 else x
    got = rows_of(simhash.links(spark.createDataFrame([(sign(f),) for f in fps], "fp long")), "a", "b")
    want = {tuple(sorted((sign(a), sign(b)))) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def test_position_sets_cover_every_five_positions():
    from itertools import combinations

    assert len(simhash.POSITIONS) == 14
    assert all(any(set(p) <= set(five) for p in simhash.POSITIONS) for five in combinations(range(8), 5))


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (500, 400)]
    got = dict(rows_of(components(spark.createDataFrame(links, "a long, b long")), "node", "label"))
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 400: 400, 500: 400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0 and simhash.keep_one(docs(spark, [])).count() == 0
