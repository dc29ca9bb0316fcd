import random
import re
from collections import Counter, defaultdict

import pytest
from llm_cases import clashing, docs, odd_rows, rows_of

from selenogrid.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, top):
    """Every kept term of every group, and every pair of sources over all of them."""
    counts, have, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        sources[lang].add(source)
        counts[lang, source].update(terms)
        have[lang].update(set(terms))
    out = []
    for lang, names in sources.items():
        kept = {t for t, d in have[lang].items() if d >= least}
        of = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        p = {s: of(counts[lang, s]) for s in names}
        q = of(sum((counts[lang, s] for s in names), Counter()))
        for s in names:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in names if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(items)]
    return out


def rows():
    r = random.Random(8)
    vocab = ["The", "the", "Straße", "É", "é", "日本", "x1y", "don't", "\x00z", "aé", "Zz"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    out = odd_rows()
    for i in range(300):
        bias = r.randrange(len(vocab))
        text = " ".join(vocab[min(len(vocab) - 1, int(r.expovariate(0.05) + bias) % len(vocab))] for _ in range(r.randrange(30)))
        out.append((1000 + i, text, r.choice(["en", "de", "", None]), r.choice(["hot", "hot", "a", "b", "ä", None]), 1))
    out += [(5000 + i, "the same passage of everyone Zz zz", "en", f"s{i % 12}", 1) for i in range(200)]
    out += [(6000, None, "en", "nothing", 1), (6001, "12 34", "xx", "only", 1), (6002, "alone", "xx", "other", 1)]
    return out


@pytest.mark.parametrize(("least", "top", "together", "held"), [(30, 50, 1000, 300_000), (3, 4, 2, 20)])
def test_audit_is_the_definition(spark, monkeypatch, least, top, together, held):
    monkeypatch.setattr(divergence, "TOGETHER", together)
    monkeypatch.setattr(divergence, "HELD", held)
    got = rows_of(divergence.audit(clashing(docs(spark, rows()).repartition(3)), least, top), "lang", "source", "part", "item", "value", "rank")
    assert Counter(got) == Counter(brute(rows(), least, top))


def test_copies_are_one_row_with_their_sources(spark):
    got = divergence.collapse(docs(spark, rows())).filter("text like 'the same passage%'").collect()
    assert len(got) == 1 and sum(s["n"] for s in got[0].sources) == 200 and len(got[0].sources) == 12


def test_probabilities_are_exact_beyond_64_bits(spark):
    n, total, terms = 3 * 10**12 + 7, 10**14 + 3, 10**6
    df = spark.createDataFrame([(n, total, terms)], "n long, total long, terms long")
    from pyspark.sql import functions as F

    assert df.select(divergence.probability(F.col("n"), F.col("total"), F.col("terms"))).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def test_empty_table(spark):
    assert divergence.audit(docs(spark, [])).count() == 0
