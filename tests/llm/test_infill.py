import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import clashing, docs, odd_rows, rows_of
from pyspark.sql import functions as F

from selenogrid.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, rate=50, spm=80):
    text, h = text or "", hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    t = TOKEN.findall(text)
    n = len(t)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return (doc_id, n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")


def texts(seed, n=150):
    r = random.Random(seed)
    make = lambda k: "".join(r.choice(["a", "é", " ", "\n", "日", "bcd", "  ", "\x1c", "😀", "word ", "<", "<S", ">", "<P"]) for _ in range(k))
    shared = make(3000)
    return ["", " ", "a", " a", "a ", "\n\n", *[make(r.randrange(60)) for _ in range(n)], make(90) + shared + make(50), shared, shared, "x" * 30_000, "x " * 20_000, " " * 20_000, ""]


@pytest.mark.parametrize("kept", [infill.KEPT, 100])
def test_cuts_are_where_the_tokens_end(kept):
    memo, r = infill.Memo(kept), random.Random(2)
    given = texts(1)
    for at in range(0, len(given), 40):
        block = [t.encode() for t in given[at : at + 40]]
        offsets = np.append(0, np.cumsum([len(b) for b in block]))
        cutter = infill.Cutter(np.frombuffer(b"".join(block), np.uint8), offsets, memo)
        for i, t in enumerate(given[at : at + 40]):
            tokens = TOKEN.findall(t)
            assert cutter.n[i] == len(tokens)
            for k in {0, len(tokens), *[r.randrange(len(tokens) + 1) for _ in range(6)]}:
                before = "".join(tokens[:k])
                assert cutter.cut(i, k) == (offsets[i] + len(before.encode()), len(before))


def test_chunks_follow_the_content_and_are_bounded():
    r = random.Random(4)
    shared = bytes(r.randrange(256) for _ in range(20_000))
    a, b = (bytes(r.randrange(256) for _ in range(n)) + shared for n in (700, 1301))
    cut = lambda raw, **how: np.split(np.frombuffer(raw, np.uint8), infill.chunk_ends(np.frombuffer(raw, np.uint8), np.array([len(raw)]), **how)[:-1])
    one, two = ([bytes(c) for c in cut(x)] for x in (a, b))
    assert b"".join(one) == a and len(set(one) & set(two)) > 0.8 * len(one)
    assert [bytes(c) for c in cut(a, block=777)] == one
    same = cut(b"\x00" * 100_000)
    assert max(map(len, same)) <= infill.MOST and sum(map(len, same)) == 100_000
    # a text is cut the same whatever stands before it
    both = np.frombuffer(a + b, np.uint8)
    ends = infill.chunk_ends(both, np.array([len(a), len(a) + len(b)]))
    assert [bytes(c) for c in np.split(both, ends[:-1])] == one + two


def test_transform_of_a_table(spark):
    rows = odd_rows() + [(500 + i, t, "en", "src0", 1) for i, t in enumerate(texts(7))] + [(900, "a <P> b " * 50, "en", "src0", 1)]
    got = rows_of(infill.transform(clashing(docs(spark, rows))), "doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    want = [brute(r[0], r[1]) for r in rows]
    assert Counter(got) == Counter(want)
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    made = infill.transform(docs(spark, rows), rate=100, spm=40)
    assert Counter(rows_of(made, "doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) == Counter(brute(r[0], r[1], 100, 40) for r in rows)
    back = made.select("doc_id", infill.restore("output", "form").alias("text"))
    assert Counter(rows_of(back, "doc_id", "text")) == Counter((r[0], r[1] or "") for r in rows)
    assert infill.transform(docs(spark, [])).count() == 0
    assert infill.transform(docs(spark, rows).withColumn("doc_id", F.col("doc_id").cast("string"))).schema["doc_id"].dataType.simpleString() == "string"
