import random
import zlib
from collections import Counter

import public_tokenizers
from llm_cases import clashing, docs, odd_rows, rows_of
from tokenizers import Tokenizer

from selenogrid.llm import shards, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_counts_are_the_librarys():
    library, own = Tokenizer.from_file(PATH), tokens.Counter(PATH)
    r = random.Random(3)
    parts = ["a", "the", " ", "\n", "\t", "\x1c", "\xa0", "<|endoftext|>", "é", "'s", "'ll", "12", "½", "\x00", "日本", "😀", "ing", "...", "_"]
    texts = ["", " ", "\n", "\n\n", "aaaa" * 500, "x" * 20_001, "ab" * 4000, "<|endoftext|><|endoftext|>", "<|endoftext|", " a\nb c", "don't I'LL"]
    texts += ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(2000)]
    texts += [t[1] for t in odd_rows() if t[1]]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.counts(texts, block=500) == want and own.counts(texts) == want


def test_token_counts_of_a_table(spark):
    got = rows_of(tokens.token_counts(clashing(docs(spark)), PATH), "doc_id", "n_bytes", "n_tokens", "over_limit")
    library = Tokenizer.from_file(PATH)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = [(r[0], len((r[1] or "").encode()), count(r[1]), count(r[1]) > 1024) for r in odd_rows()]
    assert Counter(got) == Counter(want)
    assert tokens.token_counts(docs(spark, []), PATH).count() == 0


def test_shards_are_even_gapless_and_mixed(spark):
    rows = odd_rows() + [(10_000 + i, f"text {i}", "en", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(900)]
    df = shards.interleave(clashing(docs(spark, rows)), 7)
    got = df.collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((x[0], len((x[1] or "").encode()) + 8, zlib.crc32((x[1] or "").encode())) for x in rows)
    n = Counter(r.shard for r in got)
    assert set(n) == set(range(7)) and max(n.values()) - min(n.values()) <= 1
    for s in n:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    hot = Counter(r.shard for r in got if r.source == "hot")
    # between two fractions every source has its share up to a row, so a shard of so many rows has it up to a row for each source
    assert max(hot.values()) - min(hot.values()) <= len({x[3] for x in rows})
    again = shards.interleave(docs(spark, rows[::-1]).repartition(5), 7)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got))
    assert shards.interleave(docs(spark, []), 7).count() == 0
    assert {r.shard for r in shards.interleave(docs(spark, rows[:3]), 24).collect()} == {0, 8, 16}
