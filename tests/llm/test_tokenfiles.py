import glob
import random
import tempfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from llm_cases import clashing, docs, odd_rows, words
from tokenizers import Tokenizer

from selenogrid.llm import tokenfiles

PATH = public_tokenizers.path("word_bpe_49k.json")


def folder():
    return tempfile.mkdtemp(prefix="token-files-", dir="/tmp") + "/t"


def test_ids_are_the_librarys(monkeypatch):
    library, own = Tokenizer.from_file(PATH), tokenfiles.Encoder(PATH)
    r = random.Random(3)
    parts = ["a", "the", " ", "\n", "\t", "\x1c", "\xa0", "<|endoftext|>", "é", "é", "́", "'s", "'LL", "12", "½", "\x00", "日本", "😀", "ING", "...", "_", "Σ", "ΑΣ", "İ", " ", "ᄀ", "ᅡ"]
    texts = ["", " ", "\n", "a" * 5000, "<|endoftext|><|startoftext|>", *["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(4000)], *[t[1] for t in odd_rows() if t[1]]]
    want = [e.ids + [2] for e in library.encode_batch(texts, add_special_tokens=False)]
    ids, n = own.ids(pa.array(texts), 2)
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    plain = ["".join(r.choice([p for p in parts if "<" not in p] + ["A.", "b. ", "1, ", "_. ", "é! ", "x.. "]) for _ in range(r.randrange(40))) for _ in range(4000)]  # lowered first
    for some in (plain, [*plain, "the <|ENDOFTEXT|> END"], [*plain, "the<|endoftext|>END. "]):
        want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
        ids, n = own.ids(pa.array(some), None)
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    monkeypatch.setattr(tokenfiles, "KNOWN", 10)
    monkeypatch.setattr(tokenfiles, "ONCE", 5)
    many = [*texts, words(300_000, 5)]
    ids, n = own.ids(pa.array([*many, None]), None, block=1000)
    want = [e.ids for e in library.encode_batch([*many, ""], add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want] and np.array_equal(ids, np.concatenate([np.array(w) for w in want]))


def test_round_trip_starts_and_checksums(spark):
    rows = odd_rows() + [(7_000 + i // 3, words(20, i), "en", "src0", 1) for i in range(300)]
    where = folder()
    tokenfiles.write(clashing(docs(spark, rows).repartition(5)), PATH, where, end=2, file_bytes=20_000, page_rows=20)
    library = Tokenizer.from_file(PATH)
    ids = {(r[0], r[1]): library.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows}
    got = sorted(tokenfiles.documents(spark, where).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((r[0], tuple(ids[r[0], r[1]])) for r in rows)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in tokenfiles.checksums(tokenfiles.documents(spark, where)).collect()}
    assert sums == {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    stream = [i for r in got for i in r.ids]
    for a, b in [(0, 1), (100, 5_000), (len(stream) - 3, len(stream) + 9), (7, 7)]:
        pieces = sorted(tokenfiles.stretch(spark, where, a, b).collect(), key=lambda r: r.start)
        assert [i for p in pieces for i in p.ids] == stream[a:b]


def test_files_have_the_encodings_and_indexes(spark):
    where = folder()
    tokenfiles.write(docs(spark, [(i, words(60, i), "en", "s", 1) for i in range(3000)]), PATH, where, end=2, group_bytes=100_000, page_rows=50)
    (file,) = glob.glob(f"{where}/tokens/*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert meta.num_row_groups > 1
    seen = {meta.row_group(0).column(c).path_in_schema: meta.row_group(0).column(c) for c in range(meta.num_columns)}
    assert "RLE_DICTIONARY" in seen["ids.list.element"].encodings
    for name in ("doc_id", "place", "n_tokens"):
        assert "DELTA_BINARY_PACKED" in seen[name].encodings and "RLE_DICTIONARY" not in seen[name].encodings
        assert seen[name].has_column_index and seen[name].has_offset_index
    assert all(meta.row_group(g).column(0).statistics.max < meta.row_group(g + 1).column(0).statistics.min for g in range(meta.num_row_groups - 1))
    some = tokenfiles.documents(spark, where).filter("doc_id between 100 and 120")
    assert some.count() == 21
    plan = some.select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,100)" in plan and "ids" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_empty_table(spark):
    where = folder()
    tokenfiles.write(docs(spark, []), PATH, where, end=2)
    assert tokenfiles.documents(spark, where).count() == 0 and tokenfiles.stretch(spark, where, 0, 10).count() == 0
    assert tokenfiles.checksums(tokenfiles.documents(spark, where)).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
