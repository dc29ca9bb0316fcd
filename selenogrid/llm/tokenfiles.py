"""Token ids as Parquet: one row a document with its ids as a list, in ascending order of ids.

Documents are dealt into ranges of their id, each range becomes one file, and a task encodes its texts in order, so the place of a
document within its file is a running sum. ``ids`` has few distinct values and is dictionary encoded; ``doc_id``, ``place`` and
``n_tokens`` rise slowly or vary little and are delta encoded. Row groups and pages are bounded, and since files are sorted, the bounds
of ``doc_id`` and ``place`` kept for each row group and page let a reader fetch some documents, or some stretch of the token stream,
without the rest; what only needs lengths never touches ``ids``. A second, small table tells where each file starts.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from selenogrid.llm.base import batches, utf8_bytes

#: Bytes of text that make one file, bytes of a row group and of a page, and rows of a page.
FILE_BYTES, GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 16 << 20, 256 << 10, 2_000
#: A worker remembers so many pieces that it met again, and those that it met once until twice so many others came; none of more characters than this.
KNOWN, ONCE, LONGEST = 250_000, 60_000, 64


class Encoder:
    """The ids that the library gives for whole texts.

    A vocabulary that drops white space treats what lies between two blanks or line feeds alike wherever it stands, so texts are cut
    there, the different pieces of a batch are found, and a worker asks the library only for those that it does not remember. It is
    meant for vocabularies that also keep letters and digits apart from marks, so the mark after a word is a piece of its own, and
    where the vocabulary has lower case only, A-Z are lowered first unless that would make a special token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's own threads would take the others' cores
        self.library, self.known, self.once, self.older = Tokenizer.from_file(path), {}, {}, {}
        self.library.no_truncation()
        self.library.no_padding()
        self.lower = "Lowercase" in str(self.library.normalizer)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def ids(self, texts: pa.Array, end: int | None, block: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has; ``end`` is put after each text. Null counts as ''."""
        texts = pc.fill_null(texts, "")
        if self.lower and not any(pc.any(pc.match_substring(texts, s, ignore_case=True)).as_py() for s in self.special):
            texts = pc.ascii_lower(texts)
        texts = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), r"([\pL\pN])([.,;:!?]) ", r"\1 \2 ")
        words = pc.split_pattern(texts, " ")
        flat = words.flatten().dictionary_encode()
        index = flat.indices.to_numpy()
        values = self._values(flat.dictionary.to_pylist())
        size = np.array([len(v) // 4 for v in values], np.int64)
        data, start = np.frombuffer(b"".join(values), "<u4"), np.cumsum(size) - size
        parts = []
        for at in range(0, len(index), block):
            i = index[at : at + block]
            n = size[i]
            parts.append(data[np.repeat(start[i] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        ids = np.concatenate(parts) if parts else np.zeros(0, "<u4")
        sums = np.append(0, np.cumsum(size[index]))[np.append(0, np.cumsum(pc.list_value_length(words).to_numpy()))]
        n = np.diff(sums)
        return (ids, n) if end is None else (np.insert(ids, sums[1:], end), n + 1)

    def _values(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of some different pieces. What is met again is kept; what is new may be forgotten soon."""
        values = list(map(self.known.get, pieces))
        open_ = [i for i, v in enumerate(values) if v is None]
        new = []
        for i in open_:
            p = pieces[i]
            values[i] = v = self.once.get(p, self.older.get(p))
            if v is None:
                new.append(i)
            else:
                self.known[p] = v
        for i, v in zip(new, self._ask([pieces[i] for i in new]), strict=True):
            values[i] = v
            if len(pieces[i]) <= LONGEST:
                self.once[pieces[i]] = v
        if len(self.known) > KNOWN:
            self.known = {}
        if len(self.once) > ONCE:
            self.once, self.older = {}, self.once
        return values

    def _ask(self, pieces: list[str], together: int = 500) -> Iterator[bytes]:
        """The ids of each piece. The library is asked for many at once, a blank between them; where each id comes from tells whose it is."""
        groups = [pieces[i : i + together] for i in range(0, len(pieces), together)]
        for group, found in zip(groups, self.library.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ends = np.cumsum([len(p) + 1 for p in group])
            starts = np.fromiter(map(itemgetter(0), found.offsets), np.int64, len(found))
            ids, cut = np.array(found.ids, "<u4").tobytes(), 4 * np.searchsorted(starts, ends)
            yield from (ids[a:b] for a, b in pairwise([0, *cut.tolist()]))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, vocabulary: str, folder: str, end: int | None = None, file_bytes: int = FILE_BYTES, group_bytes: int = GROUP_BYTES,
          page_rows: int = PAGE_ROWS, text: str = "text", doc_id: str = "doc_id") -> None:
    """Writes ``folder``/tokens (doc_id, part, place, n_tokens, ids) and ``folder``/parts (part, start, n_tokens, n_docs).

    ``vocabulary`` is a path that every executor can open. A null or empty text has no ids but ``end``. Rows are in ascending order of
    ``doc_id``, null first; rows of one id are in the order of their texts, so repeated rows lie side by side. An empty table
    gives files without rows. Other columns are not read. ``place`` counts the ids before a document in its file.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text"))
    size = rows.agg(F.sum(utf8_bytes("_text")).alias("n")).first()["n"] or 0
    # rows of one id may be many: the text's hash lets a range end between them
    keys = ["doc_id", F.xxhash64("_text"), "_text"]
    dealt = rows.repartitionByRange(max(1, -(-size // file_bytes)), *keys[:2]).sortWithinPartitions(*keys)
    kind = dealt.schema["doc_id"].dataType.simpleString()

    def run(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for block in batches(table, most_bytes=4_000_000, text="_text"):
            ids, n = encoder(vocabulary).ids(block.column("_text"), end)
            ends = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(place + ends - n), pa.array(n), lists], ["doc_id", "place", "n_tokens", "ids"])
            place += int(ends[-1]) if len(ends) else 0

    made = dealt.mapInArrow(run, f"doc_id {kind}, place long, n_tokens long, ids array<int>")
    made = made.select("doc_id", F.spark_partition_id().alias("part"), "place", "n_tokens", "ids")
    options = {"parquet.writer.version": "v2", "parquet.block.size": group_bytes, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": page_rows,
               "parquet.enable.dictionary": "true", **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part", "place", "n_tokens")}}
    made.write.mode("errorifexists").options(**{k: str(v) for k, v in options.items()}).parquet(f"{folder}/tokens")
    parts = docs.sparkSession.read.parquet(f"{folder}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"))
    # one row a file; running sums go by blocks of 4,096 files, so that not even those lie in one window
    parts = parts.withColumn("block", F.floor(F.col("part") / 4096))
    blocks = parts.groupBy("block").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    within = F.sum("n_tokens").over(Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    starts = parts.withColumn("within", within).join(blocks.select("block", before.alias("before")), "block")
    starts.select("part", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "n_docs").write.mode("errorifexists").parquet(f"{folder}/parts")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)``: ``start`` counts the ids of all documents before. A filter on ``doc_id`` reads only the row
    groups and pages that can hold it, and ``ids`` only where selected."""
    rows, parts = spark.read.parquet(f"{folder}/tokens"), spark.read.parquet(f"{folder}/parts")
    starts = parts.select(F.col("part").alias("_part"), F.col("start").alias("_start"))
    return rows.join(starts, F.col("part") == F.col("_part")).select("doc_id", (F.col("_start") + F.col("place")).alias("start"), "n_tokens", "ids")


def stretch(spark: SparkSession, folder: str, start: int, stop: int) -> DataFrame:
    """``(start, ids)``: ids ``start`` to ``stop`` (left out) of the whole stream, by document, in no order; only the files that hold
    some are opened, and in them only the row groups and pages whose places overlap. An empty stretch has no rows."""
    parts = spark.read.parquet(f"{folder}/parts").filter((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    hit = parts.select("part", "start").orderBy("part").toLocalIterator()
    rows, out = spark.read.parquet(f"{folder}/tokens"), None
    for p in hit:
        low, high = start - p["start"], stop - p["start"]
        one = rows.filter((F.col("part") == p["part"]) & (F.col("place") < high) & (F.col("place") + F.col("n_tokens") > low))
        skip = F.greatest(F.lit(low) - F.col("place"), F.lit(0)).cast("int")
        size = F.least(F.lit(high) - F.col("place"), F.col("n_tokens")).cast("int") - skip
        one = one.select((F.lit(p["start"]) + F.col("place") + skip).alias("start"), F.slice("ids", skip + 1, size).alias("ids"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else rows.filter("false").select(F.col("place").alias("start"), "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """The rows of ``documents`` with ``ids_crc32`` (unsigned, of the ids as little-endian 32-bit integers) in place of the ids."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in table:
            lists = block.column("ids")
            at = np.asarray(lists.offsets)
            ids = np.asarray(lists.values).astype("<u4")
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("start"), block.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
