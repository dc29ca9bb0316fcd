"""SimHash near-duplicates: fingerprints of 3-word shingles, linked when few of their 64 bits differ.

Two fingerprints that differ in at most 3 bits agree in at least 5 of their 8 bytes. The index lists every distinct
fingerprint under the bytes that it has at certain positions: 14 sets of 4 positions, chosen so that any 5 positions
contain one of them whole. Fingerprints that meet under an entry are a candidate pair; the bytes that they share are
tallied, pairs that fall short of 5 go, and the rest are verified by their differing bits.

An entry that many fingerprints share is split: of the bits that the entry leaves free, a linked pair agrees in at
least one quarter, so the entry becomes four with that quarter added. This goes on until entries are short, and loses
no link. Only distinct fingerprints are compared, and one of them has at most 43,744 others within 3 bits, so links
grow with the input whatever the size of a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selenogrid.llm.base import batches, components
from selenogrid.session import write_table

BYTES, NEAR = 8, 3
SHINGLE = 3
#: Sets of 4 of the 8 positions whose exclusive or is 0. Every 3 positions lie in exactly one of them, and the other 4 positions
#: are such a set too, so the 5 positions that 3 differing bytes leave contain one.
POSITIONS = [c for c in combinations(range(BYTES), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
#: An entry with more fingerprints than this is split by its free bits. At least 8, which is all that three free bits allow, so
#: whatever is split has four quarters.
SHORT = 64


def fingerprint(text: str | None, block: int = 1 << 16) -> int:
    """SimHash of a text, as a signed 64-bit number. No words: 0. Hashes are held ``block`` at a time."""
    words = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not words:
        return 0
    spaces = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    starts, ends = np.append(0, spaces + 1), np.append(spaces, len(words))
    n = max(1, len(starts) - SHINGLE + 1)
    starts, ends = starts[:n], ends[-n:]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, block):
        hashes = [digest(words[s:e], 42) for s, e in zip(starts[at : at + block].tolist(), ends[at : at + block].tolist(), strict=True)]
        ones += np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``fp`` (long), row for row; only they and the text are read. A null text counts as empty."""
    kept = docs.select(*keep, F.col(text).alias("_text"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(rows, text="_text"):
            fps = pa.array([fingerprint(t) for t in part.column("_text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(k) for k in keep] + [fps], [*keep, "fp"])

    fields = [f for f in kept.schema.fields if f.name in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "fp long"])
    return kept.mapInArrow(run, schema)


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def mask_of(positions: tuple[int, ...]) -> int:
    return sum(255 << 8 * p for p in positions)


def quarters(mask: int) -> list[int]:
    """The masks that add one quarter of the free bits of ``mask`` to it."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in part) for part in (free[j::4] for j in range(4)) if part]


def shared_bytes(x: Column) -> Column:
    """Positions at which two fingerprints with the exclusive or ``x`` have the same byte."""
    return sum((F.when(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for i in range(BYTES)), F.lit(0))


def links(fps: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: every pair of distinct values of ``fp`` that differ in 1 to 3 bits, once."""
    spark = fps.sparkSession
    masks = F.explode(F.array(*[F.lit(signed(mask_of(p))) for p in POSITIONS])).alias("mask")
    index = fps.select("fp").distinct().select("fp", masks).withColumn("entry", F.col("fp").bitwiseAND(F.col("mask")))

    def shared(index: DataFrame) -> DataFrame:
        n = index.groupBy("mask", "entry").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        return write_table(index.join(n, ["mask", "entry"]).select("fp", "mask", "entry", "n"), "postings")

    postings, short = shared(index), []
    while True:
        short.append(postings.filter(F.col("n") <= SHORT))
        long = postings.filter(F.col("n") > SHORT)
        tall = [r.mask for r in long.select("mask").distinct().collect()]  # masks: at most 14, times 4 for each split
        if not tall:
            break
        finer = spark.createDataFrame([(m, signed(q)) for m in tall for q in quarters(m & (1 << 64) - 1)], "mask long, finer long")
        split = long.select("fp", "mask").join(finer, "mask").select("fp", F.col("finer").alias("mask")).distinct()
        postings = shared(split.withColumn("entry", F.col("fp").bitwiseAND(F.col("mask"))))
    pairs = None
    for part in short:
        a, b = part.select("mask", "entry", F.col("fp").alias("a")), part.select("mask", "entry", F.col("fp").alias("b"))
        met = a.join(b, ["mask", "entry"]).filter("a < b").select("a", "b", F.col("a").bitwiseXOR(F.col("b")).alias("x"))
        met = met.filter((shared_bytes(F.col("x")) >= BYTES - NEAR) & (F.bit_count("x") <= NEAR)).select("a", "b")
        pairs = met if pairs is None else pairs.unionByName(met)
    return pairs.distinct()


def labels(fps: DataFrame) -> DataFrame:
    """``(fp, label)`` for every fingerprint that is linked to another: the smallest fingerprint reachable."""
    return components(links(fps)).select(F.col("node").alias("fp"), "label")


def _roots(rows: DataFrame, least: Column) -> DataFrame:
    """``(fp, root)``: the least value of ``least`` among the rows whose fingerprints are linked to fp, itself included."""
    own = rows.groupBy("fp").agg(F.min(least).alias("own"))
    own = write_table(own.join(labels(rows), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "fingerprint-labels")
    roots = write_table(own.groupBy("label").agg(F.min("own").alias("root")), "fingerprint-roots")
    return write_table(own.select("fp", "label").join(roots, "label").select("fp", "root"), "fingerprint-components")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, fp, component_id)``, row for row.

    component_id is the smallest doc_id among rows whose fingerprints are linked, directly or by others; rows with the same
    fingerprint are always together, texts without words too. Null ids are passed over; it is null where all are null.
    Repeated rows stay repeated, and other columns are not read.
    """
    rows = write_table(fingerprints(docs, text, (doc_id,)), "fingerprints")
    return rows.join(_roots(rows, F.col(doc_id)), "fp").select(doc_id, "fp", F.col("root").alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents with one row left of each group: the one with the smallest id, then the smallest hash of its text.

    Null ids come last. Of rows with the same id and text, one stays, the first by a hash of the other columns.
    """
    named = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_h"), F.col(text).alias("_t"))
    rows = write_table(fingerprints(named, "_t", ("_id", "_h")), "fingerprints")
    row = F.struct(F.isnull("_id").alias("z"), F.col("_id").alias("id"), F.col("_h").alias("h"))
    chosen = _roots(rows, row).select(F.col("root.id").alias("_id"), F.col("root.h").alias("_first")).distinct()
    others = [c for c in docs.columns if not docs.schema[c].dataType.typeName() in ("map", "variant")]
    left = docs.withColumn("_h", F.xxhash64(text)).join(chosen, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_first")), "left_semi")
    first = Window.partitionBy(doc_id, "_h").orderBy(F.xxhash64(*others))
    return left.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*docs.columns)
