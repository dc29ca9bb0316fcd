"""Shards whose mixture of sources is that of the whole: proportional stratified interleaving.

The rows of a source are put in a seeded order and get the fraction of the source that lies before their middle. Sorted
by that fraction, the rows between any two fractions hold every source in its share of the whole, up to one row, so equal
cuts of the sorted rows are shards of the same mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selenogrid.llm.base import ranked, spread, utf8_bytes
from selenogrid.session import write_table

#: Hash or fraction ranges within which ranks are counted; a window holds one of them.
RANGES = 4096


def interleave(docs: DataFrame, shards: int, seed: int = 42, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, source, size, text_crc32, law, shard, slot, grown_shard)``, row for row.

    Row counts of shards differ by one at most. A null source is a source of its own, a null text has no bytes, a null
    id is ordered first. Rows with the same id follow one another in a shard or across a cut; equal rows are interchangeable.
    Other columns are not read.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), (utf8_bytes(text) + 8).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"), spread(seed, doc_id).alias("h"))
    order = ["h", "doc_id", "text_crc32", "size"]
    rows = ranked(rows, ["source"], F.shiftright("h", 48).cast("int"), order, RANGES, total="n_source")
    rows = rows.withColumn("at", (F.col("rank") + 0.5) / F.col("n_source")).drop("rank", "n_source")
    rows = write_table(rows, "interleaved")
    rows = ranked(rows, [], F.floor(F.col("at") * RANGES).cast("int"), ["at", "source", *order], RANGES, total="n")
    shard = F.expr(f"rank * {shards} div n")
    return rows.select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
        (F.col("rank") - F.expr(f"((rank * {shards} div n) * n + {shards - 1}) div {shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
