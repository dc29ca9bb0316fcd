"""What the operators of this package share: table reading, written tables, words, seeded order, ranks and components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from selenogrid.session import write_table

#: A word is a run of anything but the six ASCII space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def utf8_bytes(text: str) -> Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def word_count(text: str) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def spread(seed: int, *keys: Column | str) -> Column:
    """60 seeded bits of a row's keys: the first 15 hexadecimal digits of an MD5, which other engines have too."""
    parts = [F.lit(str(seed))] + [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def ranked(df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[str], buckets: int, total: str | None = None) -> DataFrame:
    """Adds ``rank`` (0-based, gapless within ``group``), and ``total``, the rows of the group.

    ``bucket`` (0 to ``buckets`` - 1) must follow the order. Rows are counted by (group, bucket) first, so a window only
    ever holds one bucket, however large its group is; the running counts are over at most ``buckets`` rows a group.
    """
    df = df.withColumn("_bucket", bucket)
    key = [*group, "_bucket"]
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(*group)
    before = F.sum("_n").over(by.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    offsets = counts.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(key)], before.alias("_before"), F.sum("_n").over(by).alias("_total"))
    inner = df.withColumn("_row", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    same = [inner[k].eqNullSafe(offsets[f"_o{i}"]) for i, k in enumerate(key)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    out = inner.join(offsets, on).withColumn("rank", F.col("_before") + F.col("_row") - 1)
    drop = ["_bucket", "_before", "_row", *[f"_o{i}" for i in range(len(key))]]
    return (out.withColumnRenamed("_total", total) if total else out.drop("_total")).drop(*drop)


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every end of ``links`` (a, b: long): the smallest node reachable.

    Rounds of the large-star and small-star steps, each a minimum per node (combined before the shuffle) joined back to
    the links; the number of rounds grows with the logarithm of the longest chain. Every round is a written table.
    """
    a, b = F.col("a"), F.col("b")
    edges = write_table(links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        low = write_table(low, "lowest")  # a table of its own, so that the join below is one that Spark can split at a hub
        large = both.filter("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = write_table(large, "large-star")
        low = write_table(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(low.select(F.col("u").alias("k"), "m"), F.col("u") == F.col("k"))
        fresh = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        fresh = write_table(fresh, "small-star")
        stars = fresh.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count() == 0
        if stars and not fresh.join(fresh.select(F.col("u").alias("x")), F.col("v") == F.col("x"), "left_semi").limit(1).count():
            roots = fresh.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
            return fresh.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
        edges = fresh


def slabs(text: str | bytes, blank: str | bytes, size: int = 1_000_000) -> Iterator[str | bytes]:
    """A text in parts of about ``size``, cut at blanks, which are left out; a part is longer where no blank comes."""
    at = 0
    while len(text) - at > size:
        to = text.find(blank, at + size)
        if to < 0:
            break
        yield text[at:to]
        at = to + 1
    yield text[at:]


def batches(table: Iterator[pa.RecordBatch], most_bytes: int = 8_000_000, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of text at most, so that a worker's memory does not follow the batch."""
    for whole in table:
        column = whole.column(text)
        size = max(1, column.nbytes // max(1, len(column)))
        step = max(1, most_bytes // size)
        for at in range(0, len(whole), step):
            yield whole.slice(at, step)
