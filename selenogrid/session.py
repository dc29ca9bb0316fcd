"""Session defaults, the shared work folder, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


#: Bytes of a method that the JVM still compiles. Spark's own limit is higher: it keeps longer methods, and these are interpreted row by row.
LONGEST_METHOD = 8000


def compile_in_pieces(spark: SparkSession) -> SparkSession:
    """Have wide expressions generated operator by operator, in short methods, where one method for a whole stage would not be compiled."""
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) > LONGEST_METHOD:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(LONGEST_METHOD))
    return spark


def build_session(app: str = "selenogrid", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators expect; cluster settings win where the launcher set them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return compile_in_pieces(builder.getOrCreate())


def work_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a fresh local one where that is unset and the master is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def write_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` under the work folder and return the read-back table.

    This is how lineage is cut: a written table survives lost executors, is columnar (later jobs prune it), and gives
    the planner a real size, so that small tables are broadcast by the planner's own check and large ones are not.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/selenogrid/{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Compute a small result once and keep it, so that its measured size drives the planner's join choice.

    No broadcast hint is given: below ``spark.sql.autoBroadcastJoinThreshold`` the planner broadcasts it, above it
    the join is shuffled and adaptive execution splits a hot region.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    kept.count()
    return kept
