"""A training corpus from ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and hands what it
reads back to the next. All stages but the last return the columns of documents, whatever other columns those have.

Null and empty texts fail the quality rules, so later stages rarely see them; handed to a stage directly they have no words, no
secrets and no place in a batch. Null languages and sources are values of their own. Repeated rows are judged one by one, are one group
of near-duplicates, and are taken into the mixture together. Every stage gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selenogrid.llm import mixing, packing, quality, secrets, simhash
from selenogrid.llm.base import table, word_count
from selenogrid.llm.queries import EPOCHS, SEED, SHARE, WEIGHTS, with_domain
from selenogrid.session import write_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules go, and so do those that fail another rule unless their host is trusted, and all of a rejected
    host. A null source is no host."""
    return quality.apply(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the smallest id, a null id last. Texts without words are one group."""
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars follows; every document stays, those without a secret as they are."""
    return secrets.redact(docs, secrets.scan(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken to the target weights, as often as there are epochs that take them; a document without words is never taken."""
    named = with_domain(docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text", "lang", "source"))
    leaves = mixing.plan(named, mixing.LEVELS, WEIGHTS, SHARE, EPOCHS, SEED)
    return mixing.mix(named.drop("text"), leaves, mixing.LEVELS, SEED).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of padded batches, by document and span of words; a repeated document is packed each time."""
    return packing.pack(docs, word_count("text"))


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", near_duplicates), ("secret_scan", secret_scan), ("mix_sources", mix_sources), ("pack_lengths", pack)]
#: XXH64 fingerprints and the forest cannot be stated in SQL; the stages are tested one by one, and together, in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
