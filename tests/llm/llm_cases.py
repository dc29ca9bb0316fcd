"""Small tables with what goes wrong: nulls, empty and very long texts, ties, repeated rows, clashing names."""

import random

from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                   StructField("source", StringType()), StructField("n_chars", LongType())])


def words(n, seed, vocab=400):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefgh") + str(r.randrange(vocab)) for _ in range(n))


def odd_rows():
    long = words(30_000, 1)
    out = [(1, None, "en", "src0", None), (2, "", "en", "src0", 0), (3, " \n\t ", None, "src1", 4), (None, words(40, 2), "de", None, 1),
           (5, words(60, 3), "en", "src1", 1), (5, words(60, 3), "en", "src1", 1), (6, words(60, 3), "fr", "src2", 1), (7, long, "en", "src0", 1),
           (8, "one", "en", "src19", 3), (9, "line a\nline a\nline b\n\n\nline a", "en", "other", 1), (10, "ÄÖ  x\x1cy 日本語 😀 <|endoftext|>", "en", "src3", 1)]
    for i in range(20, 80):
        out.append((i, words(30 + i, i), ["en", "de", "fr", "es", None][i % 5], f"src{i % 7}", 1))
    return out


def docs(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, DOCS)


def clashing(df):
    """The table with extra columns that operators might use themselves."""
    from pyspark.sql import functions as F

    for name in ("id", "h", "fp", "label", "rank", "n", "total", "hash", "domain", "epoch", "weight", "score", "kept", "n_words", "failed", "host", "budget", "tokens", "whole", "value"):
        df = df.withColumn(name, F.lit(-1))
    return df


def rows_of(df, *names):
    key = lambda row: tuple((v is None, str(v)) for v in row)
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=key)
