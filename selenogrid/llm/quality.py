"""Quality rules of documents and of their hosts, in DataFrame expressions only.

A document has counts and the rules that it fails. Failures are summed by host; the rate of each host is drawn towards
the rate of all by a beta prior that is fitted to the hosts themselves, so a host with few documents is not judged by
chance. A host far below what the prior expects is trusted, and one of which most documents fail is rejected. Documents that fail a rule go
unless their host is trusted; all documents of a rejected host go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selenogrid.llm.base import SPACES
from selenogrid.session import write_table

WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20  # words; percent of words in repeated windows
MOST_SYMBOLS, MEAN_WORD, MOST_DUP_LINES = 10, (2, 15), 50  # percent of words; characters; percent of lines
#: A host is rejected above this rate, and trusted if its rate is so many standard deviations of the prior below the prior's mean.
MOST_FAILURES, DEVIATIONS = 0.5, 1.0
SYMBOLS = "#*$%&|<>"


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words that lie in a window of 5 which the text holds twice or more."""
    hashes = F.transform(F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))),
                         lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)]))

    def covered(places: Column) -> Column:
        step = F.transform(places, lambda p, i: F.least(F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)).cast("long"))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def twice(sorted_: Column) -> Column:
        def same(e: Column, at: Column) -> Column:
            return F.coalesce(F.get(sorted_, at)["h"] == e["h"], F.lit(False))

        places = F.transform(F.filter(sorted_, lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda e: e["p"])
        return _bound(F.sort_array(places), covered)

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_bound(ordered, twice))

    return _bound(hashes, count)


def document_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines`` (with a word), ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed`` and ``failed`` (any rule).

    A null or empty text has no words and fails. Columns of these names in the input are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    blank = " " * (len(SPACES) - 1)
    words = F.array_remove(F.split(F.translate(whole, SPACES[1:], blank), " "), "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = _bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words")))
    per_line = _bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "failed")
    # the array of one value is exploded, not indexed: an explode is a step of its own, so the counts are taken once
    out = docs.drop(*names).withColumn("_counts", F.explode(F.array(F.struct(
        found.alias("w"), per_line.alias("l"), F.length(F.translate(whole, SPACES, "")).cast("long").alias("c"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("s")))))
    n, c = F.col("_counts.w.n_words"), F.col("_counts.c")
    out = out.select("*", n.alias("n_words"), c.alias("word_chars"), F.col("_counts.s").alias("n_symbols"), F.col("_counts.l.n_lines").alias("n_lines"),
                     F.col("_counts.l.n_dup_lines").alias("n_dup_lines"), F.col("_counts.w.n_repeat_words").alias("n_repeat_words")).drop("_counts")
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    other = ((100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("n_words")) | (F.col("word_chars") < MEAN_WORD[0] * F.col("n_words"))
             | (F.col("word_chars") > MEAN_WORD[1] * F.col("n_words")) | (100 * F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines")))
    return out.withColumn("failed", F.col("base_failed") | other)


def host_verdicts(stats: DataFrame, host: str = "source", most: float = MOST_FAILURES) -> DataFrame:
    """``(host, n_docs, n_failed, host_rate, host_rejected, host_trusted)``: one row a host, null hosts left out.

    The prior is the beta distribution whose mean is the rate over all documents and whose variance is that of the hosts'
    rates (weighted by documents) beyond what drawing documents explains.
    """
    sums = stats.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    sums = write_table(sums, "host-sums")
    all_ = sums.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("k"), F.count(F.lit(1)).alias("hosts"),
                    F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("squares"))
    mean = F.col("k") / F.col("n")
    spread = mean * (1 - mean)
    beyond = F.col("squares") / F.col("n") - mean * mean - spread * F.col("hosts") / F.col("n")
    weight = F.when((beyond > 0) & (spread > 0), F.least(F.greatest(spread / beyond - 1, F.lit(1.0)), F.lit(1e6))).otherwise(1e6)
    prior = all_.filter("n > 0").select(mean.alias("mean"), weight.alias("weight"))
    rate = (F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
    off = DEVIATIONS * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return sums.crossJoin(prior).select(  # prior: one row
        "host", "n_docs", "n_failed", rate.alias("host_rate"), (rate > most).alias("host_rejected"), (rate < F.col("mean") - off).alias("host_trusted"))


def judge(stats: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``document_stats`` with ``kept``: not failed at the base, no rule failed unless the host is trusted, and not of a rejected host.

    ``stats`` is read twice and should be a written table. A document without a host is judged by its own rules alone.
    """
    verdicts = host_verdicts(stats, host).filter("host_rejected OR host_trusted").select(F.col("host").alias("_host"), "host_trusted")
    trusted, other = F.coalesce("host_trusted", F.lit(False)), F.col("host_trusted").isNull()
    # a host with a verdict is trusted or else rejected; the base rules know no trust
    kept = ~F.col("base_failed") & (trusted | (other & ~F.col("failed")))
    return stats.drop("kept", "host_trusted").join(verdicts, F.col(host) == F.col("_host"), "left").withColumn("kept", kept).drop("_host", "host_trusted")


def apply(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that are kept, with their own columns."""
    work = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("text"), F.col(host).alias("source"))
    stats = write_table(document_stats(work).drop("text"), "quality")
    return judge(stats).filter("kept").select("_doc.*")
