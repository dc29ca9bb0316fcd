"""How the sources of each language differ in the terms that they use.

Texts that are the same within a language are one: they are grouped with the number of times that each source has them, tokenized once,
and every term's occurrences and documents are added as often as the text occurs. A source lacks most terms, and all terms that it
lacks have the same probability, so two sources are compared on the terms that they share, and on what each has besides, by the
counts that occur; the terms that neither has are a product.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selenogrid.llm.base import batches, slabs
from selenogrid.session import write_table

LEAST_DOCS, SMOOTH, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Sources of one text that are handled together; a text of more sources is tokenized once for each such block.
TOGETHER = 1000
#: Counts that a worker sums up before it hands them on.
HELD = 600_000
#: A term is a run of ASCII letters and of characters beyond ASCII: in UTF-8 all other bytes become blanks, and A-Z become a-z.
TERMS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def collapse(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, text, sources)``: one row for each different text of a language, ``sources`` an array of (source, n).

    Null counts as ''. Texts are told apart by their SHA-256. A text is moved once, after the copies that one task holds have become one.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(word(lang).alias("lang"), word(source).alias("source"), word(text).alias("text")).withColumn("key", F.sha2("text", 256))
    texts = rows.groupBy("lang", "key").agg(F.first("text").alias("text"))
    counts = write_table(rows.groupBy("lang", "key", "source").agg(F.count(F.lit(1)).alias("n")), "copies")
    most = counts.agg(F.count_distinct("source").alias("n")).first()["n"]
    block = F.pmod(F.xxhash64("source"), F.lit(max(1, -(-most // TOGETHER))))
    lists = counts.groupBy("lang", "key", block.alias("block")).agg(F.collect_list(F.struct("source", "n")).alias("sources"))
    return texts.join(lists, ["lang", "key"]).select("lang", "text", "sources")


def term_counts(collapsed: DataFrame) -> DataFrame:
    """``(lang, source, term, n, n_docs)`` of the rows of ``collapse``: occurrences, and documents that have the term."""

    def run(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: defaultdict = defaultdict(Counter)
        docs: defaultdict = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in n.items():
                have = docs[lang, source]
                names = list(terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(names), pa.string()), pa.array([source] * len(names), pa.string()), pa.array(names, pa.binary()).cast(pa.string()),
                     pa.array(list(terms.values()), pa.int64()), pa.array([have[t] for t in names], pa.int64())], ["lang", "source", "term", "n", "n_docs"])
            n.clear()
            docs.clear()

        held = 0
        for block in batches(table, most_bytes=2_000_000):
            for lang, text, sources in zip(*(block.column(c).to_pylist() for c in ("lang", "text", "sources")), strict=True):
                counts: Counter = Counter()
                for part in slabs(text.encode("utf-8", "surrogatepass").translate(TERMS), b" "):
                    counts.update(part.split(b" "))
                counts.pop(b"", None)
                for s in sources:
                    group, times = (lang, s["source"]), s["n"]
                    a, b = n[group], docs[group]
                    held -= len(a)
                    if times == 1:
                        a.update(counts)
                        b.update(counts.keys())
                    else:
                        a.update({t: c * times for t, c in counts.items()})
                        b.update(dict.fromkeys(counts, times))
                    held += len(a)
            if held > HELD:
                yield from out()
                held = 0
        yield from out()

    made = collapsed.mapInArrow(run, "lang string, source string, term string, n long, n_docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def probability(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * terms)), exact: the quotient of two decimals, which ``div`` cuts off."""
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(20,0)"), (total + SMOOTH * terms).cast("decimal(20,0)")) + 1


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)``.

    A language keeps the terms of at least ``least`` of its documents. Part ``pair``: for each other source of the language, the sum of the
    differences of probability over all kept terms. Part ``term``: the ``top`` terms that the source has more of than its language. Ranks
    start at 1, greater values first, ties by name. Null texts, languages and sources count as ''; repeated rows count each; a group
    without terms is compared as well; a language of one source has no pairs; an empty table gives no rows. Other columns are not read.
    """
    collapsed = collapse(docs, text, lang, source)
    counts = write_table(term_counts(collapsed), "terms")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]).distinct()
    kept = counts.groupBy("lang", "term").agg(F.sum("n_docs").alias("d"), F.sum("n").alias("n")).filter(F.col("d") >= least)
    kept = write_table(kept.select("lang", "term", "n"), "kept-terms")
    whole = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("total"))
    have = write_table(counts.join(kept.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n"), "kept-counts")
    sums = have.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    groups = groups.join(sums, ["lang", "source"], "left").join(whole.select("lang", "terms"), "lang", "left")
    groups = groups.select("lang", "source", zero("total").alias("total"), zero("own").alias("own"), zero("terms").alias("terms"))
    absent = F.when(F.col("terms") > 0, probability(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(0)
    groups = write_table(groups.withColumn("absent", absent), "groups")
    has = have.join(groups.select("lang", "source", "total", "terms", "absent"), ["lang", "source"])
    has = write_table(has.select("lang", "source", "term", "n", "absent", probability(F.col("n"), F.col("total"), F.col("terms")).alias("p")), "probabilities")
    return _pairs(groups, has).unionByName(_terms(kept, whole, has, top))


def _pairs(groups: DataFrame, has: DataFrame) -> DataFrame:
    other = groups.select("lang", F.col("source").alias("item"), F.col("own").alias("own2"), F.col("absent").alias("absent2"))
    # what a source has against the absence of the other: by the probabilities that occur, of which there are few
    steps = has.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k"))
    alone = steps.join(other.select("lang", "item", "absent2"), "lang").filter("source <> item")
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("k") * F.abs(F.col("p") - F.col("absent2"))).alias("value"), F.lit(0).cast("long").alias("both"))
    # terms that two sources share; each pair once, the lesser name first
    second = has.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p2"), F.col("absent").alias("absent2"))
    shared = has.join(second, ["lang", "term"]).filter("source < item")
    more = F.abs(F.col("p") - F.col("p2")) - F.abs(F.col("p") - F.col("absent2")) - F.abs(F.col("p2") - F.col("absent"))
    shared = shared.groupBy("lang", "source", "item").agg(F.sum(more).alias("value"), F.count(F.lit(1)).alias("both"))
    shared = write_table(shared, "shared-terms")
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value", "both")
    alone = write_table(alone, "own-terms")
    parts = alone.unionByName(turned(alone)).unionByName(shared).unionByName(turned(shared))
    parts = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("part"), F.sum("both").alias("both"))
    pairs = groups.join(other, "lang").filter("source <> item").join(parts, ["lang", "source", "item"], "left")
    neither = F.col("terms") - F.col("own") - F.col("own2") + F.coalesce("both", F.lit(0).cast("long"))
    value = neither * F.abs(F.col("absent") - F.col("absent2")) + F.coalesce("part", F.lit(0).cast("long"))
    return _ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")))


def _terms(kept: DataFrame, whole: DataFrame, has: DataFrame, top: int) -> DataFrame:
    usual = kept.join(whole, "lang").select("lang", "term", probability(F.col("n"), F.col("total"), F.col("terms")).alias("q"))
    more = has.join(usual, ["lang", "term"]).filter("p > q")
    return _ranked(more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))).filter(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))
