"""Secrets in texts: candidates by shape, false positives removed by a random forest.

A candidate is a long run of key characters that holds a digit, or a value that is assigned to a name such as ``token``. The
forest sees its length, its character transitions, how much of it corpus words cover, the path of its document and the
words around it. It is trained on labelled findings.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selenogrid.llm.base import batches, held_out, spread
from selenogrid.session import write_table

#: Forms of well-known credentials, and names that values are assigned to.
KNOWN_FORMS = r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[0-9A-Za-z]{36}|^xox[abpr]-[0-9A-Za-z-]{10,}|^sk_live_[0-9A-Za-z]{16,}|^AIza[0-9A-Za-z_-]{35}$"
NAMES = r"password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth"
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
ASSIGNED = re.compile(rf"(?:{NAMES})[\"']?\s{{0,4}}[:=]\s{{0,4}}[\"']?([^\s\"',;]{{6,}})", re.I)
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|your|xxxx|0000|1234567|(.)\1{5}", re.I)
#: A word is in the dictionary if at least this share of all occurrences in documents are its own, so there are at most 50,000 of them; its least letters.
SHARE, LEAST_LETTERS = 1 / 50_000, 4
#: Labelled findings that are learned from at most, and the size of the forest.
MOST_LABELS, TREES, DEPTH = 10_000, 40, 8
HASHES = 16
#: Characters before a value that hold a name and what stands between; the patterns of a name cannot match more.
NAMED = 40
NAME = re.compile(NAMES.replace("[_-]?", "_?"), re.I)


def dictionary(docs: DataFrame, share: float = SHARE, text: str = "text") -> list[str]:
    """Words of letters, in order, whose documents are at least ``share`` of the documents of all words together; so there are at
    most 1 / ``share`` of them, and as many at every size of the corpus. Counted over all texts."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            words = [w for w in seen if len(w) >= LEAST_LETTERS and w.isalpha()]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64())], ["word", "n"])

        for part in batches(rows, text="_text"):
            for t in part.column("_text").to_pylist():
                seen.update(set((t or "").lower().split()))
            if len(seen) > 200_000:
                yield out()
                seen.clear()
        yield out()

    counts = docs.select(F.col(text).alias("_text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = write_table(counts, "word-counts")
    all_ = counts.agg(F.sum("n")).first()[0] or 0
    return sorted(r.word for r in counts.filter(F.col("n") >= share * all_).select("word").collect())


def candidates(text: str | None) -> list[tuple[int, str, str, list[str], list[str]]]:
    """``(start, value, what stands before, two words before, word after)`` of each candidate of a text, in order. Words are whole, however
    long; names that values are assigned to are not among them, since labels may come from these."""
    found: dict[int, str] = {}
    for m in RUN.finditer(text or ""):
        if any(c.isdigit() for c in m.group()):
            found[m.start()] = m.group()
    for m in ASSIGNED.finditer(text or ""):
        found.setdefault(m.start(1), m.group(1))
    out, end = [], 0
    for at in sorted(found):
        value = found[at]
        if at >= end:
            end = at + len(value)
            out.append((at, value, text[max(0, at - NAMED) : at], _words(text, at, -1, 2), _words(text, end, 1, 1)))
    return out


def _words(text: str, at: int, side: int, n: int) -> list[str]:
    """The ``n`` words nearest to a place, before it (-1) or after it (1), names left out. As much is read as they need."""
    span = 64
    while True:
        part = text[max(0, at - span) : at] if side < 0 else text[at : at + span]
        whole = span >= (at if side < 0 else len(text) - at)
        words = re.findall(r"\w+", part)
        if not whole and words:
            words = words[1:] if side < 0 else words[:-1]  # the farthest may be cut
        words = [w for w in words if not NAME.search(w)]
        if whole or len(words) >= n:
            return words[-n:] if side < 0 else words[:n]
        span *= 4


def covered(value: str, words: set[str], longest: int) -> float:
    """Share of the characters of a value that lie in dictionary words, the longest first from the left."""
    low, at, hit = value.lower(), 0, 0
    while at < len(low):
        step = next((k for k in range(min(longest, len(low) - at), LEAST_LETTERS - 1, -1) if low[at : at + k] in words), 0)
        hit += step
        at += step or 1
    return hit / max(1, len(low))


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _hash(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % HASHES


def features(value: str, near: list[str], far: list[str], path: str | None, words: set[str], longest: int) -> list[float]:
    n = len(value)
    kinds = [_kind(c) for c in value]
    moves = [0.0] * 16
    for a, b in zip(kinds, kinds[1:], strict=False):
        moves[4 * a + b] += 1 / max(1, n - 1)
    share = [c / n for c in Counter(value).values()]
    around = [0.0] * (2 * HASHES)
    for w in near:
        around[_hash(w)] = 1.0
    for w in far:
        around[HASHES + _hash(w)] = 1.0
    return [float(n), -sum(p * math.log2(p) for p in share), covered(value, words, longest),
            float(_hash(path or "")), float(set(value.lower()) <= set("0123456789abcdef")), *moves, *around]


def findings(docs: DataFrame, words: list[str], text: str = "text", path: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, hash, start, value, before, features)``: one row a candidate; start counts characters from 0, hash is the XXH64
    of the document's text. A text without candidates, or a null one, gives no rows."""
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("hash"), F.col(path).cast("string").alias("_path"), F.col(text).alias("_text"))
    known, longest = set(words), max(map(len, words), default=0)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(rows, text="_text"):
            at, found = [], []
            for i, (path_, t) in enumerate(zip(part.column("_path").to_pylist(), part.column("_text").to_pylist(), strict=True)):
                for start, value, before, near, far in candidates(t):
                    at.append(i)
                    found.append((start, value, before, features(value, near, far, path_, known, longest)))
            take = pa.array(at, pa.int64())
            kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64()))
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("hash").take(take), *columns], ["doc_id", "hash", "start", "value", "before", "features"])

    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, hash long, start long, value string, before string, features array<double>")


def seed_label() -> Column:
    """Label of a finding where no reviewer gave one: 1 for the form of a known credential, or a value assigned to a credential's
    name unless it is a placeholder; 0 for anything else. Neither the name nor the form is a feature, so the forest learns what such
    values look like and where they stand, and can turn down a named value or find one without a name."""
    named = F.col("before").rlike(rf"(?i)(?:{NAMES})[\"']?\s{{0,4}}[:=]\s{{0,4}}[\"']?$")
    dummy = F.col("value").rlike(rf"(?i){PLACEHOLDER.pattern}")
    return F.when((F.col("value").rlike(KNOWN_FORMS) | named) & ~dummy, 1.0).otherwise(0.0)


def train(labelled: DataFrame, most: int = MOST_LABELS, seed: int = 42) -> RandomForestClassificationModel | None:
    """A forest from ``(doc_id, start, value, features, label)``: at most ``most`` findings in a seeded order, those of held-out documents left
    out, repeated values once: of equal values with one label the first by document and place stands for all, and a value with two labels is
    learned with both. Null ids are not held out. None where the findings have one label only, or there are none."""
    once = labelled.filter(~held_out("doc_id")).groupBy("value", "label").agg(F.min_by("features", F.struct("doc_id", "start")).alias("features"))
    rows = once.orderBy(spread(seed, "value"), "value", "label").limit(most).select(array_to_vector("features").alias("features"), "label")
    rows = write_table(rows, "secret-labels")
    if rows.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=32, seed=seed, featureSubsetStrategy="sqrt")
    return forest.fit(rows)


def scan(docs: DataFrame, labels: DataFrame | None = None, threshold: float = 0.5, text: str = "text", path: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, hash, start, value, score, is_secret)``: one row a candidate.

    ``labels`` are reviewed findings (doc_id, start, label); without them, ``seed_label`` labels the findings. A candidate gets its score
    from the forest; where all labels are the same, that label is the score. Repeated documents have their findings repeated. A null or
    empty text has none; values of any length are read whole; a score equal to ``threshold`` is a secret. Reviewed labels that are
    null are left out. Other columns are not read, and an empty table gives no rows.
    """
    found = write_table(findings(docs, dictionary(docs, text=text), text, path, doc_id), "findings")
    if labels is None:
        given = found.withColumn("label", seed_label())
    else:
        given = found.join(labels.select("doc_id", "start", F.col("label").cast("double").alias("label")), ["doc_id", "start"]).filter("label is not null")
    model = train(given)
    if model is None:
        only = given.agg(F.coalesce(F.max("label"), F.lit(0.0)).alias("score"))
        scored = found.crossJoin(only)  # one row
    else:
        scored = model.transform(found.withColumn("features", array_to_vector("features"))).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "hash", "start", "value", "score", (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, scanned: DataFrame, mark: str = "[SECRET]", text: str = "text", doc_id: str = "doc_id", length: str | None = "n_chars") -> DataFrame:
    """All documents, every secret of a text replaced by ``mark`` wherever the text holds it; ``length``, where there is such a
    column, follows the new text."""
    hits = scanned.filter("is_secret").groupBy(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash")).agg(F.collect_set("value").alias("_values"))
    hits = write_table(hits.withColumn("_values", F.array_sort("_values", lambda a, b: F.length(b) - F.length(a))), "secrets")
    rows = docs.withColumn("_own", F.xxhash64(text)).join(hits, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left")
    clean = F.when(F.col("_values").isNull(), F.col(text)).otherwise(F.aggregate("_values", F.col(text), lambda t, v: F.replace(t, v, F.lit(mark))))
    out = rows.withColumn(text, clean)
    if length in docs.columns:
        out = out.withColumn(length, F.when(F.col("_values").isNull(), F.col(length)).otherwise(F.length(text).cast(docs.schema[length].dataType)))
    return out.select(*docs.columns)
