"""Graded quality by ordinal regression: one set of hashed-text weights, ordered thresholds between grades.

With x the features of a text, P(grade > k) = 1 / (1 + exp(t_k - w.x)) with t_0 < t_1 < ...; the chances of the grades add up to
an expected grade, and the tail above a grade is what documents are selected by.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selenogrid.llm.base import batches, held_out
from selenogrid.llm.toxicity import labelled

#: Labelled documents that are learned from at most.
MOST_LABELS = 8_000
SPACE = 1 << 16
KNOWN = 500_000
SHAPES = [(re.compile(p), s) for p, s in ((r"[^\W\d_]*[a-zß-öø-ÿ][^\W\d_]*", "a"), (r"[A-ZÀ-ÖØ-Þ]+", "A"), (r"\d+", "0"), (r"([^\w])\1+", r"\1\1"))]


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % SPACE


class Features:
    """Hashed features of a text: words and shapes of words by their share, and doc-wide facts in steps. Facts end in an open step: a mean
    word of 30 characters or more, 2^20 words or more, 2^12 words a line or more."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def _word(self, word: str) -> tuple[int, int]:
        shape = word
        for pattern, sign in SHAPES:
            shape = pattern.sub(sign, shape)
        return _slot(f"w {word.lower()}"), _slot(f"s {shape}")

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        counts = Counter(words)
        if len(self.known) > KNOWN:
            self.known = {}
        for w in counts.keys() - self.known.keys() if len(self.known) < len(counts) else [w for w in counts if w not in self.known]:
            self.known[w] = self._word(w)
        n = max(1, len(words))
        slots = np.array([self.known[w] for w in counts], np.int64).reshape(-1, 2)
        share = np.fromiter(counts.values(), np.float64, len(counts)) / n
        lines = [x for x in (text or "").split("\n") if x]
        facts = [f"length {min(len(words), 1 << 20).bit_length()}", f"distinct {len(counts) * 10 // n}", f"mean {min(30, sum(map(len, words)) // n)}",
                 f"lines {len(set(lines)) * 10 // max(1, len(lines))}", f"per line {min(len(words) // max(1, len(lines)), 1 << 12).bit_length()}", "always"]
        index = np.concatenate([slots[:, 0], slots[:, 1], [_slot(f) for f in facts]]).astype(np.int64)
        value = np.concatenate([np.sqrt(share) * 0.5, share, np.full(len(facts), 0.5)])
        index, at = np.unique(index, return_inverse=True)
        return index, np.bincount(at, value)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, rounds: int = 150, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds (levels - 1) by gradient steps with momentum and scaling over all rows."""
    index, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    w, first, gaps = np.zeros(SPACE), np.zeros(1), np.zeros(max(0, levels - 2))
    params = [w, first, gaps]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        t = np.concatenate([first, first + np.cumsum(np.exp(gaps))]) if levels > 2 else first
        eta = np.bincount(row, value * w[index], len(rows))
        tail = 1 / (1 + np.exp(np.clip(t[None] - eta[:, None], -40, 40)))  # P(grade > k)
        above = np.concatenate([np.ones((len(rows), 1)), tail, np.zeros((len(rows), 1))], 1)
        at = np.arange(len(rows))
        chance = np.maximum(above[at, grades] - above[at, grades + 1], 1e-12)
        slope = above * (1 - above)
        d_eta = -(slope[at, grades] - slope[at, grades + 1]) / chance / len(rows)
        d_t = np.zeros_like(tail)  # of the thresholds below and above each row's grade
        low, high = grades > 0, grades < levels - 1
        d_t[at[low], grades[low] - 1] += slope[at[low], grades[low]] / chance[low] / len(rows)
        d_t[at[high], grades[high]] -= slope[at[high], grades[high] + 1] / chance[high] / len(rows)
        d_t = d_t.sum(0)
        later = np.cumsum(d_t[::-1])[::-1]
        grads = [np.bincount(index, value * d_eta[row], SPACE) + decay * w, later[:1], later[1:] * np.exp(gaps)]
        for k, (p, g) in enumerate(zip(params, grads, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return w, np.concatenate([first, first + np.cumsum(np.exp(gaps))]) if levels > 2 else first.copy()


def train(docs: DataFrame, ratings: DataFrame, grade: str = "grade", levels: int = 3, most: int = MOST_LABELS, seed: int = 42,
          text: str = "text", doc_id: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from at most ``most`` rated documents (doc_id, grade 0 to levels - 1); grades outside are left out.

    Null ids and grades are left out, and so are held-out ids. An id with several grades has the greatest; documents that share an id
    are all learned from with it. Null and empty texts have their facts only. Without any rating, or any document of a rated id, all
    weights are 0 and every grade is as likely.
    """
    usable = ratings.filter(F.col(grade).between(0, levels - 1))

    def vectors(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        for part in batches(rows, text="_text"):
            found = [of(t) for t in part.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("label").cast(pa.int32()), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))], ["grade", "i", "v"])

    sample = labelled(docs, usable, grade, most, seed, text, doc_id).mapInArrow(vectors, "grade int, i array<int>, v array<float>")
    table = sample.toArrow()  # at most ``most`` rows
    if not table.num_rows:
        return np.zeros(SPACE), np.log(np.arange(1, levels) / np.arange(levels - 1, 0, -1))
    index, value = table["i"].combine_chunks(), table["v"].combine_chunks()
    rows = [(np.asarray(i.values), np.asarray(v.values, np.float64)) for i, v in zip(index, value, strict=True)]
    return fit(rows, np.asarray(table["grade"]), levels)


def grades(docs: DataFrame, weights: np.ndarray, thresholds: np.ndarray, least: int = 1, chance: float = 0.5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, held_out, expected_grade, p_tail, kept)``, row for row: p_tail is P(grade >= ``least``), kept is p_tail >= ``chance``.

    A null text counts as empty. Other columns are not read.
    """

    @F.pandas_udf("expected_grade double, p_tail double")
    def grade(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = Features()
        for part in parts:
            eta = np.array([float(v @ weights[i]) for i, v in map(of, part.fillna(""))]).reshape(-1, 1)
            tail = 1 / (1 + np.exp(np.clip(thresholds[None] - eta, -40, 40)))
            yield pd.DataFrame({"expected_grade": tail.sum(1), "p_tail": tail[:, least - 1]})

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), grade(text).alias("g"))
    return rows.select("doc_id", "held_out", "g.expected_grade", "g.p_tail", (F.col("g.p_tail") >= chance).alias("kept"))
