"""Toxicity of texts whose spelling may be disguised: a noisy channel is undone first, then the restored words are scored.

A token that holds leetspeak, separators between letters, or letters repeated thrice and more becomes a lattice: at each
character stand the letters that may have been meant, with what the disguise costs. A Viterbi search finds the path that
a character model of the whole corpus and the channel together find likeliest. All other tokens have one path, themselves.
Signs at the edges of a token may be letters or punctuation, so a token is read with as many of them as letters as can be;
the learned words tell which reading matters.
Words of a restored text carry features (the word, its beginnings and endings) whose toxicity was learned from labels.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selenogrid.llm.base import batches, held_out, spread

#: Symbols of the character model: 0 is what stands between words, 1 to 26 the letters with their marks taken off, 27 any other letter.
LETTERS = 28
#: Letters that a digit or sign is used for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
SEPARATORS = ".-_*~'/\\,:;#^=`·• "
SWAP, DROP, FOLD, STAY = -1.0, -0.5, -0.5, -2.0  # log costs: a swapped letter, a separator, a folded repetition, a sign that is meant
#: Labelled documents that are learned from at most.
MOST_LABELS = 20_000
#: A feature counts from so many toxic documents on, and is drawn towards the rate of all documents as if by so many more.
LEAST_DOCS, PRIOR_DOCS = 3, 5.0
#: Least strength of features that explain documents, and of those that occur with many sets of the former.
FIRST, SECOND = 0.5, 0.85
#: Runs of signs on either side of the letters of a token that are read with them; no word is longer.
REACH = 24
KNOWN = 500_000
SIGNS = "0123456789@$!|+€"
DISGUISED = re.compile(rf"(.)\1\1|[{re.escape(SIGNS + SEPARATORS)}]|[^\W\d_][\W\d_]+[^\W\d_]")
SPACED = re.compile(r"(?: \S){3,}(?= )")
EDGES = re.compile(r"^[^\w@$!|+€]+|[^\w@$!|+€]+$")
PLAIN = re.compile(r"[^\W\d_]+")


def _fold(code: int) -> int:
    c = chr(code)
    if not c.isalpha():
        return 0
    base = unicodedata.normalize("NFKD", c.lower())[0]
    return ord(base) - 96 if "a" <= base <= "z" else 27


#: By code point; the last entry stands for all beyond.
FOLDED = np.array([*map(_fold, range(0x250)), 27], np.uint8)


def folded(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return FOLDED[np.minimum(codes, len(FOLDED) - 1)]


def trigram_counts(texts: Iterator[str | None]) -> np.ndarray:
    """Counts of three symbols in a row; each text stands between two places that are not letters."""
    out = np.zeros(LETTERS**3, np.int64)
    for text in texts:
        for at in range(0, len(text or ""), 1 << 20):  # long texts in parts that overlap by two characters
            part = text[max(0, at - 2) : at + (1 << 20)]
            s = folded(part if at else "  " + part).astype(np.int32)
            out += np.bincount((s[:-2] * LETTERS + s[1:-1]) * LETTERS + s[2:], minlength=len(out))
    return out


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log probability of a symbol after two others, from all texts. What reaches the driver is at most 28 ** 3 counts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for part in batches(rows, text="_text"):
            joined = "  ".join(t for t in part.column("_text").to_pylist() if t)
            total += trigram_counts([joined])
        gram = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int32()), pa.array(total[gram], pa.int64())], ["gram", "n"])

    counts = docs.select(F.col(text).alias("_text")).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    table = np.full(LETTERS**3, 0.1)
    for r in counts:
        table[r.gram] += r.n
    table = table.reshape(LETTERS, LETTERS, LETTERS)
    # a pair that is rare by itself leans on the symbol alone
    pair, single = table.sum(0), table.sum((0, 1))
    single = single / single.sum()
    pair = (pair + 50 * single) / (pair.sum(1, keepdims=True) + 50)
    return np.log((table + 20 * pair[None]) / (table.sum(2, keepdims=True) + 20))


def restore(token: str, model: np.ndarray, head: int = 0, tail: int = 0) -> list[str]:
    """The likeliest meant spellings of a lower-case token. Signs that are meant become blanks.

    Of the ``head`` and ``tail`` signs at its edges, runs next to the rest are letters and those beyond are left out: one spelling
    for each number of runs that are, up to :data:`REACH` on either side. Signs farther out than a word is long are read as words of
    their own. If the rest alone is longer than two words, the signs before it are read with its beginning only. So the work grows
    with the token's length, and no length is left out.
    """
    runs = [(m.group()[0], len(m.group()), not head <= m.start() < len(token) - tail) for m in re.finditer(r"(.)\1*", token, re.S)]
    first = next((i for i, r in enumerate(runs) if not r[2]), len(runs))
    last = next((i for i in range(len(runs), first, -1) if not runs[i - 1][2]), first)
    low, high = max(0, first - REACH), min(len(runs), last + REACH)
    found = _paths(runs[first:high], last - first, model)
    for start in range(low, first):
        found += _paths(runs[start:high], last - start, model) if last - first <= 2 * REACH else _paths(runs[start : first + 2 * REACH], first + 2 * REACH - start, model)
    return found + _signs(runs[:low], model) + _signs(runs[high:], model)


def _signs(runs: list[tuple[str, int, bool]], model: np.ndarray) -> list[str]:
    """Spellings of a stretch without any letter, all its signs as letters, in pieces that overlap by :data:`REACH`; digits alone are a number."""
    pieces = [runs[at : at + 2 * REACH] for at in range(0, max(1, len(runs) - REACH), REACH)] if runs else []
    return [x for p in pieces if any(c in LEET and not c.isdigit() for c, _, _ in p) for x in _paths([(c, n, True) for c, n, _ in p], len(p), model)]


def _choices(c: str, n: int, edge: bool) -> list[tuple[str, float]]:
    """What a run of ``n`` times ``c`` may have been meant as, with the log costs."""
    if c.isalpha():
        # a run of more than 6 letters stands in no word, so that 6 of them do for any number
        return [(c * n, 0.0)] if n < 3 else [(c, FOLD), (c * 2, FOLD), (c * min(n, 6), 0.0)]
    choices = [] if edge and c in LEET else [(" ", STAY)]
    for meant in LEET.get(c, ""):
        if not edge or n != 2:  # two signs of an edge are two letters
            choices.append((meant, SWAP))
        if n > 1:
            choices.append((meant * 2, 2 * SWAP))
    if c in SEPARATORS:
        choices.append(("", DROP * min(n, 3)))
    return choices


def _paths(runs: list[tuple[str, int, bool]], last: int, model: np.ndarray) -> list[str]:
    """The best path through the first ``last`` runs (character, length, of an edge), and through each more of them."""
    beam: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    found = []
    for at, run in enumerate(runs, 1):
        choices = _choices(*run)
        fresh: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, done) in beam.items():
            for letters, cost in choices:
                s, x, y = score + cost, a, b
                for letter in letters:
                    z = _fold(ord(letter))
                    if not (y == z == 0):
                        s += model[x, y, z]
                        x, y = y, z
                if (x, y) not in fresh or s > fresh[x, y][0]:
                    fresh[x, y] = (s, (done, letters))
        beam = fresh
        if at >= last:
            path, letters = max(((score + (model[a, b, 0] if b else 0.0), done) for (a, b), (score, done) in beam.items()), key=lambda x: x[0])[1], []
            while path:
                path, part = path
                letters.append(part)
            found.append("".join(reversed(letters)))
    return found


class Tokens:
    """What each token says after its disguise is undone; remembers the tokens that it has met."""

    def __init__(self, model: np.ndarray, of_word):
        self.model, self.of_word, self.known = model, of_word, {}

    def words(self, token: str) -> list[str]:
        bare = EDGES.sub("", token)
        rest = bare.strip(SIGNS)
        if not PLAIN.search(rest):  # no letter: a word written wholly in signs, or a number
            return [w for x in _signs([(m.group()[0], len(m.group()), False) for m in re.finditer(r"(.)\1*", bare, re.S)], self.model) for w in PLAIN.findall(x)]
        if not DISGUISED.search(bare):
            return PLAIN.findall(bare)
        head, tail = len(bare) - len(bare.lstrip(SIGNS)), len(bare) - len(bare.rstrip(SIGNS))
        return [w for x in restore(bare, self.model, head, tail) for w in PLAIN.findall(x)]

    def __call__(self, text: str | None) -> list:
        """``of_word`` of each distinct word of a text, where it is not empty."""
        low = (text or "").lower()
        tokens = set(low.split())
        for m in SPACED.finditer(f" {low} "):  # as one word, and with a break wherever there may be one
            tokens.update((m.group().replace(" ", ""), m.group().strip()))
        if len(self.known) > KNOWN:
            self.known = {}
        for t in tokens.difference(self.known):
            # one or two letters are what is left of numbers and signs, and tell nothing
            found = {w: self.of_word(w) for w in self.words(t) if len(w) > 2}
            self.known[t] = tuple((w, v) for w, v in found.items() if v)
        return list(dict(x for t in tokens for x in self.known[t]).values())


def features(word: str) -> tuple[int, ...]:
    """32-bit hashes of a word, its beginnings of 4 to 6 and its endings of 4 and 5 letters."""
    parts = [f"^{word}$"] + [f"^{word[:k]}" for k in (4, 5, 6) if len(word) > k] + [f"{word[-k:]}$" for k in (4, 5) if len(word) > k]
    return tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) for p in parts)


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, seed: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(label, text)`` of the documents of at most ``most`` labelled ids, those first in a seeded order.

    Held-out ids and null ids or labels are left out; an id with several labels has the greatest. The chosen ids are a table of
    at most ``most`` rows of two numbers, so it is broadcast; texts are not shuffled.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id"))
    chosen = usable.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).alias("label")).orderBy(spread(seed, "_id"), "_id").limit(most)
    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").select("label", "_text")


def _select(toxic: list[np.ndarray], support: dict[int, int], clean: dict[int, int], rate: float) -> dict[int, float]:
    """Features that speak for label 1, with their strength.

    First those that explain toxic documents not explained yet, the strongest each time, so that what a group of copies has in
    common besides its toxic words is passed over; then those that occur with many different sets of the first.
    """
    strength = {f: (n + PRIOR_DOCS * rate) / (n + clean.get(f, 0) + PRIOR_DOCS) for f, n in support.items()}
    open_, chosen = [[f for f in d.tolist() if strength.get(f, 0) >= FIRST] for d in toxic], {}
    while True:
        left: dict[int, int] = {}
        for d in open_:
            for f in d:
                left[f] = left.get(f, 0) + 1
        best = max(left, key=lambda f: (left[f] * strength[f], f), default=None)
        if best is None or left[best] < LEAST_DOCS:
            break
        chosen[best] = strength[best]
        open_ = [d for d in open_ if best not in d]
    sets: dict[int, set] = {}
    for d in toxic:
        here = d.tolist()
        signature = frozenset(f for f in here if f in chosen)
        for f in here:
            if strength.get(f, 0) >= SECOND:
                sets.setdefault(f, set()).add(signature)
    return chosen | {f: strength[f] for f, s in sets.items() if len(s) >= 2 * LEAST_DOCS}


def train(docs: DataFrame, labels: DataFrame, model: np.ndarray, label: str = "toxic", most: int = MOST_LABELS, seed: int = 42,
          text: str = "text", doc_id: str = "doc_id") -> dict[int, float]:
    """Strength of features by hash, learned from at most ``most`` labelled documents; empty where no label is 1."""
    sample = labelled(docs, labels, label, most, seed, text, doc_id)

    def found(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(model, features)
        for part in batches(rows, text="_text"):
            for t in part.column("_text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([sorted({f for w in tokens(t) for f in w})], pa.list_(pa.int64()))], ["f"])

    toxic = [np.array(r.f, np.int64) for r in sample.filter("label = 1").mapInArrow(found, "f array<long>").collect()]  # of the sample
    if not toxic:
        return {}
    values, n = np.unique(np.concatenate(toxic), return_counts=True)
    support = dict(zip(values[n >= LEAST_DOCS].tolist(), n[n >= LEAST_DOCS].tolist(), strict=True))

    def seen(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = Tokens(model, lambda w: tuple(f for f in features(w) if f in support)), {-1: 0}
        for part in batches(rows, text="_text"):
            for t in part.column("_text").to_pylist():
                counts[-1] += 1
                for f in {f for w in tokens(t) for f in w}:
                    counts[f] = counts.get(f, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["f", "n"])

    counted = sample.filter("label = 0").mapInArrow(seen, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()  # of ``support``
    clean = {r.f: r.n for r in counted}
    return _select(toxic, support, clean, len(toxic) / (len(toxic) + clean.pop(-1, 0)))


def scores(docs: DataFrame, model: np.ndarray, strength: dict[int, float], threshold: float = 0.3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, row for row: the chance that at least one word of the restored text is toxic, if
    words were independent. A null or empty text scores 0; a null id is not held out. Other columns are not read."""

    def weigh(word: str) -> float:
        return max((strength.get(f, 0.0) for f in features(word)), default=0.0)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = Tokens(model, weigh)
        for part in parts:
            yield pd.Series([1.0 - math.prod(1.0 - p for p in sorted(tokens(t))) for t in part.fillna("")], dtype="float64")

    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), score(text).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
