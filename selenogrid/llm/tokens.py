"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens, and the pre-tokens that a worker has not met yet are laid out one after another in one
array of symbols. In every round each pre-token merges the pair of lowest rank that it holds, wherever it occurs, all
pre-tokens at once; a pair of a merged symbol always has a higher rank than the merge that made the symbol, so this is the
order in which one merge at a time would go. What is left of a pre-token when no pair has a rank is its token count.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from selenogrid.llm.base import utf8_bytes

#: Fixed value: how the byte-level pre-tokenizer cuts a text.
CUT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space other than lone blanks and lone line feeds.
UNEVEN = re.compile(r"\s\s|[^\S \n]")
NONE = np.int64(1 << 40)
#: A worker forgets its pre-tokens when it knows so many.
KNOWN = 1_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Merges:
    """The merge table of a vocabulary file: byte to symbol, and pair of symbols to (rank, symbol), by binary search."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, model = spec["model"]["vocab"], spec["model"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        letters = byte_letters()
        self.symbol = np.full(256, -1, np.int64)
        for letter, byte in letters.items():
            self.symbol[byte] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.base = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word."""
        size = np.array([len(w) for w in words], np.int64)
        out = size.copy()
        symbols = self.symbol[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        while len(symbols) > 1:
            pair = np.where(word[:-1] == word[1:], self.rank(symbols[:-1], symbols[1:]), NONE)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))  # of each word that still has symbols here
            least = np.minimum.reduceat(np.append(pair, NONE), first)
            span = np.diff(np.append(first, len(symbols)))
            hit = pair == np.repeat(least, span)[:-1]
            hit &= pair < NONE
            if hit.any():
                # in a run of hits that overlap (the same symbol again and again), every second one counts
                start = hit & ~np.append(False, hit[:-1])
                place = np.arange(len(hit))
                run = place - np.maximum.accumulate(np.where(start, place, 0))
                hit &= run % 2 == 0
                symbols = symbols.copy()
                where = np.flatnonzero(hit)
                symbols[where] = self.made[pair[where]]
                np.subtract.at(out, word[where], 1)
            live = np.repeat(least < NONE, span)  # words without a pair are done
            live[1:] &= ~hit
            symbols, word = symbols[live], word[live]
        return out


class Counter:
    """Tokens of whole texts, special strings counting as one token; remembers the pieces and pre-tokens that it has met."""

    def __init__(self, path: str):
        self.merges, self.cut, self.pieces, self.known = Merges(path), regex.compile(CUT), {}, {}
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.merges.specials, key=len, reverse=True))) if self.merges.specials else None

    def counts(self, texts: list[str], block: int = 4_000_000) -> list[int]:
        """Texts are taken about ``block`` characters at a time."""
        out: list[int] = []
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (size == 0 or size + len(texts[to]) <= block):
                size += len(texts[to])
                to += 1
            out += self._block(texts[at:to])
            at = to
        return out

    def _pieces(self, text: str) -> list[str]:
        """Pieces of an even text, whose tokens do not depend on one another: words that follow a blank, which is left off, or a
        line feed. A line feed is put before the text, so that its first word is of the second kind."""
        return ("\n" + text).replace("\n", " \n").split(" ")[1:]

    def _words(self, text: str) -> list[list[str]]:
        """Pre-tokens of any text, between its special strings."""
        parts = self.special.split(text) if self.special is not None else [text]
        return [self.cut.findall(part) for part in parts]

    def _block(self, texts: list[str]) -> list[int]:
        if len(self.pieces) > KNOWN:
            self.pieces = {}
        if len(self.known) > KNOWN:
            self.known = {}
        even = [not UNEVEN.search(t) and not any(s in t for s in self.merges.specials) for t in texts]
        pieces = [self._pieces(t) if e else [] for t, e in zip(texts, even, strict=True)]
        whole = [[] if e else self._words(t) for t, e in zip(texts, even, strict=True)]
        new = list(set().union(*pieces).difference(self.pieces))
        words = [self.cut.findall(p if p[:1] == "\n" else " " + p) for p in new]
        unmet = list(set().union(*words, *(w for parts in whole for w in parts)).difference(self.known))
        if unmet:
            self.known.update(zip(unmet, self.merges.counts([w.encode("utf-8", "surrogatepass") for w in unmet]).tolist(), strict=True))
        of, piece = self.known.__getitem__, self.pieces.__getitem__
        self.pieces.update((p, sum(map(of, w))) for p, w in zip(new, words, strict=True))
        return [
            sum(map(piece, p)) - 1 if e else len(w) - 1 + sum(sum(map(of, part)) for part in w)
            for p, w, e in zip(pieces, whole, even, strict=True)]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, row for row; ``vocabulary`` is a path that every executor can open.

    A null or empty text has no bytes and no tokens. Other columns are not read.
    """

    @F.pandas_udf(LongType())
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(counter(vocabulary).counts(part.fillna("").tolist()), dtype="int64")

    rows = docs.select(F.col(doc_id).alias("doc_id"), utf8_bytes(text).alias("n_bytes"), count(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
