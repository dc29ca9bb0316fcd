"""Fill-in-middle transformation: texts are cut in three at token bounds and put together in another order.

Where the tokens of a text end is found chunk by chunk. A rolling hash of the last 32 bytes cuts each text into chunks wherever the
hash says so, so a passage that texts share falls into the same chunks wherever it stands. A worker keeps, by the chunk's content, a
summary of its bounds: token ends inside, code points, whether it starts with white space and whether it ends within a word.
A chunk met again is looked up and not read. Summaries add up along a text: a word that ends with its chunk is complete if the next
chunk starts with white space or there is none. Running sums of the token ends give the chunk of each cut, and only that chunk is
looked into.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selenogrid.llm.base import batches

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The hash takes so many bytes; a chunk ends where its highest bits are zero, so 2^BITS bytes is the mean, and at MOST bytes at the latest.
WINDOW, BITS, MOST = 32, 8, 8192
#: A worker forgets its chunks when it keeps so many bytes of them.
KEPT = 48_000_000
GEAR = np.random.RandomState(42).randint(0, 2**32, 256, np.uint64).astype(np.uint32)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def chunk_ends(raw: np.ndarray, ends: np.ndarray, block: int = 1_000_000) -> np.ndarray:
    """Where the chunks of some texts end: ``raw`` holds the texts' bytes one after another, ``ends`` is where each ends. Each byte is in one
    chunk, no chunk is empty and none crosses the end of a text."""
    found = []
    for at in range(0, len(raw), block):
        from_ = max(0, at - WINDOW + 1)
        h = GEAR[raw[from_ : at + block]]
        for k in (1, 2, 4, 8, 16):
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        found.append(np.flatnonzero((h >> np.uint32(32 - BITS))[at - from_ :] == 0) + at)
    last = np.concatenate(found) if found else np.zeros(0, np.int64)
    # the window must lie inside the text, or the bounds would depend on the text before
    start = np.append(0, ends)[np.searchsorted(ends, last, side="right")]
    out = np.union1d(last[last - start >= WINDOW - 1] + 1, ends[ends > 0])
    size = np.diff(np.append(0, out))
    parts = -(-size // MOST)
    if (parts > 1).any():
        before = np.repeat(out - size, parts)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts) + 1
        out = np.minimum(before + nth * MOST, np.repeat(out, parts))
    return out


class Memo:
    """Summaries of chunks by content: token ends inside, code points, starts with white space, ends within a word."""

    def __init__(self, kept: int = KEPT):
        self.most, self.bytes, self.row, self.table = kept, 0, {}, np.zeros((0, 4), np.int64)

    def rows(self, chunks: list[bytes]) -> np.ndarray:
        """The summary of each chunk; those not met before are read, all in one pass."""
        if self.bytes > self.most:
            self.bytes, self.row, self.table = 0, {}, self.table[:0]
        new = list(set(chunks).difference(self.row))
        if new:
            self.row.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, self._read(new)])
            self.bytes += sum(map(len, new))
        return self.table[np.fromiter(map(self.row.__getitem__, chunks), np.int64, len(chunks))]

    @staticmethod
    def _read(chunks: list[bytes]) -> np.ndarray:
        raw = np.frombuffer(b"".join(chunks), np.uint8)
        end = np.cumsum([len(c) for c in chunks])
        start = np.append(0, end[:-1])
        space = SPACE[raw]
        word_end = np.append(~space[:-1] & space[1:], False)
        word_end[end - 1] = False
        chars = (raw & 0xC0) != 0x80
        return np.stack([np.add.reduceat(word_end, start, dtype=np.int64), np.add.reduceat(chars, start, dtype=np.int64), space[start], ~space[end - 1]], axis=1).astype(np.int64)


_MEMO = Memo()


class Cutter:
    """Tokens and cuts of a block of texts, from the summaries of their chunks. ``starts`` and ``ends`` are in bytes of ``raw``."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, memo: Memo):
        self.raw, self.starts, self.ends = raw, offsets[:-1], offsets[1:]
        self.to = chunk_ends(raw, self.ends)
        self.at = np.append(0, self.to[:-1]) if len(self.to) else self.to
        whole = raw.tobytes()
        rows = memo.rows([whole[a:b] for a, b in zip(self.at.tolist(), self.to.tolist(), strict=True)])
        inside, chars, spaced, open_ = rows.T if len(rows) else np.zeros((4, 0), np.int64)
        closes = np.isin(self.to, self.ends) | (np.append(spaced[1:], 1) == 1)
        self.inside, self.total = inside, inside + (open_ * closes)
        self.sums, self.chars = np.append(0, np.cumsum(self.total)), np.append(0, np.cumsum(chars))
        # chunks of each text: first to last
        self.first, self.last = np.searchsorted(self.at, self.starts), np.searchsorted(self.to, self.ends, side="right")
        words = self.sums[self.last] - self.sums[self.first]
        trailing = (self.ends > self.starts) & (np.append(open_, 1)[self.last - 1] == 0)
        self.words, self.n = words, words + trailing

    def cut(self, text: int, k: int) -> tuple[int, int]:
        """Where the first ``k`` tokens of a text end: in bytes of ``raw``, and in code points from the text's start."""
        base = self.chars[self.first[text]]
        if k == 0:
            return int(self.starts[text]), 0
        if k > self.words[text]:
            return int(self.ends[text]), int(self.chars[self.last[text]] - base)
        want = self.sums[self.first[text]] + k
        c = int(np.searchsorted(self.sums, want)) - 1  # the first chunk whose running sum reaches it
        nth = int(want - self.sums[c])
        if nth > self.inside[c]:
            return int(self.to[c]), int(self.chars[c + 1] - base)
        part = self.raw[self.at[c] : self.to[c]]
        space = SPACE[part]
        off = int(np.flatnonzero(~space[:-1] & space[1:])[nth - 1]) + 1
        return int(self.at[c]) + off, int(self.chars[c] - base + np.count_nonzero((part[:off] & 0xC0) != 0x80))


def _infill(block: pa.RecordBatch, rate: int, spm: int) -> pa.RecordBatch:
    texts = pc.fill_null(block.column("_text"), "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    cutter = Cutter(raw, offsets - offsets[0], _MEMO)
    whole = raw.tobytes()
    h1, h2, h3, h4 = (block.column(f"h{i}").to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))
    a, b = h1 % (cutter.n + 1), h2 % (cutter.n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks
    forms, outs, prefix, middle = [], [], [], []
    for i, (start, end) in enumerate(zip(cutter.starts.tolist(), cutter.ends.tolist(), strict=True)):
        text = whole[start:end]
        if not text or h3[i] % 100 >= rate or any(mark in text for mark in marks):
            forms.append("plain")
            outs.append(text)
            prefix.append(None)
            middle.append(None)
            continue
        (x, cx), (y, cy) = cutter.cut(i, int(low[i])), cutter.cut(i, int(high[i]))
        one, two, three = whole[start:x], whole[x:y], whole[y:end]
        forms.append("spm" if h4[i] % 100 < spm else "psm")
        outs.append(b"".join([s, three, p, one, m, two] if forms[-1] == "spm" else [p, one, s, three, m, two]))
        prefix.append(cx)
        middle.append(cy - cx)
    return pa.RecordBatch.from_arrays(
        [block.column("doc_id"), pa.array(cutter.n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(outs, pa.binary()).cast(pa.string())],
        ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)``, row for row; other columns are not read.

    ``n`` counts tokens: a word with the white space before it, or white space at the end. Of 100 documents ``rate`` are cut in three, by seeded
    hashes of the id, at two token bounds; of 100 cut ones ``spm`` have the suffix first. A text that is null or empty, or that holds
    one of the marks, stays plain, its lengths null. Rows with the same id are cut by the same hashes; a null id counts as ''.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text"), digest.alias("_h"))
    parts = [F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in batches(table, text="_text"):
            yield _infill(block, rate, spm)

    return rows.select("doc_id", "_text", *parts).mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column | str, form: Column | str) -> Column:
    """The text that an output of ``transform`` was made from. A mark cannot arise where a text meets a mark, so the first one of each is it."""
    whole, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = (F.instr(whole, mark) for mark in (PREFIX, SUFFIX, MIDDLE))

    def part(from_: Column, to: Column) -> Column:
        return F.substr(whole, from_ + 3, to - from_ - 3)

    end = F.length(whole) + 1
    psm = F.concat(part(p, s), part(m, end), part(s, m))
    spm = F.concat(part(p, m), part(m, end), part(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(whole)
