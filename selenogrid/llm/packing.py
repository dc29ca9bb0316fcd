"""Padded batches from optimal length buckets.

Documents longer than the longest sequence are cut into pieces, so lengths are bounded and their histogram over all
documents is a table of at most that many rows, however large the corpus. Dynamic programming over it finds the bucket
widths that pad least. Inside a bucket, pieces in a seeded order fill batches of as many rows as the token budget holds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selenogrid.llm.base import ranked, spread
from selenogrid.session import write_table

RANGES = 4096


def widths(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> list[int]:
    """Ascending bucket widths, at most ``buckets``, with the least total padding; the last is the greatest length.

    ``lengths`` ascend. Of equal solutions, the one with the fewest buckets and the smallest widths is returned.
    """
    x, n = np.asarray(lengths, np.float64), np.concatenate([[0], np.cumsum(np.asarray(counts, np.float64))])
    if not len(x):
        return []
    best = x * n[1:]  # tokens with padding of lengths 0..j in one bucket; what is not padding is the same for all
    back, reach = [], best
    for _ in range(1, min(buckets, len(x))):
        # the last bucket takes lengths i+1..j
        cost, cut = reach.copy(), np.full(len(x), -1)
        for j in range(1, len(x)):
            with_last = best[:j] + x[j] * (n[j + 1] - n[1 : j + 1])
            i = int(np.argmin(with_last))
            if with_last[i] < cost[j]:
                cost[j], cut[j] = with_last[i], i
        if (cut < 0).all():
            break
        back.append(cut)
        best = reach = cost
    out, j = [len(x) - 1], len(x) - 1
    for cut in reversed(back):
        if cut[j] >= 0:
            j = int(cut[j])
            out.append(j)
    return [int(x[j]) for j in reversed(out)]


def pieces(docs: DataFrame, length: Column, longest: int, doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, piece, start, n_tokens)``: runs of at most ``longest`` tokens that cover each document whole.

    A document without tokens (or of null length) is one piece of length 0.
    """
    n = F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0)).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), n.alias("_n"))
    last = F.greatest(F.expr(f"(_n - 1) div {longest}"), F.lit(0)).cast("int")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece").cast("long") * longest
    return rows.select("doc_id", "piece", start.alias("start"), F.least(F.col("_n") - start, F.lit(longest)).cast("int").alias("n_tokens"))


def pack(docs: DataFrame, length: Column, longest: int = 2048, buckets: int = 8, batch_tokens: int = 65536, seed: int = 42, doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, piece, start, n_tokens, width, batch, slot)``: the row ``slot`` of batch ``batch`` of the bucket ``width``
    holds tokens start to start + n_tokens of a document, padded to width.

    A batch has floor(batch_tokens / width) rows (at least 1), the last of a bucket may have fewer. Documents without tokens take
    no room: their width, batch and slot are null. Repeated rows are packed as often as they occur.
    """
    rows = write_table(pieces(docs, length, longest, doc_id), "pieces")
    counts = rows.filter("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").collect()  # at most ``longest`` rows
    chosen = widths([r.n_tokens for r in counts], [r.n for r in counts], buckets)
    if not chosen:
        return rows.withColumns({"width": F.lit(None).cast("int"), "batch": F.lit(None).cast("long"), "slot": F.lit(None).cast("int")})
    width = F.lit(chosen[-1])
    for w in reversed(chosen[:-1]):
        width = F.when(F.col("n_tokens") <= w, w).otherwise(width)
    full = rows.filter("n_tokens > 0").withColumn("width", width).withColumn("h", spread(seed, "doc_id", "piece"))
    full = ranked(full, ["width"], F.shiftright("h", 48).cast("int"), ["h", "doc_id", "piece", "n_tokens"], RANGES)
    per = F.greatest(F.expr(f"{batch_tokens} div width"), F.lit(1))
    full = full.withColumn("per", per).select("doc_id", "piece", "start", "n_tokens", "width", F.expr("rank div per").cast("long").alias("batch"), F.expr("rank % per").cast("int").alias("slot"))
    empty = rows.filter("n_tokens = 0").select("*", F.lit(None).cast("int").alias("width"), F.lit(None).cast("long").alias("batch"), F.lit(None).cast("int").alias("slot"))
    return full.unionByName(empty)
