"""Sorted rows handed to vector code in large batches that part no group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd


def starts_group(rows: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Whether each row but the first differs from the one before it in any key."""
    new = np.zeros(len(rows), bool)
    for c in keys:
        values = rows[c].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return new


def groups(rows: pd.DataFrame, keys: Sequence[str]) -> Iterator[tuple[int, int]]:
    """First row and end of every group."""
    cuts = [0, *np.flatnonzero(starts_group(rows, keys)).tolist(), len(rows)]
    return zip(cuts[:-1], cuts[1:], strict=True)


def whole_groups(keys: Sequence[str], work: Callable[[pd.DataFrame], pd.DataFrame], most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For rows sorted by the keys: the work done on batches of about ``most`` rows, or of one group where that holds more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, need = [], 0, most
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < need:
                continue
            rows = pd.concat(held, ignore_index=True)
            cuts = np.flatnonzero(starts_group(rows, keys))
            cut = int(cuts[-1]) if len(cuts) else 0
            if cut:
                yield work(rows.iloc[:cut])
            held, n = [rows.iloc[cut:]], len(rows) - cut
            need = max(most, 2 * n)  # a group larger than a batch is not put together anew with every batch
        if n:
            yield work(pd.concat(held, ignore_index=True))

    return run
