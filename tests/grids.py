"""Small grids as cell tables, and plain NumPy answers to compare with."""

import heapq
import math

import numpy as np
import pandas as pd

GEOM = {"resolution_m": 60.0, "origin_x": 0.0, "origin_y": 0.0}


def cells(spark, regions):
    """``regions``: name to a dict of equally shaped arrays; NaN becomes NULL."""
    frames = []
    for name, layers in regions.items():
        shape = next(iter(layers.values())).shape
        rr, cc = np.indices(shape)
        data = {"region": name, "height": shape[0], "width": shape[1], **GEOM, "row": rr.ravel(), "col": cc.ravel()}
        data |= {k: np.asarray(v, dtype=float).ravel() for k, v in layers.items()}
        frames.append(pd.DataFrame(data))
    pdf = pd.concat(frames)
    names = list(next(iter(regions.values())))
    schema = "region string, height int, width int, resolution_m double, origin_x double, origin_y double, row int, col int, " + ", ".join(
        f"{n} double" for n in names)
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in pdf.itertuples(index=False, name=None)]
    return spark.createDataFrame(rows, schema)


def grid(df, name, shape, region=None):
    pdf = df.toPandas()
    if region:
        pdf = pdf[pdf["region"] == region]
    out = np.full(shape, np.nan)
    out[pdf["row"], pdf["col"]] = pdf[name].astype(float)
    return out


def box(a, size, fold):
    lo, hi = size // 2, size - 1 - size // 2
    p = np.pad(a, ((lo, hi), (lo, hi)), mode="symmetric")
    return np.array([[fold(p[i:i + size, j:j + size]) for j in range(a.shape[1])] for i in range(a.shape[0])])


def dijkstra(cost, start):
    g = {start: 0.0}
    heap = [(0.0, start)]
    while heap:
        d, (r, c) = heapq.heappop(heap)
        if d > g[(r, c)]:
            continue
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                n = (r + dr, c + dc)
                if (dr or dc) and 0 <= n[0] < cost.shape[0] and 0 <= n[1] < cost.shape[1] and np.isfinite(cost[n]):
                    nd = d + cost[n] * (math.sqrt(2) if dr and dc else 1.0)
                    if nd < g.get(n, math.inf):
                        g[n] = nd
                        heapq.heappush(heap, (nd, n))
    return g


def dbscan(x, eps, m):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = d <= eps
    core = near.sum(1) >= m
    label = np.where(core, np.arange(len(x)), -1)
    while True:
        best = label.copy()
        for i in np.flatnonzero(core):
            best[i] = label[near[i] & core].min()
        if (best == label).all():
            break
        label = best
    for i in np.flatnonzero(~core):
        reach = near[i] & core
        if reach.any():
            label[i] = label[reach].min()
    return label
