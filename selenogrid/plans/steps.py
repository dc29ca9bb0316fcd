"""Checking SQL shared by several queries: the grid, its derivatives, and brute-force neighbourhoods."""

from __future__ import annotations

from selenogrid.plans.registry import cte
from selenogrid.sources.demo_grid import COL, LAYERS, ORDERS_PER_REGION, REGION, ROW

cte("regions", f"""
SELECT 'R' || CAST(k AS VARCHAR) AS region, 64 AS height, 64 AS width, CAST(600 AS DOUBLE) AS resolution_m,
  CAST(-20000 AS DOUBLE) AS origin_x, CAST(150000 - 38400 * (k % 4) AS DOUBLE) AS origin_y
FROM (SELECT DISTINCT CAST(floor(l_orderkey / {ORDERS_PER_REGION}) AS INT) AS k FROM lineitem)""")
cte("sparse", f"""
SELECT {REGION} AS region, {ROW} AS row, {COL} AS col, {", ".join(f"{t} AS {n}" for n, t in LAYERS.items())}
FROM lineitem GROUP BY 1, 2, 3""")
cte("cells", f"""
SELECT g.*, {", ".join(f"s.{n}" for n in LAYERS)}
FROM (SELECT r.*, CAST(i AS INT) AS row, CAST(j AS INT) AS col
      FROM regions r, range(64) a(i), range(64) b(j)) g
LEFT JOIN sparse s USING (region, row, col)""", ["regions", "sparse"])


def mirror(pos: str, n: str) -> str:
    """Index of ``pos`` after reflection at both edges (the edge cell repeats)."""
    return f"(CASE WHEN (({pos}) % (2*{n}) + 2*{n}) % (2*{n}) < {n} THEN (({pos}) % (2*{n}) + 2*{n}) % (2*{n}) " \
           f"ELSE 2*{n} - 1 - (({pos}) % (2*{n}) + 2*{n}) % (2*{n}) END)"


def box_sql(src: str, size: int, exprs: dict[str, tuple[str, str]], by: str = "region", keep: str = "") -> str:
    """Brute-force box: every offset looked up by reflected index, one axis after the other.

    ``exprs`` maps an output to (how, expression); averages carry a sum and a count through both axes.
    """
    lo, hi = size // 2, size - 1 - size // 2
    inner, mid, outer = [], [], []
    for out, (how, e) in exprs.items():
        inner.append(f"{e} AS v_{out}")
        if how == "avg":
            mid.append(f"sum(b.v_{out}) AS s_{out}, count(b.v_{out}) AS n_{out}")
            outer.append(f"sum(b.s_{out}) / nullif(sum(b.n_{out}), 0) AS {out}")
        else:
            mid.append(f"{how}(b.v_{out}) AS s_{out}")
            outer.append(f"{how}(b.s_{out}) AS {out}")
    keys = [k.strip() for k in by.split(",")]
    sel = ", ".join(f"a.{k}" for k in keys)
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    names = ", ".join([f"s_{o}" + (f", n_{o}" if h == "avg" else "") for o, (h, _) in exprs.items()])
    return f"""
WITH src AS MATERIALIZED (SELECT {by}, height, width, row, col, {", ".join(inner)} FROM {src}),
pos AS MATERIALIZED (SELECT {by}, height, width, row, col FROM src),
across AS MATERIALIZED (
  SELECT {sel}, a.height, a.width, a.row, a.col, {", ".join(mid)}
  FROM (SELECT pos.*, {mirror("col + d", "width")} AS cc FROM pos, range(-{lo}, {hi + 1}) o(d)) a
  JOIN src b ON {on} AND a.row = b.row AND a.cc = b.col GROUP BY ALL)
SELECT {sel}, a.row, a.col, {", ".join(outer)}
FROM (SELECT {by}, row, col, {mirror("row + d", "height")} AS rr FROM pos, range(-{lo}, {hi + 1}) o(d)) a
JOIN across b ON {on} AND a.col = b.col AND a.rr = b.row GROUP BY ALL"""


def edge_sql(src: str, value: str, scale: str, by: str = "region") -> str:
    """Centred differences, one-sided at the edges, by looking the four neighbours up."""
    on = " AND ".join(f"{{0}}.{k.strip()} = c.{k.strip()}" for k in by.split(","))
    sel = ", ".join(f"c.{k.strip()}" for k in by.split(","))
    return f"""
WITH v AS MATERIALIZED (SELECT {by}, height, width, {scale} AS h, row, col, {value} AS x FROM {src})
SELECT {sel}, c.row, c.col,
  CASE WHEN c.col = 0 THEN (e.x - c.x) / c.h WHEN c.col = c.width - 1 THEN (c.x - w.x) / c.h
       ELSE (e.x - w.x) / (2 * c.h) END AS dx,
  CASE WHEN c.row = 0 THEN (s.x - c.x) / c.h WHEN c.row = c.height - 1 THEN (c.x - n.x) / c.h
       ELSE (s.x - n.x) / (2 * c.h) END AS dy
FROM v c LEFT JOIN v w ON {on.format("w")} AND w.row = c.row AND w.col = c.col - 1
LEFT JOIN v e ON {on.format("e")} AND e.row = c.row AND e.col = c.col + 1
LEFT JOIN v n ON {on.format("n")} AND n.col = c.col AND n.row = c.row - 1
LEFT JOIN v s ON {on.format("s")} AND s.col = c.col AND s.row = c.row + 1"""


cte("edges", edge_sql("cells", "elevation", "resolution_m"), ["cells"])
cte("filled", """
SELECT c.*, coalesce(elevation, avg(elevation) OVER (PARTITION BY region)) - avg(elevation) OVER (PARTITION BY region) AS z
FROM cells c""", ["cells"])
cte("rough", box_sql("filled", 3, {"m": ("avg", "z"), "q": ("avg", "z * z")}), ["filled"])
cte("terrain", """
SELECT c.*, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope,
  CASE WHEN c.elevation IS NOT NULL AND NOT (dx = 0 AND dy = 0)
       THEN degrees(atan2(dx, -dy)) + CASE WHEN atan2(dx, -dy) < 0 THEN 360 ELSE 0 END END AS aspect,
  CASE WHEN c.elevation IS NOT NULL THEN sqrt(greatest(q - m * m, 0)) END AS roughness
FROM cells c JOIN edges e USING (region, row, col) JOIN rough r USING (region, row, col)""", ["cells", "edges", "rough"])


def lon_sql(row: str = "row", col: str = "col", at: float = 0.5) -> str:
    return f"degrees(atan2(origin_x + ({col} + {at}) * resolution_m, origin_y - ({row} + {at}) * resolution_m))"


def lat_sql(row: str = "row", col: str = "col", at: float = 0.5) -> str:
    x, y = f"(origin_x + ({col} + {at}) * resolution_m)", f"(origin_y - ({row} + {at}) * resolution_m)"
    return f"(-90 + 2 * degrees(atan(sqrt({x} * {x} + {y} * {y}) / (2 * 1737400.0::DOUBLE))))"


def cell_sql(lon: str, lat: str) -> tuple[str, str]:
    """Unrounded row and column of a coordinate."""
    rho = f"(2 * 1737400.0::DOUBLE * tan(radians(45 + ({lat}) / 2)))"
    return (f"((origin_y - {rho} * cos(radians({lon}))) / resolution_m)",
            f"(({rho} * sin(radians({lon})) - origin_x) / resolution_m)")


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (f"(2 * 1737.4::DOUBLE * asin(sqrt(least(1, sin(radians({lat2} - {lat1}) / 2) ** 2 + cos(radians({lat1})) * "
            f"cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2) ** 2))))")
