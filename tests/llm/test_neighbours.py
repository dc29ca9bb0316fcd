import numpy as np
import pytest
from pyspark.sql import functions as F

from selenogrid.llm import neighbours


def brute(rows, least=0.95):
    vec = {}
    for i, (_, v) in enumerate(rows):
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float) / np.abs(v).max()
            vec[i] = x / np.linalg.norm(x)
    near = {i: {j for j in vec if j != i and len(vec[i]) == len(vec[j]) and vec[i] @ vec[j] >= least} for i in vec}
    out = []
    for i, (name, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least_id = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((name, len(near.get(i, ())), least_id, name == least_id))
    return out


def cloud(r, centre, n, width):
    x = centre / np.linalg.norm(centre) + width * r.standard_normal((n, len(centre))) / np.sqrt(len(centre))
    return x.tolist()


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(4)
    vectors = r.standard_normal((250, 16)).tolist()
    for n, width in ((150, 0.1), (60, 0.25), (2, 0.1), (3, 0.05), (40, 0.32), (1, 0.0)):
        vectors += cloud(r, r.standard_normal(16), n, width)
    vectors += [vectors[0]] * 30 + [[2 * x for x in vectors[1]]] * 3
    a, b = r.standard_normal(16), r.standard_normal(16)
    vectors += [(a + (b - a) * t).tolist() for t in np.linspace(0, 1, 12)]  # a chain
    rows = [(i, v) for i, v in enumerate(vectors)]
    return rows + [(9001, None), (9002, [0.0] * 16), (9003, [None] + [1.0] * 15), (9004, [float("nan")] * 16), (9005, [1.0, 2.0]), (9006, [2.0, 4.0]), (9005, [1.0, 2.0]), (None, [3.0, 6.0]), (9007, []), (9008, [1e300] * 16), (9009, [1e-300] * 16)]


def test_links_and_components_match_all_pairs(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("label", F.lit(2)).withColumn("unit", F.lit("x"))
    got = [tuple(r) for r in neighbours.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()]
    want = brute(rows)
    key = lambda t: (t[0] is None, t[0] or 0, t[1])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [(g[0], g[2]) for g in got] == [(w[0], w[2]) for w in want]
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want))
    assert [bool(g[3]) for g in got if g[0] is not None] == [bool(w[3]) for w in want if w[0] is not None]


def test_a_loose_crowd_beside_single_pairs(spark):
    """Vectors of which a crowd straddles the threshold and makes no class: its lists grow, the others' do not."""
    r = np.random.default_rng(6)
    x = r.standard_normal((1200, 32))
    x[:150] = r.standard_normal(32) + 0.23 * r.standard_normal((150, 32))
    for i in range(150, 350, 2):  # pairs just over the threshold
        u = x[i] / np.linalg.norm(x[i])
        side = r.standard_normal(32)
        side -= side @ u * u
        x[i + 1] = 0.951 * u + np.sqrt(1 - 0.951**2) * side / np.linalg.norm(side)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = {w[0]: w for w in brute(rows)}
    crowd = np.mean([want[i][1] for i in range(150)])
    assert 10 < crowd < 149
    got = {g.vec_id: g for g in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i].n_links <= want[i][1] for i in want)
    assert sum(g.n_links for g in got.values()) >= 0.99 * sum(w[1] for w in want.values())
    assert sum(got[i].n_links == 1 for i in range(150, 350)) >= 198
    assert np.mean([got[i].component_id == want[i][2] for i in want]) >= 0.995
    units = np.array([v / np.linalg.norm(v) for v in x], "<f4")
    points = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(units)], "id long, x binary")
    wide = float(np.arccos(0.95))
    lists = neighbours.neighbour_lists(points, len(x), 32, wide)
    size = {row.id: len(row.near) for row in neighbours.enlarged(points, lists, len(x), float(np.cos(wide + 1e-3)), neighbours.LIST).collect()}
    assert max(size[i] for i in range(150, 1200)) == neighbours.LIST and max(size[i] for i in range(150)) > neighbours.LIST


def test_nothing_to_compare(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, neighbours.near_duplicates(df).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert neighbours.near_duplicates(df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, neighbours.near_duplicates(one).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


@pytest.mark.parametrize("n", [2_000, 51_282, 3_000_000, 30_000_000])
def test_chance_to_miss_a_pair_does_not_grow(n):
    wide = np.arccos(0.95)
    assert (1 - (1 - wide / np.pi) ** neighbours._bits(n)) ** neighbours._sketches(n, wide) <= neighbours.MISS


def test_audit_sees_lost_pairs_beside_a_crowd(spark):
    r = np.random.default_rng(2)
    one = r.standard_normal(16)
    x = np.concatenate([one + 1e-4 * r.standard_normal((200, 16)), np.repeat(r.standard_normal((40, 16)), 2, 0) + 1e-3 * r.standard_normal((80, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, i if i >= 200 else 0, bytearray(v.astype("<f8").tobytes()), 1) for i, v in enumerate(x)]
    members = spark.createDataFrame(rows, "id long, label long, unit binary, copies long")
    for between, recall in ((0, 0.0), (1, 1.0)):
        found = members.select("id", F.when(F.col("id") >= 200, between).otherwise(0).cast("long").alias("between"))
        assert neighbours._audited(members, found, len(rows), 0.95) == recall


def test_last_resort_compares_all(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((1500, 16))
    x[1300:] = x[:200] + 0.2 * r.standard_normal((200, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f4")
    heads = spark.createDataFrame([(i, bytearray(v.tobytes()), 0.0) for i, v in enumerate(x)], "label long, x binary, radius double")
    got = {tuple(p) for p in neighbours._all_pairs(heads, len(x), np.arccos(0.95)).collect()}
    i, j = np.nonzero(np.triu(x.astype(float) @ x.T.astype(float) >= 0.95, 1))
    assert len(i) > 50 and set(zip(i.tolist(), j.tolist())) <= got
