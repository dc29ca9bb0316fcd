import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def test_every_check_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 100


def test_flagship_has_ranked_sites(spark):
    rows = entry(spark).collect()
    assert rows and all(1 <= r["rank"] <= 10 and 0 < r["final"] <= 1 for r in rows)
    by = {}
    for r in rows:
        for other in by.setdefault(r["mission_id"], []):
            assert (other["row"] - r["row"]) ** 2 + (other["col"] - r["col"]) ** 2 >= 100
        by[r["mission_id"]].append(r)


def key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


@pytest.mark.parametrize("name", ["score_terrain", "sites_top", "decode_layers", "validate_missions", "recharge_stops"])
def test_matches_sql(spark, duck, name):
    got = queries()[name](spark, SMALL)
    cols = sorted(got.columns)
    a = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key)
    rel = duck.sql(oracle_sql()[name])
    b = sorted((tuple(r) for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=key)
    assert a == b


def test_pairs_of_a_small_file_are_spread(spark, monkeypatch):
    found = queries()
    from selenogrid.plans import grid_queries

    monkeypatch.setattr(grid_queries, "PAIRS_IN_TASK", 10, raising=False)
    assert found["great_circle"](spark, SMALL).rdd.getNumPartitions() > 1


def test_landmarks_do_not_score_every_cell(spark, duck):
    assert queries()
    from selenogrid.plans import eval_queries
    from selenogrid.plans.workspace import Workspace

    ws = Workspace(spark, SMALL)
    for name in ("best_and_worst_landmark", "planned_and_actual"):
        got = getattr(eval_queries, name)(ws)
        cols = sorted(got.columns)
        a = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key)
        rel = duck.sql(oracle_sql()[name])
        assert a == sorted((tuple(r) for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=key)
    assert "scores" not in ws._tables


@pytest.mark.parametrize("module, name, unread", [
    ("route_queries", "path_energy", "scores"), ("route_queries", "recharge_totals", "scores"), ("eval_queries", "class_folds", "varied"),
    ("site_queries", "distance_to_shadow_uncut", "decoded"), ("site_queries", "distance_across_tiles", "decoded"), ("cluster_queries", "standardize", "layers"),
    ("site_queries", "sites_requested", "scores"), ("site_queries", "sites_top", "scores"), ("route_queries", "route_costs", "scores"),
    ("route_queries", "route_chosen_goal", "scores")])
def test_only_tables_that_a_query_needs_are_built(spark, duck, module, name, unread):
    assert queries()
    from selenogrid import plans
    from selenogrid.plans.workspace import Workspace

    ws = Workspace(spark, SMALL)
    got = getattr(getattr(plans, module), name)(ws)
    cols = sorted(got.columns)
    a = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key)
    rel = duck.sql(oracle_sql()[name])
    assert a == sorted((tuple(r) for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=key)
    assert unread not in ws._tables


def test_long_methods_are_not_left_to_the_interpreter(spark):
    from selenogrid.plans.workspace import Workspace

    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    Workspace(spark, SMALL)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_a_region_of_downsampled_cells_is_one_file(spark):
    assert queries()
    from selenogrid.plans import grid_queries
    from selenogrid.plans.workspace import Workspace

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = grid_queries.write_downsampled(Workspace(spark, SMALL)).inputFiles()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(files) == len({f.rsplit("/", 2)[1] for f in files})


def test_the_forest_passes_over_the_cells_of_sites_only(spark):
    assert queries()
    from selenogrid.operators import classify, sites
    from selenogrid.plans import site_queries
    from selenogrid.plans.workspace import Workspace

    ws = Workspace(spark, SMALL)
    ws._forest = classify.train(ws.labelled, trees=3, depth=4)
    got = site_queries.sites_rerank_by_forest(ws).select("mission_id", "rank", "cls", "new_rank")
    whole = sites.rerank_by_class(ws.sites, classify.predict(ws.forest, ws.labelled).select("region", "row", "col", "cls"))
    assert got.count() and sorted(got.collect()) == sorted(whole.select("mission_id", "rank", "cls", "new_rank").collect())
    assert "predicted" not in ws._tables
