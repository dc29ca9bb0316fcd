from collections import Counter

import duckdb
import pytest
from llm_cases import clashing, docs, odd_rows

import corpus_pipeline
from selenogrid.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "documents embeddings labels".split()


def test_stages_keep_the_columns_and_take_effect(spark):
    table = clashing(docs(spark, odd_rows() + [(200 + i, odd_rows()[12][1], "en", "src1", 1) for i in range(5)]))
    sizes, now = [], table
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, None)
        if name != "pack_lengths":
            assert out.columns == table.columns, name
        now = out
        sizes.append(out.count())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "secret_scan", "mix_sources", "pack_lengths"]
    assert sizes[0] < table.count() and sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] > 0 and sizes[4] >= sizes[3]


def test_stages_run_on_an_empty_table(spark):
    now = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, None)
        assert now.count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = QUERIES[name](spark, SMALL)
    cols = sorted(got.columns)
    a = Counter(tuple(r[c] for c in cols) for r in got.collect())
    b = Counter(tuple(r) for r in con.sql(ORACLES[name]).project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert a == b and a
