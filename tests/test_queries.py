"""Every registered query of the core against its SQL at the smallest scale, and the shape of some plans."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from docloom import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, con, name):
    cursor = con.execute(plans.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    out = plans.QUERIES[name](spark, SF)
    assert sorted(out.columns) == sorted(columns)
    got = sorted(str(plain(list(r))) for r in out.select([f"`{c}`" for c in columns]).collect())
    assert got == sorted(str(plain(list(r))) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["topk_hybrid", "sc_fuse", "gen_fts", "fact_search", "concept_terms"])
def test_plans_stay_in_the_engine(spark, name):
    text = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "Python" not in text and "Pandas" not in text


def test_chunks_respect_their_limits(spark):
    rows = plans.QUERIES["chunk_txt"](spark, SF).collect()
    assert all(r.tokens <= 780 or r.line_start == r.line_end for r in rows)
    bundles = plans.QUERIES["norm_txt"](spark, SF).collect()
    assert all(r.tokens <= 460 or len(r.ids) == 1 for r in bundles)
    ids = [i for r in bundles for i in r.ids]
    assert len(ids) == len(set(ids))
