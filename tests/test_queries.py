"""Every core query against its SQL over the smallest tables."""

import glob
import os

import duckdb
import pytest

from epochloom.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def canon(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, int | float):
        return round(float(value), 9) + 0.0
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = df.collect()
    if name not in registry.SQL:
        assert df.columns
        return
    result = duck.execute(registry.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, result.fetchall())


def test_names():
    assert set(registry.SQL) <= set(registry.QUERIES) and registry.FLAGSHIP in registry.QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_scans_are_pruned_and_pushed(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    spark.conf.set("spark.sql.debug.maxToStringFields", "200")
    plan = plan_of(registry.QUERIES["filtered_sums"](spark, FOLDER))
    assert "EqualTo(stager,gssc)" in plan and "IsNotNull(electrode)" in plan
    assert "loaded_at" not in plan and "el_10_20" not in plan
    plan = plan_of(registry.QUERIES["electrode_variance"](spark, FOLDER))
    assert "loaded_at" not in plan and "continuous_run_id" not in plan


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_changes_shuffle_once_per_grouping(spark):
    """Rows are made distinct, then grouped by entity: no join of the table with itself."""
    plan = plan_of(registry.QUERIES["within_changes"](spark, FOLDER))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2
