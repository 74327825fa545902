"""llm queries with SQL against it, the others for rows and columns, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from epochloom.llm import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    got = sorted((r.asDict() for r in queries.QUERIES[name](spark, FOLDER).collect()), key=repr)
    assert got
    if name in queries.SQL:
        con = duckdb.connect()
        for path in glob.glob(f"{FOLDER}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
        result = con.execute(queries.SQL[name])
        columns = [d[0] for d in result.description]
        want = sorted(({k: v for k, v in zip(columns, row, strict=True)} for row in result.fetchall()), key=lambda d: repr({k: d[k] for k in got[0]}))
        assert got == [{k: d[k] for k in got[0]} for d in want]
