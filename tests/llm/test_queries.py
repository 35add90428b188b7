"""Queries of the text operators against their SQL, and all of them run."""

import os

import duckdb
import pytest

from lectern.llm.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted([tuple(r[c] for c in cols) for r in df.collect()], key=repr)
    if "op1_" not in name and "op5_" not in name and "op9_" not in name:
        assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        cur = con.execute(ORACLES[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert rows == sorted([tuple(r[i] for i in at) for r in cur.fetchall()], key=repr)
