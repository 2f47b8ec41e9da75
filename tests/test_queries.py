"""Every registered query of the engine against its SQL, on the smallest tables."""

import math
import os

import pytest

from meshwright.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v) if not isinstance(v, str) else v
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't there")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("part", "supplier", "events", "lineitem"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(con.execute(ORACLE_SQL[name]).fetchdf())


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
