"""Every query with an oracle gives what DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from fundflow import queries as core

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = core.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = con.execute(core.oracle_sql()[name])
    names = [c[0] for c in got.description]
    want = [tuple(r[names.index(c)] for c in cols) for r in got.fetchall()]
    assert sorted(names) == cols
    near = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted(repr([near(v) for v in r]) for r in df.select(*cols).collect()) == sorted(repr([near(v) for v in r]) for r in want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(core.oracle_sql()) <= set(core.queries())
