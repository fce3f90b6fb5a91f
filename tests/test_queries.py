"""Every core query beside its DuckDB SQL at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from emberscan.plans import registry

SF = "/root/testdata/sf0.001"


def _rows(df):
    cols = sorted(df.columns)
    out = []
    for r in df[cols].astype(object).itertuples(index=False):
        out.append(tuple("-" if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r))
    return cols, sorted(out)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"create view events as select * from read_parquet('{SF}/events.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    got = registry.queries()[name](spark, SF)
    if name not in registry.oracle_sql():
        assert got.count() > 0
        return
    assert _rows(got.toPandas()) == _rows(con.execute(registry.oracle_sql()[name]).df())


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
