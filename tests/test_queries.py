"""Every catalogued query against its oracle SQL on the smallest tables."""

import os

import duckdb
import pytest

from patchweave import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def canon(df):
    plain = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    cols = sorted(df.columns)
    return cols, sorted(tuple(str(plain(v)) for v in row) for row in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in catalog.ORACLES:
        assert canon(got) == canon(duck.sql(catalog.ORACLES[name]).df())


def test_selection_plan(spark):
    from patchweave.plans import selection
    from patchweave.sources import adapters

    grid = adapters.grid(spark, SF)
    for config in (selection.Config(), selection.Config(event_bins=4), selection.Config(selector="diverse_mixed")):
        chosen, placed = selection.select_patches(grid, config)
        assert chosen.groupBy("video", "group_idx").count().filter("count > 48").count() == 0 and placed.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(catalog.ORACLES) <= set(__spark_entry__.oracle_sql()) and set(catalog.QUERIES) <= set(__spark_entry__.queries())
