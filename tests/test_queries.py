"""Every registered query runs over its whole tables and, where SQL can express it, equals its SQL on DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from tessitura.plans import catalogue, catalogue_analysis, catalogue_document, catalogue_library, catalogue_notation, catalogue_sources  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or not isinstance(v, (list, tuple, dict)) and not hasattr(v, "shape") and pd.isna(v):
            return None
        return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(cell(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
