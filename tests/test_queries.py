"""Every query with SQL gives on Spark what DuckDB gives on the same files."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from isohyet.plans import library

SF = "/root/testdata/sf0.001"
#: These need more stations than the smallest tables have.
LARGER = {"knn_bisquare", "ordinary_kriging", "param_weighted_avg", "gwr_weights", "ked_weights", "interp_normals", "loo_normals", "norm_outliers", "month_neighbours", "month_normals", "loo_chain"}


def folder(name: str) -> str:
    return "/root/testdata/sf0.01" if name in LARGER else SF


SQL = library.oracle_sql()


def rows(df: pd.DataFrame, columns: list[str]) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.integer, np.floating)):
            return f"{float(v):.5f}"
        return str(v)[:10] if hasattr(v, "year") else str(v)

    return sorted(tuple(one(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))


def duck(name: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in os.listdir(folder(name)):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{folder(name)}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, name):
    got, want = library.queries()[name](spark, folder(name)).toPandas(), duck(name).sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(library.queries()) - set(SQL)))
def test_runs(spark, name):
    library.queries()[name](spark, folder(name)).write.format("noop").mode("overwrite").save()
