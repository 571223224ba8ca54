"""Queries run over all days and all points of their tables."""

import os

import duckdb
from test_queries import SF

from isohyet.plans import library

def test_infill_all_days(spark):
    days = duckdb.sql(f"select date_diff('day', min(l_shipdate)::date, max(l_shipdate)::date) + 1 from '{SF}/lineitem.parquet'").fetchall()[0][0]
    got = library.queries()["ppca_infill"](spark, SF).groupBy("station_id").count().collect()
    assert got and {r["count"] for r in got} == {days}


def test_normals_at_all_points(spark, tmp_path):
    larger = "/root/testdata/sf0.01"
    for t in ("supplier", "nation"):
        os.symlink(f"{larger}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.read.parquet(f"{larger}/customer.parquet").where("c_custkey < 40").write.parquet(str(tmp_path / "customer.parquet"))
    got = library.queries()["interp_normals"](spark, str(tmp_path)).select("point_id", "month").collect()
    assert sorted(tuple(r) for r in got) == [(p, m) for p in range(40) for m in range(1, 13)]
