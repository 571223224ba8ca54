"""What the findings of round 3 were about, on small inputs."""

import os
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from isohyet.functions import kernels, scalars, stats
from isohyet.operators import interp, spatial
from isohyet.plans import library
from tests.test_queries import rows


def test_hundredths_of_ties(spark):
    """Both are a hair below a tie as decimals, but ties as products (as in SQL)."""
    x = spark.createDataFrame([(891.8 / 40,), (6718.2 / 40,), (22.285,), (-22.295,), (1e9,), (None,)], "x double")
    assert [r[0] for r in x.select(scalars.pack(F.col("x"))).collect()] == [2230, 16796, 2228, -2230, None, None]


def test_leave_one_out_beside_others(spark):
    """Other stations at the very place count, or not, as asked; the station never does."""
    r = np.random.default_rng(8)
    place = [tuple(map(float, p)) for p in r.uniform(0, 3, (12, 2))]
    s = spark.createDataFrame([(i, *place[i % 12], float(r.uniform())) for i in range(24)], "station_id int, lon double, lat double, elev double")
    v = s.select("station_id", F.lit(1).alias("month"), F.when(F.col("station_id") < 12, 1.0).otherwise(5.0).alias("value"))
    for drop in (True, False):
        near = interp.nearest(s.withColumn("point_id", F.col("station_id")), s, 8, drop_zero=drop, others=True)
        z = interp.gwr_weights(s.withColumn("point_id", F.col("station_id")), near, s)
        want = {x.point_id: x.value for x in interp.apply_weights(z, v, "z", ["month"]).collect()}
        got = interp.leave_one_out(s, v, 8, drop_zero=drop).collect()
        assert {x.station_id: x.pred for x in got} == pytest.approx(want) and near.where("point_id = station_id").isEmpty()
        assert near.where("dist_km = 0").isEmpty() == drop
        m = v.select("station_id", "month", F.col("value").alias("norm"), F.sin("station_id").alias("lst"))
        e = {x.station_id: x.err for x in interp.normal_errors(s, m, 8, drop_zero=drop).where("month = 1").collect()}
        assert len(e) == 24 and np.isfinite(list(e.values())).all()


def test_regression_of_nearly_collinear_neighbours():
    """Four places almost in a line: the exact solution in fractions."""
    t = np.array([0.0, 1.0, 2.0, 3.5])
    f, f0 = np.column_stack([t, 2 * t + np.array([0, 3e-7, -2e-7, 1e-7])]), np.array([1.2, 2.40001])
    w, y = np.array([0.96, 0.71, 0.28, 0.013]), np.array([7379.0, -120.0, 4500.0, 9000.0])
    x = [[Fraction(1), Fraction(a), Fraction(b)] for a, b in f.tolist()]
    a = [[sum(Fraction(g) * r[i] * r[j] for g, r in zip(w.tolist(), x, strict=True)) for j in range(3)] + [sum(Fraction(g) * r[i] * Fraction(v) for g, r, v in zip(w.tolist(), x, y.tolist(), strict=True))] for i in range(3)]
    for i in range(3):
        a[i] = [v / a[i][i] for v in a[i]]
        a = [r if k == i else [p - r[i] * q for p, q in zip(r, a[i], strict=True)] for k, r in enumerate(a)]
    want = float(a[0][3] + a[1][3] * Fraction(f0[0].item()) + a[2][3] * Fraction(f0[1].item()))
    z, deficient = kernels.gwr_weights(f[None], f0[None], w[None])
    assert not deficient[0] and z[0] @ y == pytest.approx(want, rel=1e-6)


def test_constant_series(spark):
    """Correlations of constant series are null, not an error."""
    x = spark.createDataFrame([(1, 2.0, 1.0), (1, 2.0, 3.0), (2, 1.0, 2.0), (2, 3.0, 6.0), (2, None, 9.0), (3, 4.0, 4.0), (4, 1.0, 5.0), (4, 3.0, 5.0)], "k int, obs double, pred double")
    e = {r.k: (r.mae, r.bias, r.r2) for r in x.groupBy("k").agg(*stats.errors()).collect()}
    assert e == {1: (1.0, 0.0, None), 2: (2.0, 2.0, pytest.approx(1.0)), 3: (0.0, 0.0, None), 4: (3.0, 3.0, None)}
    m = {r.k: (r.slope, r.intercept, r.r) for r in x.groupBy("k").agg(*stats.linear_model("pred", "obs")).collect()}
    assert m == {1: (0.0, 2.0, None), 2: (pytest.approx(0.5), pytest.approx(0.0), pytest.approx(1.0)), 3: (None, None, None), 4: (None, None, None)}
    assert x.withColumn("r", stats.correlation("obs", "pred", Window.partitionBy("k"))).where("r is not null").count() == 3


@pytest.fixture(scope="module")
def flat(tmp_path_factory):
    """Small tables with one quantity for all rows of most nations."""
    d, src = tmp_path_factory.mktemp("flat"), "/root/testdata/sf0.01"
    for f in os.listdir(src):
        if f != "lineitem.parquet":
            os.symlink(f"{src}/{f}", d / f)
    duckdb.sql(f"copy (select l.* replace (case when s_nationkey < 20 then 1 else l_quantity end as l_quantity) from '{src}/lineitem.parquet' l join '{src}/supplier.parquet' on l_suppkey = s_suppkey) to '{d}/lineitem.parquet' (format parquet)")
    return str(d)


def _as_in_sql(spark, d, name):
    c = duckdb.connect()
    for f in os.listdir(d):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{d}/{f}'")
    want = c.sql(library.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    got = rows(library.queries()[name](spark, d).toPandas(), columns)
    assert got and got == rows(want, columns)


@pytest.mark.parametrize("name", ["error_metrics", "linreg_neighbors"])
def test_constant_series_as_in_sql(spark, flat, name):
    _as_in_sql(spark, flat, name)


def test_constant_months_as_in_sql(spark, flat):
    _as_in_sql(spark, flat, "infill_with_statistics")


def test_variogram_of_places(spark):
    """Stations at one place counted together give what all pairs give."""
    r = np.random.default_rng(3)
    place = r.uniform(0, 3, (15, 2)).tolist()
    s = spark.createDataFrame([(i, *place[i % 15], float(v)) for i, v in enumerate(r.normal(1e4, 1, 60))], "station_id int, lon double, lat double, r double")
    want = {x.bin: x[1:] for x in interp.variogram_bins(s, spatial.station_pairs(s, 300.0), 25.0).collect()}
    got = {x.bin: x[1:] for x in interp.variogram_bins_of_places(s, 300.0, 25.0).collect()}
    assert want.keys() == got.keys() and all(got[b] == pytest.approx(want[b], rel=1e-9) for b in want)


@pytest.mark.parametrize("how", [{}, {"others": True}, {"drop_zero": True}, {"start_km": 40.0}])
def test_nearest_of_many_at_one_place(spark, how):
    """More stations at a place than are asked for, places at equal distances, a pole and
    the date line: the nearest by distance and id, as by brute force."""
    r = np.random.default_rng(5)
    place = [(0.0, 10.0), (1.0, 10.0), (-1.0, 10.0), (179.9, 5.0), (-179.9, 5.0), (30.0, 89.5), (-150.0, 89.5), *r.uniform(-20, 20, (20, 2)).tolist()]
    rows = [(i, *place[i % 27]) for i in range(270)]
    s = spark.createDataFrame(rows, "station_id int, lon double, lat double")
    lon, lat = np.array([x[1:] for x in rows]).T
    got = {}
    for x in spatial.nearest(s.withColumn("point_id", F.col("station_id")), s, 12, **how).orderBy("rank").collect():
        got.setdefault(x.point_id, []).append(x.station_id)
    for i in range(270):
        d = np.round(kernels.km(lon[i], lat[i], lon, lat), 6)
        there = [j for j in np.lexsort((np.arange(270), d)) if not ("others" in how and j == i or "drop_zero" in how and d[j] == 0)]
        assert np.round(d[got[i]], 6).tolist() == d[there[:12]].tolist() and len(set(got[i])) == 12
        assert "others" not in how or i not in got[i]


def test_large_sides_are_not_sent(spark):
    """What a function returns and points are joined by shuffles, however small Spark
    takes them to be."""
    for name in ("interp_normals", "ked_weights", "month_neighbours"):
        plan = library.queries()[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=merge" in plan, name


def test_rules_are_written_one_by_one(spark):
    """The chain's plan reads what the rule before wrote, not all rules again."""
    plan = library.queries()["qa_non_spatial_all"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation ") == 1
