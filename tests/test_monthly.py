"""Own numbers of neighbours by point and month, against loops over points and months."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.functions import kernels
from isohyet.operators import interp, monthly, neighbourhoods

KEYS = "station_id int, lon double, lat double, elev double"


def network(n=60, months=(1, 7), seed=3):
    r = np.random.default_rng(seed)
    places = [(i, *map(float, x)) for i, x in enumerate(r.uniform([-100, 38, 0], [-95, 42, 2], (n, 3)))]
    norms = [(i, m, float(20 - lat / 2 - 3 * e + math.sin(3 * lon) + m / 3 + 0.1 * r.standard_normal()), 10 + (i * 7 + m) % 9, 12 + (i + m) % 5, 0.02 + i / 5000, 0.4 + i / 1000, 60.0 + i) for i, lon, lat, e in places for m in months]
    return places, norms


MONTHLY = "station_id int, month int, norm double, optim_nnghs int, optim_nnghs_anom int, vario_nug double, vario_psill double, vario_rng double"
POINTS = [(100, -98.2, 40.1, 0.5), (101, -95.5, 41.7, 1.5), (102, -99.9, 38.1, 0.1)]


def listed(places, lon, lat, without=()):
    rows = [(float(kernels.km(lon, lat, b, c)), i) for i, b, c, _ in places if i not in without]
    return sorted(rows)


def weights(rows, k):
    bw = rows[k][0] if k < len(rows) else rows[-1][0]
    return [(1 - (d / bw) ** 2) ** 2 if d < bw else 0.0 for d, _ in rows[:k]]


def by_hand(places, norms, point, month, initial, column, without=()):
    """k, norm and variance of one point and month, one step after the other."""
    of = {n[0]: n for n in norms if n[1] == month}
    place = {p[0]: p for p in places}
    rows = listed(places, point[1], point[2], without)
    k = int(round(np.average([of[i][column] for _, i in rows[:initial]], weights=weights(rows, initial))))
    rows_k, w = rows[:k], weights(rows, k)
    if column != 3:
        return k, rows_k, w
    nug, psill, rng = (np.average([of[i][c] for _, i in rows_k], weights=w) for c in (5, 6, 7))
    f = np.array([place[i][1:] for _, i in rows_k])
    h = kernels.distances(f[:, 0], f[:, 1])
    lam, var = kernels.drift_weights(f[None], np.array(point[1:])[None], h[None], np.array([[d for d, _ in rows_k]]), *(np.array([v]) for v in (nug, psill, rng)))
    return k, float(lam[0] @ [of[i][2] for _, i in rows_k]), float(var[0])


def test_normals_against_a_loop(spark):
    places, norms = network()
    s, m = spark.createDataFrame(places, KEYS), spark.createDataFrame(norms, MONTHLY)
    pts = spark.createDataFrame(POINTS, "point_id int, lon double, lat double, elev double")
    got = {(r.point_id, r.month): r for r in monthly.normals(pts, s, m, initial=20).collect()}
    assert len(got) == 6
    for p in POINTS:
        for month in (1, 7):
            k, norm, var = by_hand(places, norms, p, month, 20, 3)
            r = got[p[0], month]
            assert (r.k, r.status) == (k, "ok") and r.norm == pytest.approx(norm, abs=1e-8) and r.variance == pytest.approx(var, abs=1e-8)


def test_prefixes_against_a_loop(spark):
    places, norms = network()
    s, m = spark.createDataFrame(places, KEYS), spark.createDataFrame(norms, MONTHLY)
    pts = spark.createDataFrame(POINTS, "point_id int, lon double, lat double, elev double")
    counts = monthly.neighbour_counts(pts, s, m, initial=20)
    out = neighbourhoods.prefixes(monthly.neighbour_lists(pts, s, counts), counts).collect()
    for p in POINTS:
        for month in (1, 7):
            rows = listed(places, p[1], p[2])
            got = sorted((r.rank, r.station_id, r.k, r.wgt) for r in out if (r.point_id, r.month) == (p[0], month))
            k = got[0][2]
            assert [g[1] for g in got] == [i for _, i in rows[:k]] and [g[3] for g in got] == pytest.approx(weights(rows, k))


def test_without_numbers_or_stations(spark):
    """No number of neighbours among the nearest, stations without a norm, null places."""
    places, norms = network()
    norms = [(*n[:3], None, *n[4:]) if n[1] == 7 else n for n in norms]
    norms[0] = (*norms[0][:2], None, *norms[0][3:])  # station 0 has no norm in month 1
    places[5] = (5, None, 40.0, 1.0)
    s, m = spark.createDataFrame(places, KEYS), spark.createDataFrame(norms, MONTHLY)
    pts = spark.createDataFrame([*POINTS, (103, None, 40.0, 1.0)], "point_id int, lon double, lat double, elev double")
    got = {(r.point_id, r.month): r for r in monthly.normals(pts, s, m, initial=20).collect()}
    assert len(got) == 8 and got[100, 7].status == "no number of neighbours" and got[100, 7].norm is None
    assert got[103, 1].norm is None and got[103, 1].status != "ok"
    left = [p for p in places if p[0] not in (0, 5)]
    assert got[100, 1].norm == pytest.approx(by_hand(left, [n for n in norms if n[0] not in (0, 5)], POINTS[0], 1, 20, 3)[1], abs=1e-8)
    empty = monthly.normals(pts.where("point_id < 0"), s, m, initial=20)
    assert empty.count() == 0


def test_monthly_predictor(spark):
    """A predictor that differs by month is followed exactly."""
    places, norms = network()
    lst = {(i, m): (i * 37 % 11) / 3 + m for i in range(60) for m in (1, 7)}
    s = spark.createDataFrame(places, KEYS)
    m = spark.createDataFrame([(*n[:2], 5 + 2 * lst[n[0], n[1]], *n[3:], lst[n[0], n[1]]) for n in norms], MONTHLY + ", lst double")
    pts = spark.createDataFrame(POINTS[:1], "point_id int, lon double, lat double, elev double")
    own = spark.createDataFrame([(100, 1, 2.5), (100, 7, 4.0)], "point_id int, month int, lst double")
    got = {r.month: r.norm for r in monthly.normals(pts, s, m, monthly=("lst",), point_month=own, initial=20).collect()}
    assert got == pytest.approx({1: 10.0, 7: 13.0}, abs=1e-6)


def _days(places, norms, n=40):
    start = dt.date(2001, 1, 1)
    of = {(x[0], x[1]): x[2] for x in norms}
    return [(i, start + dt.timedelta(d), of[i, 1] + math.sin(d + i / 9) + 2 * e) for i, _, _, e in places for d in range(min(n, 31))]


def test_leave_one_out_is_taking_the_station_away(spark):
    places, norms = network(40)
    values = _days(places, norms)
    frames = lambda keep: (spark.createDataFrame([p for p in places if keep(p[0])], KEYS), spark.createDataFrame([n for n in norms if keep(n[0])], MONTHLY), spark.createDataFrame([v for v in values if keep(v[0])], "station_id int, obs_date date, value double"))
    s, m, v = frames(lambda i: True)
    norm, day = monthly.leave_one_out(s, m, v, initial=15)
    norm = {(r.station_id, r.month): r.pred for r in norm.collect()}
    day = {(r.station_id, r.obs_date): r.pred for r in day.collect()}
    assert len(norm) == 80 and len(day) == len(values)
    for i in (0, 17):
        s2, m2, v2 = frames(lambda x, i=i: x != i)
        pts = s.where(F.col("station_id") == i).withColumnRenamed("station_id", "point_id")
        pn = monthly.normals(pts, s2, m2, initial=15)
        assert {r.month: r.norm for r in pn.collect()} == pytest.approx({mo: norm[i, mo] for mo in (1, 7)}, abs=1e-9)
        d = monthly.daily(pts, s2, m2, v2, pn, initial=15)
        assert {r.obs_date: r.value for r in d.collect()} == pytest.approx({k[1]: x for k, x in day.items() if k[0] == i}, abs=1e-9)


def test_days_against_a_loop(spark):
    places, norms = network()
    values = _days(places, norms)
    values = [v for v in values if not (v[0] == 3 and v[1].day == 4)]
    s, m = spark.createDataFrame(places, KEYS), spark.createDataFrame(norms, MONTHLY)
    v = spark.createDataFrame(values, "station_id int, obs_date date, value double")
    pts = spark.createDataFrame(POINTS[:1], "point_id int, lon double, lat double, elev double")
    pn = spark.createDataFrame([(100, 1, 4.0), (100, 7, 9.0)], "point_id int, month int, norm double")
    got = {r.obs_date: r.value for r in monthly.daily(pts, s, m, v, pn, initial=20).collect()}
    k, rows, w = by_hand(places, norms, POINTS[0], 1, 20, 4)
    place, of = {p[0]: p for p in places}, {n[0]: n[2] for n in norms if n[1] == 1}
    z, _ = kernels.gwr_weights(np.array([[place[i][1:] for _, i in rows]]), np.array([POINTS[0][1:]]), np.array([w]))
    there = {(i, d): x for i, d, x in values}
    for d, x in got.items():
        if any((i, d) not in there for _, i in rows):
            assert x is None
        else:
            assert x == pytest.approx(4.0 + z[0] @ [there[i, d] - of[i] for _, i in rows], abs=1e-8)


def test_range_and_normals_only(spark):
    places, norms = network()
    s = spark.createDataFrame(places, KEYS)
    m = {e: spark.createDataFrame([(*n[:2], n[2] + up, *n[3:]) for n in norms], MONTHLY) for e, up in (("tmin", 0.0), ("tmax", 8.0))}
    pts = spark.createDataFrame(POINTS[:2], "point_id int, lon double, lat double, elev double")
    none, normal = monthly.interpolate(pts, s, m, initial=20)
    assert none is None and normal.count() == 4
    v = spark.createDataFrame([(i, d, x, x + 8.0) for i, d, x in _days(places, norms)], "station_id int, obs_date date, tmin double, tmax double")
    day, normal = monthly.interpolate(pts, s, m, v, initial=20)
    got = day.collect()
    assert len(got) == 62 and all(r.tmax - r.tmin == pytest.approx(8.0, abs=1e-6) for r in got)
    assert all(r.tmax_norm - r.tmin_norm == pytest.approx(8.0, abs=1e-6) for r in normal.collect())


def test_bandwidths_in_one_search(spark):
    places, norms = network(40, (1,))
    s = spark.createDataFrame([(*p, 1) for p in places], KEYS + ", climdiv int")
    v = spark.createDataFrame([(n[0], n[1], n[2]) for n in norms], "station_id int, month int, value double")
    for method in ("regression", "kriging"):
        got = {(r.n_nghs, r.station_id): r.mae for r in interp.bandwidth_errors(s, v, [12, 20], method).collect()}
        assert len(got) == 80
        one = interp.leave_one_out(s, v, 12) if method == "regression" else interp.leave_one_out_normals(s, v.withColumnRenamed("value", "norm"), 12)
        assert {r.station_id: abs(r.pred - r.obs) for r in one.collect()} == pytest.approx({i: x for (k, i), x in got.items() if k == 12}, abs=1e-9)


def test_station_variograms(spark):
    places, norms = network()
    got = monthly.station_variograms(spark.createDataFrame(places, KEYS), spark.createDataFrame(norms, MONTHLY), initial=20).collect()
    assert len(got) == 120 and all(r.status == "ok" for r in got)
    of = {n[0]: n for n in norms if n[1] == 7}
    r = next(r for r in got if (r.station_id, r.month) == (8, 7))
    rows = listed(places, *places[8][1:3])[: r.k]
    f = np.array([places[i][1:] for _, i in rows])
    want = kernels.fit_variogram(f, np.array([of[i][2] for _, i in rows]), f[:, 0], f[:, 1], far=rows[-1][0])
    assert (r.vario_nug, r.vario_psill, r.vario_rng) == pytest.approx(want, rel=1e-4)
