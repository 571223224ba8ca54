"""Small fixtures, one for each rule or oddity."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.functions import kernels, scalars, stats
from isohyet.operators import aggregate, grid, homog, infill, interp, qa_prcp, qa_temp, spatial
from isohyet.operators import stations as st
from isohyet.operators.calendar import days, densify, month_day_windows, months
from isohyet.sources import text
from isohyet.streaming.daily import daily_range

START = dt.date(2001, 1, 1)


def series(spark, tmin, tmax=None, start=START, station=1):
    tmax = tmax if tmax is not None else [None if v is None else v + 5 for v in tmin]
    rows = [(station, start + dt.timedelta(i), None if a is None else float(a), None if b is None else float(b)) for i, (a, b) in enumerate(zip(tmin, tmax))]
    return qa_temp.prepare(spark.createDataFrame(rows, "station_id long, obs_date date, tmin double, tmax double"))


def flagged(df, elem="tmin"):
    return [(r.obs_date - START).days for r in df.where(f"flag_{elem} <> ''").orderBy("obs_date").collect()]


def wave(n):
    return [(i * 7) % 13 + 0.5 for i in range(n)]


def test_streaks(spark):
    mid = wave(60)
    mid[20:40] = [3.0] * 20
    assert flagged(qa_temp.streak(series(spark, mid))) == list(range(20, 40))
    tail = wave(60)
    tail[40:] = [3.0] * 20
    assert flagged(qa_temp.streak(series(spark, tail))) == []
    assert flagged(qa_temp.streak(series(spark, tail), literal=False)) == list(range(40, 60))
    holes = wave(70)
    holes[20:43] = [3.0] * 23
    holes[25] = holes[30] = holes[31] = None
    assert flagged(qa_temp.streak(series(spark, holes))) == [i for i in range(20, 43) if i not in (25, 30, 31)]


def test_duplicate_months(spark):
    year = [float((i * 37) % 101) for i in range(365)]
    nov, dec = 304, 334
    year[dec : dec + 30] = year[nov : nov + 30]
    assert flagged(qa_temp.dup_year_month(series(spark, year))) == []
    assert len(flagged(qa_temp.dup_year_month(series(spark, year), literal=False))) == 61
    year = [float((i * 37) % 101) for i in range(365)]
    year[31:59] = year[0:28]
    assert len(flagged(qa_temp.dup_year_month(series(spark, year)))) == 59
    year[5] = year[36] = None
    assert flagged(qa_temp.dup_year_month(series(spark, year))) == []


def test_duplicate_years(spark):
    one = [float((i * 37) % 101) for i in range(365)]
    assert len(flagged(qa_temp.dup_year(series(spark, one + one)))) == 730
    other = [float((i * 41) % 103) for i in range(365)]
    assert flagged(qa_temp.dup_year(series(spark, one + other))) == []
    assert len(flagged(qa_temp.dup_month(series(spark, one + one[:31] + other[31:])))) == 62


def test_gap(spark):
    assert flagged(qa_temp.gap(series(spark, [1.0, 2.0, 13.0, 14.0]))) == []  # the jump is at an even count's median
    assert flagged(qa_temp.gap(series(spark, [1.0, 2.0, 3.0, 2.5, 1.5, 14.0, 15.0]))) == [5, 6]
    assert flagged(qa_temp.gap(series(spark, [1.0, 2.0, 3.0, 2.5, 1.5, -12.0]))) == [5]


def test_edges(spark):
    assert flagged(qa_temp.spike_dip(series(spark, [40.0, 0.0, 1.0, 30.0, 2.0, 3.0]))) == [3]
    lag = series(spark, [0, 0, 0, 0], [50, 5, 5, 5])
    assert flagged(qa_temp.lagged_range(lag), "tmax") == [0] and flagged(qa_temp.lagged_range(lag), "tmin") == [0, 1]


def test_first_flag_wins(spark):
    x = series(spark, [0.0, 100.0, 1.0], [0.0, 120.0, 0.0])
    out = {(r.obs_date - START).days: r for r in qa_temp.run_non_spatial(x, (qa_temp.naught, qa_temp.impossible, qa_temp.internal_inconsistency)).collect()}
    assert [out[i].flag_tmin for i in range(3)] == ["N", "X", "I"] and all(r.tmin is None for r in out.values())


def test_mega_and_within_month(spark):
    assert flagged(qa_temp.mega_inconsistency(series(spark, [1, 2, 30], [9, 9, None]))) == [2]
    assert len(flagged(qa_temp.dup_within_month(series(spark, list(range(12)), list(range(12)))))) == 12


def test_climate_outlier(spark):
    n = 365 * 9
    v = [10 + ((i * 7919) % 17) / 10 for i in range(n)]
    v[1500] = 60.0
    assert flagged(qa_temp.climate_outlier(series(spark, v))) == [1500]
    few = qa_temp.seasonal_norms(series(spark, v[: 365 * 6]))
    assert few.count() == 0  # 6 years x 15 days are under 100 values


def test_biweight_flat(spark):
    x = spark.createDataFrame([(1, float(v)) for v in [5, 5, 5, 5, 9]], "k int, value double")
    r = stats.biweight(x, ["k"]).first()
    assert r.bi_mean == pytest.approx(5.8) and r.bi_std == pytest.approx(np.std([5, 5, 5, 5, 9], ddof=1))


def test_windows_leave_out_leap_day():
    w = month_day_windows(7)
    assert len(w) == (365 + 366) * 15 and not any(md == 229 for leap, _, md in w if not leap)
    assert {md for leap, y, md in w if not leap and y == 1} == {1225 + i for i in range(7)} | {101 + i for i in range(8)}


def test_monthly_threshold(spark):
    x = [(1, START + dt.timedelta(i), float(i)) for i in range(31) if i >= 9] + [(1, dt.date(2001, 2, 1) + dt.timedelta(i), 1.0) for i in range(18)]
    got = {r.month: r for r in aggregate.monthly_means(spark.createDataFrame(x, "station_id int, obs_date date, value double")).collect()}
    assert got[1].mean == pytest.approx(19.5) and got[1].n_miss == 9 and got[2].mean is None and got[2].n_miss == 10


def test_two_level_norm(spark):
    x = [(1, dt.date(y, 1, i + 1), v) for y, n, v in ((2001, 31, 1.0), (2002, 22, 4.0)) for i in range(n)]
    r = aggregate.monthly_normals(spark.createDataFrame(x, "station_id int, obs_date date, value double"), 2001, 2002).first()
    assert r.norm == pytest.approx(2.5)


def test_period_of_record(spark):
    counts = [(s, m, aggregate.DAYS_IN_MONTH[m - 1] * 5 - (1 if s == 2 and m == 2 else 0)) for s in (1, 2) for m in range(1, 13)]
    got = {r.station_id: r.ok for r in aggregate.period_of_record(spark.createDataFrame(counts, "station_id int, month int, cnt long"), 5).collect()}
    assert got == {1: True, 2: False}


def test_serial_run(spark):
    for n, whole in ((5, False), (6, True)):
        v = [1.0] * 3 + [None] * n + [1.0] * 3
        x = spark.createDataFrame([(1, START + dt.timedelta(i), a, 9.0) for i, a in enumerate(v)], "station_id int, obs_date date, value double, infilled double")
        out = st.serially_complete(x, 6).collect()
        assert sum(r.value == 9.0 for r in out) == (n + 6 if whole else n)


def test_calendar(spark):
    assert days(spark, "2000-02-28", "2000-03-01").count() == 3 and months(spark, "2000-01-15", "2000-03-01").count() == 3
    one = spark.createDataFrame([(1, START, 1.0), (2, START + dt.timedelta(4), 2.0)], "station_id int, obs_date date, value double")
    assert densify(one).count() == 10


def test_neighbours(spark):
    r = np.random.default_rng(1)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.column_stack([r.uniform(-180, 180, 300), r.uniform(-88, 88, 300)]))]
    s = spark.createDataFrame(pts, "station_id int, lon double, lat double")
    for radius in (75.0, 900.0, 4000.0):
        want = {(a, b) for a, x, y in pts for b, u, v in pts if a != b and kernels.km(x, y, u, v) <= radius}
        assert {(p.station_id, p.ngh_id) for p in spatial.station_pairs(s, radius).collect()} == want
    p = s.where("station_id < 5").withColumn("point_id", F.col("station_id"))
    assert spatial.nearest(p, s, 3, 20000.0).count() == 15
    few = spark.createDataFrame([(i, float(i), 0.0) for i in range(4)], "station_id int, lon double, lat double")
    q = few.where("station_id = 0").withColumn("point_id", F.col("station_id"))
    assert spatial.nearest(q, few, 3).count() == 3
    with pytest.raises(Exception, match="fewer than"):
        spatial.nearest(q, few, 4).collect()


def test_corroboration_without_norms(spark):
    x = None
    for s in range(5):
        v = [20.0 if s == 0 and i == 30 else 0.5 * (i % 3) for i in range(60)]
        y = series(spark, v, station=s)
        x = y if x is None else x.unionByName(y)
    s = spark.createDataFrame([(i, i * 0.1, 40.0) for i in range(5)], "station_id long, lon double, lat double")
    out = spatial.spatial_corroboration(x, s, min_values=5)
    assert [(r.station_id, (r.obs_date - START).days) for r in out.where("flag_tmin <> ''").collect()] == [(0, 30)]


def test_tobs(spark):
    def run(n):
        x = spark.createDataFrame([(1, START + dt.timedelta(i), 0.0, float(i), 700 if i in range(2, 2 + n) else None) for i in range(6)], "station_id int, obs_date date, tmin double, tmax double, tobs_tmax int")
        return [r.tmax for r in homog.shift_morning_tmax(x).orderBy("obs_date").collect()]

    assert run(1) == [0, 1, 2, 3, 4, 5]
    assert run(2) == [0, 1, 2, 3, 4, 5]  # only one can move: the day before holds a valid maximum
    assert run(3) == [0, 1, 3, 4, None, 5]


def test_segments(spark):
    seg = spark.createDataFrame([(1, 20000101, 20001231, 0.5), (1, 20010101, 20011231, 0.2)], "station_id int, ymd_start int, ymd_end int, adj double")
    m = spark.createDataFrame([(1, 1999, 5), (1, 2000, 5), (1, 2001, 5), (1, 2003, 5)], "station_id int, year int, month int")
    assert [r.adj for r in homog.segment_adjustment(m, seg).orderBy("year").collect()] == [0.5, 0.5, 0.2, 0.0]


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(scalars.station_code(F.lit("NRCS_302:OR:SNTL"))) == "SNT302ORSNT"
    assert get(scalars.station_code(F.lit("RAWS_AB12"))) == "WRC0000AB12"
    with pytest.raises(Exception, match="11 characters"):
        get(scalars.station_code(F.lit("OTHER_1")))
    assert get(scalars.parse_degrees(F.lit("42 30 00"))) == 42.5
    assert get(scalars.dms_to_decimal(F.lit(-1), F.lit(30), F.lit(0))) == -1.5
    assert get(scalars.pack(F.lit(1e9))) is None and get(scalars.pack(F.lit(12.345))) in (1234, 1235)
    assert get(scalars.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(111.195, abs=0.01)
    assert get(scalars.distance_angle_cosines(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))).angle == pytest.approx(90)
    assert scalars.bandwidths(35, 150, 0.1)[0] == 35 and scalars.bandwidths(35, 150, 0.1)[-1] <= 150
    assert [get(scalars.size_classes(F.lit(i), F.lit(7), 3)) for i in range(7)] == [0, 0, 0, 1, 1, 2, 2]


def test_gwr_is_exact_on_planes():
    r = np.random.default_rng(2)
    f, f0, w = r.standard_normal((5, 30, 4)), r.standard_normal((5, 4)), r.uniform(0.1, 1, (5, 30))
    z, deficient = kernels.gwr_weights(f, f0, w)
    y, y0 = 3 + f @ np.array([1.0, -2, 0.5, 4]), 3 + f0 @ np.array([1.0, -2, 0.5, 4])
    assert not deficient.any() and z.sum(1) == pytest.approx(np.ones(5)) and (z * y).sum(1) == pytest.approx(y0)
    assert kernels.gwr_weights(np.ones((1, 5, 2)), np.ones((1, 2)), np.ones((1, 5)))[1].tolist() == [True]


def test_gwr_solves_the_normal_equations():
    r = np.random.default_rng(12)
    f, f0, w, y = r.standard_normal((4, 25, 3)), r.standard_normal((4, 3)), r.uniform(0.01, 1, (4, 25)), r.standard_normal((4, 25))
    z, _ = kernels.gwr_weights(f, f0, w)
    for i in range(4):
        x = np.column_stack([np.ones(25), f[i]])
        b = np.linalg.lstsq(x * np.sqrt(w[i])[:, None], y[i] * np.sqrt(w[i]), rcond=None)[0]
        assert z[i] @ y[i] == pytest.approx(np.concatenate([[1], f0[i]]) @ b)


def test_kriging_solves_each_system(spark):
    r = np.random.default_rng(13)
    n = 24
    st = [(i, float(r.uniform(-110, -104)), float(r.uniform(38, 44)), float(r.uniform(0, 3000))) for i in range(n)]
    stations_ = spark.createDataFrame(st, "station_id long, lon double, lat double, elev double")
    pts = [(i, float(r.uniform(-109, -105)), float(r.uniform(39, 43)), float(r.uniform(0, 3000)), 0.3 + i / 10, 1.5, 0.0 if i == 3 else 150.0) for i in range(6)]
    points = spark.createDataFrame(pts, "point_id long, lon double, lat double, elev double, nug double, psill double, rng double")
    near = spatial.nearest(points, stations_, 8)
    got = {}
    for x in interp.drift_weights(points.select("point_id", "lon", "lat", "elev"), near, stations_, points.select("point_id", "nug", "psill", "rng")).collect():
        got.setdefault(x.point_id, {})[x.station_id] = (x.lam, x.variance)
    xy = np.array(st)[:, 1:]
    for i, lon, lat, elev, nug, psill, rng in pts:
        ids = sorted(range(n), key=lambda k: (kernels.km(lon, lat, *xy[k, :2]), k))[:8]
        assert sorted(got[i]) == sorted(ids)
        cov = (lambda h: psill * np.exp(-h / rng)) if rng else (lambda h: 0 * h)
        sill = nug + psill
        a, b = np.zeros((12, 12)), np.zeros(12)
        for u, p in enumerate(ids):
            for v, q in enumerate(ids):
                a[u, v] = sill if u == v else cov(kernels.km(*xy[p, :2], *xy[q, :2]))
            a[u, 8:] = a[8:, u] = [1, *(xy[p] / [100, 10, 1000])]
            b[u] = cov(kernels.km(lon, lat, *xy[p, :2]))
        b[8:] = [1, lon / 100, lat / 10, elev / 1000]
        x = np.linalg.solve(a, b)
        assert [got[i][p][0] for p in ids] == pytest.approx(x[:8], abs=1e-8)
        assert got[i][ids[0]][1] == pytest.approx(sill - x @ b, abs=1e-8)


def test_nearest_is_exact_whatever_the_start(spark):
    r = np.random.default_rng(14)
    st = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(r.uniform(-180, 180, 60), r.uniform(-88, 88, 60)))] + [(60 + i, 10.0 + i / 100, 50.0) for i in range(60)]
    pts = [(0, 10.0, 50.0), (1, 179.9, -60.0), (2, -179.9, 10.0), (3, 0.0, 89.0), (4, -100.0, 0.0)]
    stations_, points = spark.createDataFrame(st, "station_id long, lon double, lat double"), spark.createDataFrame(pts, "point_id long, lon double, lat double")
    for start in (None, 50.0, 30_000.0):
        got = {(x.point_id, x["rank"]): x.station_id for x in spatial.nearest(points, stations_, 7, start).collect()}
        for p, lon, lat in pts:
            want = sorted(st, key=lambda s: (round(float(kernels.km(lon, lat, s[1], s[2])), 9), s[0]))[:7]
            assert [got[p, k] for k in range(1, 8)] == [s[0] for s in want]


@pytest.mark.parametrize("k,drop,others", [(3, False, False), (12, True, False), (5, False, True), (40, True, True)])
def test_nearest_in_one_pass(spark, k, drop, others):
    """Masked pairs, stations at one place, points without one, few stations, text ids."""
    r = np.random.default_rng(k)
    st = [(f"S{i:02d}", float(x), float(y)) for i, (x, y) in enumerate(zip(r.uniform(-120, -70, 38), r.uniform(25, 50, 38)))]
    st += [("S38", *st[3][1:]), ("S39", *st[3][1:]), ("S40", None, 30.0)]
    pts = [(s[0], s[1], s[2]) for s in st] + [("P1", 179.99, 60.0), ("P2", -179.99, -60.0), ("P3", -100.0, None)]
    gone = [(p[0], s[0]) for p in pts for s in st if r.random() < 0.3]
    s, p = spark.createDataFrame(st, "station_id string, lon double, lat double"), spark.createDataFrame(pts, "point_id string, lon double, lat double")
    ex = spark.createDataFrame(gone + gone[:5] + [("P1", "none such")], "point_id string, station_id string")
    got = {}
    for x in spatial.nearest(p, s, k, drop_zero=drop, others=others, strict=False, exclude=ex).collect():
        got.setdefault(x.point_id, []).append((x["rank"], x.station_id, x.dist_km, x.bandwidth, x.wgt))
    for i, lon, lat in pts:
        if lon is None or lat is None:
            assert i not in got
            continue
        rows = [(float(kernels.km(lon, lat, x, y)), c) for c, x, y in st if x is not None and (i, c) not in set(gone)]
        rows = sorted((round(d, 9), c) for d, c in rows if not (drop and d == 0) and not (others and c == i))
        mine = sorted(got.get(i, []))
        assert [m[1] for m in mine] == [c for _, c in rows[:k]] and [m[2] for m in mine] == pytest.approx([d for d, _ in rows[:k]], abs=1e-8)
        if mine:
            bw = rows[k][0] if len(rows) > k else rows[min(k, len(rows)) - 1][0]
            assert all(m[3] == pytest.approx(bw, abs=1e-8) for m in mine)
            assert [m[4] for m in mine] == pytest.approx([max(0.0, 1 - (d / bw) ** 2) ** 2 if bw else 1.0 for d, _ in rows[:k]], abs=1e-7)


def test_growth_takes_what_every_day_needs(spark):
    """Three neighbours a day: the third nearest one misses some days, and nobody else
    is near, so the radius grows to the fourth; a far station is left uncovered."""
    days_ = [dt.date(2001, 1, 1) + dt.timedelta(i) for i in range(31)]
    place = {0: 0.0, 1: 0.2, 2: 0.4, 3: 0.6, 4: 2.0, 5: 2.1}  # degrees on the equator
    stations_ = spark.createDataFrame([(s, x, 0.0) for s, x in place.items()] + [(6, 0.0, 80.0)], "station_id long, lon double, lat double")
    r = np.random.default_rng(15)
    base = r.normal(0, 5, 31)
    rows = [(s, d, None if s == 3 and i in (4, 5) else float(base[i] + s)) for s in place for i, d in enumerate(days_)]
    rows += [(6, d, float(i)) for i, d in enumerate(days_)]
    daily = spark.createDataFrame(rows, "station_id long, obs_date date, value double")
    chosen, status = infill.grown_candidates(daily, stations_)
    got = {x.station_id: (x.ring, x.status) for x in status.collect()}
    of = {}
    for x in chosen.collect():
        of.setdefault(x.station_id, set()).add(x.ngh_id)
    km = lambda s, t: abs(place[s] - place[t]) * 111.195
    ring = lambda s, t: max(0, int(np.ceil((km(s, t) - 75) / 37.5)))
    assert got[0] == (ring(0, 4), "covered") and of[0] == {1, 2, 3, 4}
    assert got[3] == (0, "covered") and of[3] == {0, 1, 2}
    assert got[5][1] == "covered" and got[5][0] == ring(5, 2)
    assert got[6][1] == "covered"  # the whole globe has enough
    few = stations_.where("station_id in (0, 1, 2)")
    _, status = infill.grown_candidates(daily.where("station_id in (0, 1, 2)"), few)
    assert {(x.ring, x.status) for x in status.collect()} == {(None, "uncovered")}


def test_nearest_with_data_finds_far_cells(spark):
    g = grid.Grid(0.0, 0.0, 1.0, 500, 500)
    cells = spark.createDataFrame([(3, 3, 1.0), (400, 410, 2.0), (401, 410, 3.0), (90, 90, None)], "row int, col int, value double")
    points = spark.createDataFrame([(1, 3.5, -3.5), (2, 90.5, -90.5), (3, 410.5, -402.5), (4, -800.0, 900.0), (5, None, None)], "point_id long, lon double, lat double")
    got = {x.point_id: x.value for x in grid.nearest_with_data(points, cells, g).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 3.0, 4: 1.0, 5: None}
    assert {x.value for x in grid.nearest_with_data(points, cells.where("value is null"), g).collect()} == {None}


def test_kriging_and_variogram():
    r = np.random.default_rng(3)
    lon, lat = r.uniform(-110, -108, 60), r.uniform(40, 42, 60)
    h = kernels.distances(lon, lat)
    f = np.column_stack([lon, lat])
    one = lambda *x: [np.array([v], float) for v in x]
    lam, var = kernels.drift_weights(*one(f, f[7], h, h[7], 0.0, 2.0, 80.0))
    assert lam[0, 7] == pytest.approx(1, abs=1e-6) and var[0] == pytest.approx(0, abs=1e-6)
    lam = kernels.drift_weights(*one(f, f.mean(0), h, h.mean(0), 0.4, 0.0, 0.0))[0][0]
    assert lam.sum() == pytest.approx(1) and lam @ f[:, 0] == pytest.approx(lon.mean())
    c = np.linalg.cholesky(2.0 * np.exp(-h / 60) + 1e-6 * np.eye(60))
    fits = [kernels.fit_variogram(f, c @ r.standard_normal(60), lon, lat) for _ in range(10)]
    assert all(n >= 0 and p >= 0 and a >= 0 for n, p, a in fits) and any(a > 0 for *_, a in fits)


def test_em_and_ppca():
    r = np.random.default_rng(4)
    a = r.standard_normal((400, 1)) @ r.standard_normal((1, 5)) + 0.2 * r.standard_normal((400, 5)) + 3
    mu, cov = kernels.em_normal(a)
    assert np.allclose(mu, a.mean(0), atol=1e-5) and np.allclose(cov, np.cov(a.T, bias=True), atol=1e-4)
    b = a.copy()
    b[r.random(b.shape) < 0.2] = np.nan
    mu, _ = kernels.em_normal(b)
    assert np.abs(mu - a.mean(0)).max() < 0.1
    z = (b - np.nanmean(b, 0)) / np.nanstd(b, 0)
    fit, share = kernels.ppca(z, 1)
    truth = (a - np.nanmean(b, 0)) / np.nanstd(b, 0)
    assert np.abs((fit - truth)[np.isnan(b)]).mean() < 0.25 and share[0] > 0.85
    scores, load, var = kernels.pca(a)
    assert np.allclose(scores.T @ scores, np.diag(np.diag(scores.T @ scores)), atol=1e-6) and var.sum() == pytest.approx(5)


def test_variance_change():
    r = np.random.default_rng(5)
    assert kernels.variance_change(r.standard_normal(500)) is None
    at = kernels.variance_change(np.concatenate([r.standard_normal(500), 6 * r.standard_normal(500)]))
    assert at is not None and abs(at - 500) < 40


def test_crossed_days():
    tmin, tmax = np.zeros(40), np.full(40, 10.0)
    tmin[20], tmax[20] = 12.0, 4.0
    a, b, n = kernels.fix_crossed(tmin, tmax)
    assert n == 1 and a[20] == 3 and b[20] == 13
    with pytest.raises(ValueError):
        kernels.fix_crossed(np.ones(3), np.zeros(3))


def test_infill(spark):
    r = np.random.default_rng(6)
    n = 730
    base = 10 * np.sin(np.arange(n) / 58) + r.standard_normal(n)
    rows = [(s, START + dt.timedelta(i), None if s == 0 and i % 7 == 0 else float(base[i] + s + 0.3 * r.standard_normal())) for s in range(6) for i in range(n)]
    daily = spark.createDataFrame(rows, "station_id int, obs_date date, value double")
    s = spark.createDataFrame([(i, i * 0.1, 40.0) for i in range(6)], "station_id int, lon double, lat double")
    out = infill.infill_stations(daily, spatial.station_pairs(s, 75.0)).where("station_id = 0").toPandas().sort_values("obs_date")
    assert len(out) == n and out.infilled.notna().all() and (out.mae < 1).all()
    truth = base[[(d - START).days for d in out.obs_date]]
    assert np.abs(out.infilled.to_numpy() - truth)[out.value.isna()].mean() < 0.6


def test_bilinear(spark):
    g = grid.Grid(0.0, 10.0, 1.0, 10, 10)
    cells = spark.createDataFrame([(i, j, float(i + 10 * j)) for i in range(10) for j in range(10) if (i, j) != (5, 5)], "row int, col int, value double")
    pts = spark.createDataFrame([(1, 3.0, 7.0), (2, 5.3, 4.8), (3, 5.5, 4.5)], "point_id int, lon double, lat double")
    got = {r.point_id: r.value for r in grid.bilinear(pts, cells, g).collect()}
    assert got[1] == pytest.approx(2.5 + 25) and got[2] is None and got[3] is None
    assert {r.point_id: r.value for r in grid.add_raster(pts, cells, g, force=True).collect()}[3] is not None
    assert grid.bilinear(pts.where("point_id = 2").withColumn("lat", F.lit(5.2)), cells, g).first().value == pytest.approx(4 + 50)


def test_tiles(spark, tmp_path):
    cells = spark.createDataFrame([(i, j, i < 4, 1.0) for i in range(8) for j in range(8)], "row int, col int, mask boolean, value double")
    t = grid.tiles(cells, 4, 2)
    assert [(r.tile_id, r.tile_num) for r in t.orderBy("tile_num").collect()] == [("h00v00", 0), ("h01v00", 1)]
    assert grid.to_do(t, t.where("tile_num = 0")).count() == 1
    assert grid.expand(cells, 6, 10).where("value is not null").count() == 32
    daily = spark.createDataFrame([(1, 1, START, 1.234, 5.0)], "row int, col int, obs_date date, tmin double, tmax double")
    grid.write_tiles(daily, str(tmp_path / "t"), 4)
    grid.write_tiles(daily.withColumn("tmin", F.lit(2.0)), str(tmp_path / "t"), 4)
    assert [r.tmin for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [200]


def test_precipitation(spark):
    v = [0.0, 1.0, 2.0, 40.0, 3.0, 200.0, None]
    x = qa_prcp.prepare(spark.createDataFrame([(1, START + dt.timedelta(i), a) for i, a in enumerate(v)], "station_id int, obs_date date, prcp double"))
    out = {(r.obs_date - START).days: r.qflag for r in qa_prcp.gap(qa_prcp.impossible(x)).collect()}
    assert out[5] == "X" and out[3] == "G" and out[1] == ""


def test_leave_one_out(spark):
    r = np.random.default_rng(7)
    s = spark.createDataFrame([(i, float(x), float(y), float(e)) for i, (x, y, e) in enumerate(r.uniform(0, 3, (40, 3)))], "station_id int, lon double, lat double, elev double")
    v = s.select("station_id", F.lit(1).alias("month"), (F.col("lon") * 2 - F.col("elev") + 1).alias("value"))
    loo = interp.leave_one_out(s, v, 20)
    assert loo.agg(F.max(F.abs(F.col("obs") - F.col("pred")))).first()[0] < 1e-6


def test_archive_formats(spark, tmp_path):
    def write(name, *lines):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        return str(tmp_path / name)

    day = lambda v, q=" ": f"{v:5d} {q} "
    line = lambda e, vals: f"USC00011084200102{e}" + "".join(vals) + day(-9999) * (31 - len(vals))
    got = {r.obs_date.day: r for r in text.ghcn_daily(spark, write("a.dly", line("TMAX", [day(123), day(-9999), day(50, "G")]), line("TMIN", [day(-20)]), line("PRCP", [day(254)]))).collect()}
    assert len(got) == 28 and got[1].tmax == 12.3 and got[1].tmin == -2.0 and got[1].prcp == 2.54 and got[2].tmax is None and got[3].qflag_tmax == "G"
    stn = f"{'USC00011084':11} {31.0581:8.4f} {-87.0547:9.4f} {25.9:6.1f} {'AL':2} {'BREWTON 3 SSE':30} {'':3} {'HCN':3} 72223"
    s = text.ghcn_stations(spark, write("s.txt", stn, stn.replace("USC", "USS"), stn.replace(" AL ", " HI "), "FR" + stn[2:])).collect()
    assert len(s) == 1 and s[0].lat == 31.0581 and s[0].station_name == "BREWTON 3 SSE" and s[0].hcn
    raws = text.raws_daily(spark, write("r.txt", "head", "01/02/2001 1 2 3 4 5 6 7 8 20.5 -1.5 11 12 13 2.0", "Copyright x"), "RAWS_X").collect()
    assert len(raws) == 1 and raws[0].tmax == 20.5 and raws[0].tmin == -1.5 and raws[0].prcp == pytest.approx(0.2)
    sno = text.snotel_daily(spark, write("n.csv", "x", "y", "Site Id,Date,Time,TMIN.D-1 (degC) ,TMAX.D-1 (degC) ", "302,2001-01-02,,-99.9,3.5"), "NRCS_302").collect()
    assert sno[0].obs_date == START and sno[0].tmin is None and sno[0].tmax == 3.5
    u = text.ushcn_monthly(spark, write("u.txt", "USH00011084 2001" + " " + " 1234   " + " " + "-9999   " + "".join(f"{i:6d}   " for i in range(10))[1:])).where("month <= 2").orderBy("month").collect()
    assert u[0].value == pytest.approx(12.34) and u[1].value is None
    t = text.tobs(spark, write("t.txt", "USC0001108420010203  0700", "USC0001108420010204    -1")).orderBy("obs_date").collect()
    assert t[0].tobs == 700 and t[1].tobs is None
    log = " " * 10 + "USH00011084" + " " * 4 + "200001" + " " * 14 + "200112" + " " * 24 + " -0.50"
    p = text.pha_log(spark, write("p.log", log)).first()
    assert (p.ymd_start, p.ymd_end, p.adj) == (20000101, 20011231, -0.5)
    assert {r.key: r.value for r in text.parameters(spark, write("c.ini", "a = 1 # no", "# b=2", "c=x=y")).collect()} == {"a": "1", "c": "x=y"}


def test_stream(spark, tmp_path):
    rows = [(1, dt.datetime(2001, 1, d, h), float(d * h)) for d in range(1, 8) for h in (1, 12, 23)]
    spark.createDataFrame(rows, "station_id int, ts timestamp, value double").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("station_id int, ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = daily_range(s).writeStream.outputMode("append").format("memory").queryName("rolled").start()
    q.processAllAvailable()
    q.stop()
    got = {r.obs_date.day: (r.tmin, r.tmax) for r in spark.sql("select * from rolled").collect()}
    assert got and all(v == (float(d), float(d * 23)) for d, v in got.items())


def test_upper_air(spark):
    r = np.random.default_rng(8)
    cells = spark.createDataFrame([(i, float(i % 3), 40.0 + i // 3) for i in range(9)], "cell_id int, lon double, lat double")
    base = r.standard_normal(40)
    values = spark.createDataFrame([(c, START + dt.timedelta(i), v, float(base[i] * (c + 1) + 0.01 * r.standard_normal())) for c in range(9) for i in range(40) for v in ("air", "hgt")], "cell_id int, obs_date date, var string, value double")
    pts = spark.createDataFrame([(1, 1.0, 41.0)], "station_id int, lon double, lat double")
    m = infill.upper_air_matrix(pts, cells, values)
    assert m.count() == 40 and len(m.first().x) == 8
    scores = infill.upper_air_scores(m)
    got = scores.toPandas().sort_values("obs_date")
    assert (got.pcs.map(len) == 1).all() and abs(np.corrcoef(got.pcs.map(lambda p: p[0]), base)[0, 1]) > 0.99
    rows = spark.createDataFrame([(1, 1, START + dt.timedelta(i), 1.0, [None if i == 3 else 1.0, None]) for i in range(40)], "station_id int, month int, obs_date date, value double, nghs array<double>")
    out = infill.add_components(rows, scores).collect()
    assert all(len(x.nghs) == 3 and x.nghs[-1] is not None for x in out)


def test_interpolate_range(spark):
    r = np.random.default_rng(9)
    s = spark.createDataFrame([(i, float(x), float(y), float(e)) for i, (x, y, e) in enumerate(r.uniform(0, 3, (40, 3)))], "station_id int, lon double, lat double, elev double")
    m = spark.createDataFrame([(1,), (2,)], "month int")
    norms = s.crossJoin(m).select("station_id", "month", (10 - F.col("elev")).alias("tmin"), (20 - F.col("elev")).alias("tmax"))
    d = spark.createDataFrame([(START + dt.timedelta(i),) for i in range(59)], "obs_date date")
    daily = s.crossJoin(d).select("station_id", "obs_date", (10 - F.col("elev") + F.when(F.dayofyear("obs_date") == 20, 12.0).otherwise(1.0)).alias("tmin"), (20 - F.col("elev")).alias("tmax"))
    pts = spark.createDataFrame([(1, 1.5, 1.5, 1.0)], "point_id int, lon double, lat double, elev double")
    day, normal = interp.interpolate_range(pts, s, daily, norms, 20, 20, (2001, 2001))
    got = {x.obs_date.timetuple().tm_yday: x for x in day.collect()}
    assert len(got) == 59 and got[1].tmin == pytest.approx(10, abs=0.01) and got[20].tmin < got[20].tmax
    n = {x.month: x for x in normal.collect()}
    assert n[2].tmin_norm == pytest.approx(10, abs=0.01) and n[2].tmax_norm == pytest.approx(19, abs=0.01)
