"""Neighbours that cover all days, chosen before the matrix is cut."""

import datetime as dt

import numpy as np
import pytest

from isohyet.operators import infill
from isohyet.tables import table

START = dt.date(2001, 1, 1)


def by_hand(seen, d1, ring, last, least, columns):
    """Ranks kept, one column after the other. seen: days x neighbours by falling d1."""
    n = least
    if last is None:
        n = len(d1)
    else:
        if last > 0:
            n = max(n, sum(r < last for r in ring) + 1)
        while n < len(d1) and (seen[:, :n].sum(1) < least).any():
            n += 1
    n = min(n, len(d1))
    keep = list(range(min(least, n)))
    for j in range(len(keep), n):
        if (seen[:, j] & (seen[:, keep].sum(1) < least)).any():
            keep.append(j)
    return keep[: columns - 1], len(keep)


def frames(spark, seen, d1, ring, last):
    days, n = seen.shape
    daily = [(0, START + dt.timedelta(d), 1.0 if d % 3 else None) for d in range(days)]
    daily += [(j + 1, START + dt.timedelta(d), 1.0 if seen[d, j] else None) for d in range(days) for j in range(n)]
    chosen = [(0, 1, j + 1, d1[j], ring[j]) for j in range(n)]
    return spark.createDataFrame(daily, "station_id int, obs_date date, value double"), spark.createDataFrame(chosen, "station_id int, month int, ngh_id int, d1 double, ring int"), spark.createDataFrame([(0, 1, last)], "station_id int, month int, ring int")


def test_a_day_that_only_the_last_neighbours_hold(spark):
    """30 better neighbours lack a day that the next three alone have."""
    seen = np.ones((31, 36), bool)
    seen[12, :30] = False
    seen[12, 33:] = False
    d1 = [1 - j / 100 for j in range(36)]
    daily, chosen, status = frames(spark, seen, d1, [0] * 36, 0)
    got = sorted(infill.kept_neighbours(daily, chosen, status).collect(), key=lambda r: r["rank"])
    assert [r.ngh_id for r in got] == [1, 2, 3, 31, 32, 33] and {(r.n_kept, r.n_bare) for r in got} == {(6, 0)}
    rows = infill.matrices(daily, chosen).where("station_id = 0 and obs_date = '2001-01-13'").collect()
    assert rows[0].ngh_ids == [1, 2, 3, 31, 32, 33] and [v is not None for v in rows[0].nghs] == [False] * 3 + [True] * 3


@pytest.mark.parametrize("seed", range(4))
def test_against_one_column_after_the_other(spark, seed):
    r = np.random.default_rng(seed)
    seen = r.random((31, 40)) < 0.12 + 0.2 * seed
    d1 = sorted(r.random(40).round(3).tolist(), reverse=True)
    ring = r.integers(0, 4, 40).tolist()
    for last in (0, 3, None):
        daily, chosen, status = frames(spark, seen, d1, ring, last)
        for least, columns in ((3, 31), (7, 12)):
            keep, n = by_hand(seen, d1, ring, last, least, columns)
            got = sorted(infill.kept_neighbours(daily, chosen, status, least, columns).collect(), key=lambda x: x["rank"])
            order = sorted(range(40), key=lambda j: (-d1[j], j + 1))
            assert [x.ngh_id for x in got] == [order[k] + 1 for k in keep]
            assert {x.n_kept for x in got} == {n} and {x.n_bare for x in got} == {int((~seen[:, [order[k] for k in keep]].any(1)).sum())}


def network(spark, n=6, days=59, seed=1):
    r = np.random.default_rng(seed)
    base = np.cumsum(r.standard_normal(days)) / 3
    values = base[:, None] + r.standard_normal(n) + 0.1 * r.standard_normal((days, n))
    gone = r.random((days, n)) < 0.1
    rows = [(j, START + dt.timedelta(d), None if gone[d, j] else float(values[d, j])) for d in range(days) for j in range(n)]
    places = [(j, -100.0 + j % 3 / 3, 40.0 + j // 3 / 3) for j in range(n)]
    return spark.createDataFrame(rows, "station_id int, obs_date date, value double"), spark.createDataFrame(places, "station_id int, lon double, lat double"), values, gone


def test_network_second_pass_and_suspects(spark):
    daily, places, values, gone = network(spark)
    out = table(infill.infill_network(daily, places, step=50.0), "infilled")
    got = out.toPandas()
    assert len(got) == values.size and got.infilled.notna().all() and set(got.status) <= {"covered", "uncovered"}
    err = [abs(x.infilled - values[(x.obs_date - START).days, x.station_id]) for x in got.itertuples() if gone[(x.obs_date - START).days, x.station_id]]
    assert np.mean(err) < 0.25
    bad = infill.suspects(out.where("station_id in (2, 5)").withColumn("reasons", infill.F.when(infill.F.col("station_id") == 2, infill.F.array(infill.F.lit("r2"))).otherwise(infill.F.array().cast("array<string>"))))
    assert [r.station_id for r in bad.collect()] == [2]
    again = infill.second_pass(out, daily, places, bad, step=50.0).toPandas()
    assert len(again) == len(got) and again.infilled.notna().all()
    same = again[again.station_id != 2].sort_values(["station_id", "obs_date"]).infilled.to_numpy() == got[got.station_id != 2].sort_values(["station_id", "obs_date"]).infilled.to_numpy()
    assert same.all()


def test_components_stay_in_the_matrix(spark):
    """Beside neighbours the components have columns of their own, and alone they do."""
    daily, places, values, _ = network(spark)
    base = values.mean(1)
    scores = spark.createDataFrame([(j, START + dt.timedelta(d), [float(base[d]), float(d % 5)]) for j in range(6) for d in range(59)], "station_id int, obs_date date, pcs array<double>")
    chosen, status = infill.grown_candidates(daily, places, step=50.0)
    rows = infill.matrices(daily, infill.kept_neighbours(daily, chosen, status))
    n = {(r.station_id, r.obs_date): len(r.nghs) for r in rows.collect()}
    assert {(r.station_id, r.obs_date): len(r.nghs) - 2 for r in infill.add_components(rows, scores).collect()} == n
    got = infill.infill_network(daily, places, scores=scores, targets=places.where("station_id < 2"), step=50.0).toPandas()
    assert got.infilled.notna().all() and len(got) == 2 * 59


KEY = ["station_id", "month", "ngh_id"]


def statistics_of(spark, n, without, odd=None):
    rows = [(j, m, *((None, None) if (j, m) in without else (1.0, 2.0))) for j in range(n) for m in (1, 2)]
    return spark.createDataFrame(rows + (odd or []), "station_id int, month int, mean double, vari double")


def test_only_finite_statistics_count(spark):
    odd = [(9, 1, float("nan"), 1.0), (9, 2, 1.0, float("inf")), (8, 1, 1.0, 0.0), (8, 2, 1.0, float("nan")), (7, 1, float("-inf"), 1.0)]
    got = infill.with_statistics(statistics_of(spark, 3, {(1, 2)}, odd)).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1), (0, 2), (1, 1), (2, 1), (2, 2)]


@pytest.mark.parametrize("without", [set(), {(1, 1), (2, 1), (3, 1), (4, 2)}])
def test_neighbours_without_statistics_are_as_if_not_there(spark, without):
    """What is searched again and what is left alone together are what one search among
    the stations with statistics gives, and what taking the others away gives."""
    daily, places, _, _ = network(spark, 9)
    s = statistics_of(spark, 9, without)
    found = infill.grown_candidates(daily, places, step=50.0)
    chosen, status, lacking = infill.grown_with_statistics(daily, places, found, s, step=50.0)
    whole, of = infill.grown_candidates(daily, places, step=50.0, usable=infill.with_statistics(s))
    of_each = lambda df: sorted((tuple(r) for r in df.select(*KEY, "ring", "ok").collect()))
    got = of_each(chosen)
    assert got == of_each(whole) and not {(n, m) for _, m, n, *_ in got} & without
    assert sorted(map(str, status.collect())) == sorted(map(str, of.collect()))
    assert bool(without) == (lacking.count() > 0)
    some, left = (x.where("station_id not in (1, 2, 3)") for x in (daily, places))
    alone = infill.grown_candidates(some, left, step=50.0)[0].where("station_id = 0 and month = 1") if without else None
    assert alone is None or of_each(alone) == [r for r in got if r[:2] == (0, 1)]


def test_a_best_one_without_statistics_hides_no_other(spark):
    """Neighbours 1 and 2 lack half of the month, so only the best of them may count."""
    r = np.random.default_rng(3)
    base = r.standard_normal(28) * 5
    daily = [(0, START + dt.timedelta(d), float(base[d]) if d < 14 else None) for d in range(28)]
    daily += [(3, START + dt.timedelta(d), float(base[27 - d])) for d in range(28)]
    for j, noise in ((1, 0.1), (2, 0.5)):
        daily += [(j, START + dt.timedelta(d), float(base[d] + noise * r.standard_normal())) for d in range(14)]
    daily = spark.createDataFrame(daily, "station_id int, obs_date date, value double")
    pairs = spark.createDataFrame([(0, j, 10.0 * j) for j in (1, 2, 3)], "station_id int, ngh_id int, dist_km double")
    of = lambda usable: sorted((x.ngh_id, x.ok) for x in infill.candidates(daily, pairs, usable=usable).collect())
    assert of(None) == [(1, False), (3, True)]
    assert of(infill.with_statistics(statistics_of(spark, 4, {(1, 1)}))) == [(2, False), (3, True)]


def test_network_with_given_statistics(spark):
    daily, places, values, gone = network(spark)
    own = infill.infill_network(daily, places, step=50.0)
    s = statistics_of(spark, 6, {(3, 1), (3, 2)}).drop("mean", "vari").join(daily.groupBy("station_id", infill.F.month("obs_date").alias("month")).agg(infill.F.avg("value").alias("mean"), infill.F.var_pop("value").alias("vari")), ["station_id", "month"])
    s = s.where("station_id <> 3")
    got = infill.infill_network(daily, places, statistics=s, step=50.0).toPandas()
    assert len(got) == own.count() == values.size
    bare = got[got.station_id == 3]  # no statistics of its own: its days stay as they are
    assert all(set(x) == {"no neighbours"} for x in bare.reasons) and bare.infilled.isna().sum() == gone[:, 3].sum()
    rest = got[got.station_id != 3]
    assert rest.infilled.notna().all()
    err = [abs(x.infilled - values[(x.obs_date - START).days, x.station_id]) for x in rest.itertuples() if gone[(x.obs_date - START).days, x.station_id]]
    assert np.mean(err) < 0.3


def test_index_of_agreement_of_identical_series(spark):
    from isohyet.functions import stats

    x = spark.createDataFrame([("a", 2.0, 2.0), ("a", 2.0, 2.0), ("b", 1.0, 2.0), ("b", 3.0, 2.0), ("c", 1.0, None)], "k string, obs double, pred double")
    assert {r.k: r.d1 for r in stats.ioa_d1(x, ["k"], identical=1.0).collect()} == {"a": 1.0, "b": 0.0}
    assert {r.k: r.d1 for r in stats.ioa_d1(x, ["k"]).collect()} == {"a": None, "b": 0.0}
