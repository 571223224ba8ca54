"""Work that has to be spread over tasks, and pairs counted by place."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.operators import interp, spatial


def test_systems_are_dealt_over_tasks(spark):
    """Few bytes, but long work: small partitions are not put together."""
    r = np.random.default_rng(2)
    s = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(r.uniform(0, 5, (60, 3)))], "station_id int, lon double, lat double, elev double")
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(r.uniform(0, 5, (200, 3)))], "point_id int, lon double, lat double, elev double")
    near = spatial.nearest(p, s, 8)
    v = p.select("point_id", F.lit(0.3).alias("nug"), F.lit(1.7).alias("psill"), F.lit(250.0).alias("rng"))
    for weights in (interp.drift_weights(p, near, s, v), interp.gwr_weights(p, near, s)):
        tasks = weights.groupBy(F.spark_partition_id().alias("t")).agg(F.countDistinct("point_id").alias("n")).collect()
        assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(x.n for x in tasks) == 200


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_variograms_of_keys_count_pairs_by_place(spark, monkeypatch, sent):
    monkeypatch.setattr(interp, "SENT", sent)
    r = np.random.default_rng(4)
    place = r.uniform(0, 6, (12, 2)).tolist()
    order = r.permutation(90)
    rows = [(int(order[i]), *place[i % 12], None if i % 17 == 3 else float(r.normal(1e3, 5)), None if i % 11 == 2 else int(i % 4)) for i in range(90)]
    s = spark.createDataFrame(rows, "station_id long, lon double, lat double, r double, zone int")
    want: dict = {}
    for a in rows:
        for b in rows:
            d = interp.kernels.km(a[1], a[2], b[1], b[2])
            if a[0] < b[0] and 0 < d <= 400:
                want.setdefault((a[4], int(d // 50)), []).append((d, None if a[3] is None or b[3] is None else (a[3] - b[3]) ** 2))
    got = {(x.zone, x.bin): x for x in interp.variogram_bins_by(s, "zone", 400.0, 50.0).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        known = [x for _, x in v if x is not None]
        assert got[k].n == len(v) and got[k].h == pytest.approx(np.mean([x for x, _ in v]), rel=1e-12)
        assert got[k].gamma == (pytest.approx(sum(known) / (2 * len(v)), rel=1e-9) if known else None)


def test_pairs_of_stations_are_found_in_many_tasks(spark):
    r = np.random.default_rng(6)
    s = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(r.uniform(0, 3, (80, 2)))], "station_id int, lon double, lat double").coalesce(1)
    pairs = spatial.station_pairs(s, 150.0)
    tasks = pairs.groupBy(F.spark_partition_id().alias("t")).count().collect()
    xy = np.array([x[1:] for x in s.collect()])
    d = interp.kernels.km(xy[:, :1], xy[:, 1:], xy[:, 0], xy[:, 1])
    assert len(tasks) >= 4 and sum(x["count"] for x in tasks) == (d <= 150).sum() - 80
