"""Points in polygons against counting crossings of every edge."""

import numpy as np
import pytest
from pyspark.sql import Row

from isohyet.operators import stations, zones

SCHEMA = "zone_id int, rings array<array<struct<lon:double,lat:double>>>"


def crossings(x, y, rings):
    odd = False
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (x0 <= x) != (x1 <= x) and y0 + (x - x0) * (y1 - y0) / (x1 - x0) > y:
                odd = not odd
    return odd


def by_hand(points, polygons):
    out = {}
    for i, x, y in points:
        inside = [z for z, rings in polygons if x is not None and y is not None and crossings(x, y, rings)]
        out[i] = min(inside) if inside else None
    return out


def star(r, x, y, size, n=9):
    a = np.sort(r.uniform(0, 2 * np.pi, n))
    return [(float(x + s * np.cos(t)), float(y + s * np.sin(t))) for t, s in zip(a, r.uniform(size / 3, size, n), strict=True)]


@pytest.mark.parametrize("size", [0.35, 1.0, 7.0])
def test_random_polygons_with_holes(spark, size):
    r = np.random.default_rng(int(size * 100))
    polygons = []
    for z in range(12):
        x, y = r.uniform(-110, -90), r.uniform(30, 45)
        polygons.append((z, [star(r, x, y, 5), star(r, x, y, 1.2), star(r, x + 4, y + 3, 2)]))
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(r.uniform([-116, 24], [-84, 51], (1500, 2)))]
    points += [(5000, None, 40.0), (5001, -100.0, None), (5002, 0.0, 0.0)]
    p = spark.createDataFrame(points, "i int, lon double, lat double")
    z = spark.createDataFrame([(k, [[Row(lon=a, lat=b) for a, b in ring] for ring in rings]) for k, rings in polygons], SCHEMA)
    got = {x.i: x.zone_id for x in zones.zone_of(p, z, size).collect()}
    assert got == by_hand(points, polygons) and sum(v is not None for v in got.values()) > 100


def test_borders_belong_to_one_zone(spark):
    """Boxes that touch on round numbers and on cell borders: every point once."""
    boxes = [(k, [[(10.0 * i, 10.0 * j), (10.0 * i + 10, 10.0 * j), (10.0 * i + 10, 10.0 * j + 10), (10.0 * i, 10.0 * j + 10)]]) for k, (i, j) in enumerate((i, j) for i in range(3) for j in range(3))]
    points = [(i * 100 + j, i * 2.5, j * 2.5) for i in range(13) for j in range(13)]
    p = spark.createDataFrame(points, "i int, lon double, lat double")
    z = spark.createDataFrame([(k, [[Row(lon=a, lat=b) for a, b in ring] for ring in rings]) for k, rings in boxes], SCHEMA)
    got = {x.i: x.zone_id for x in zones.zone_of(p, z, 2.5).collect()}
    assert got == by_hand(points, boxes)
    for i, x, y in points:
        assert got[i] == ((x // 10) * 3 + y // 10 if x < 30 and y < 30 else None)


def test_closed_rings_repeated_points_no_zones(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]
    z = spark.createDataFrame([(1, [[Row(lon=a, lat=b) for a, b in ring]]), (2, []), (3, None)], SCHEMA)
    p = spark.createDataFrame([(1.0, 1.0, "x"), (1.0, 1.0, "y"), (3.0, 3.0, "z")], "lon double, lat double, r string")
    assert sorted((x.r, x.zone_id) for x in zones.zone_of(p, z).collect()) == [("x", 1), ("y", 1), ("z", None)]
    assert [x.zone_id for x in zones.zone_of(p, z.where("zone_id = 2")).collect()] == [None] * 3
    h = spark.createDataFrame([(1, -7)], "zone_id int, hours int")
    got = {x.r: x.utc_offset for x in zones.utc_offset(p, z, h).collect()}
    assert got == {"x": -7, "y": -7, "z": 0}


def test_boxes_that_overlap_give_a_station_once(spark):
    boxes = spark.createDataFrame([(-110.0, -100.0, 30.2, 40.7, -7), (-105.0, -90.0, 35.0, 45.0, -6), (0.0, 0.0, 1.0, 2.0, 9)], "lon0 double, lon1 double, lat0 double, lat1 double, hours int")
    s = spark.createDataFrame([(1, -102.0, 38.0), (2, -95.0, 38.0), (3, -95.0, 45.0), (4, -110.0, 30.2), (5, -100.0, 31.0), (6, None, 38.0)], "station_id int, lon double, lat double")
    assert {r.station_id: r.utc_offset for r in stations.utc_offset(s, boxes).collect()} == {1: -7, 2: -6, 3: -6, 4: -7, 5: -7, 6: None}
