"""Written stores, mosaics by day, resampled grids."""

import datetime as dt
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from isohyet.operators import grid, store

START = dt.date(2001, 1, 1)


def digests(path):
    return {str(f.relative_to(path)): hashlib.sha256(f.read_bytes()).hexdigest() for f in Path(path).rglob("*.parquet")}


def series(spark, ids, value, days=20):
    return spark.createDataFrame([(i, START + dt.timedelta(d), value + d) for i in ids for d in range(days)], "station_id string, obs_date date, value double")


def test_upsert_leaves_other_folders_alone(spark, tmp_path):
    path = str(tmp_path / "store")
    ids = [f"S{i:03d}" for i in range(60)]
    store.write_store(series(spark, ids, 0.0), path, buckets=16)
    before = digests(path)
    new = series(spark, ["S003", "S041", "NEW"], 100.0, 7)
    folders = store.upsert_store(new, path)
    after = digests(path)
    name = lambda f: int(f.split("bucket=")[1].split("/")[0])
    assert 1 <= len(folders) <= 3
    assert {f: d for f, d in before.items() if name(f) not in folders} == {f: d for f, d in after.items() if name(f) not in folders}
    assert all(name(f) in folders for f in set(after) - set(before))
    rows = store.read_store(spark, path)
    want = series(spark, [i for i in ids if i not in ("S003", "S041")], 0.0).unionByName(new)
    assert rows.exceptAll(want).count() == 0 and want.exceptAll(rows).count() == 0
    # once more: the same rows
    assert store.upsert_store(new, path) == folders
    rows = store.read_store(spark, path)
    assert rows.count() == want.count() and rows.exceptAll(want).count() == 0
    some = store.read_store(spark, path, ["S041", "S007", "absent"])
    assert sorted((r.station_id, r["count"]) for r in some.groupBy("station_id").count().collect()) == [("S007", 20), ("S041", 7)]
    assert store.upsert_store(new.where("false"), path) == []


def test_a_store_is_dealt_in_one_way(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write_store(series(spark, ["A", "B"], 0.0), path, buckets=4)
    store.write_store(series(spark, ["C"], 0.0), path, buckets=8)
    with pytest.raises(ValueError, match="one way"):
        store.upsert_store(series(spark, ["A"], 1.0), path)


def test_yearly_mosaics_in_bounded_ranges(spark, tmp_path):
    """No file holds more than about its share, files are ranges of days, years apart."""
    days = spark.range(0, 500).select(F.date_add(F.lit(START), F.col("id").cast("int")).alias("obs_date"))
    cells = spark.range(0, 100).select((F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"))
    packed = days.crossJoin(cells).withColumns({"tmin": F.lit(1).cast("short"), "tmax": F.lit(2).cast("short")})
    path = str(tmp_path / "mosaic")
    grid.yearly_mosaics(packed, path, rows=2500, block=5)
    files = spark.read.parquet(path).groupBy(F.input_file_name().alias("f"), "year").agg(F.count(F.lit(1)).alias("n"), F.min("obs_date").alias("a"), F.max("obs_date").alias("b")).orderBy("a", "b").collect()
    assert sum(f.n for f in files) == 50_000 and max(f.n for f in files) <= 2 * 2500 and {f.year for f in files} == {2001, 2002}
    assert all(x.b <= y.a for x, y in zip(files, files[1:], strict=False))
    grid.yearly_mosaics(packed.where("year(obs_date) = 2002").withColumn("tmin", F.lit(9).cast("short")), path, rows=2500)
    assert {(r.year, r.tmin) for r in spark.read.parquet(path).select("year", "tmin").distinct().collect()} == {(2001, 1), (2002, 9)}


def test_resampling_keeps_the_sum(spark):
    src = grid.Grid(0.0, 10.0, 0.7, 12, 13)
    cells = spark.createDataFrame([(r, c, float(r * 13 + c)) if (r, c) != (3, 4) else (r, c, None) for r in range(12) for c in range(13)], "row int, col int, value double")
    total = cells.agg(F.sum("value")).first()[0]
    for size in (0.25, 1.0, 2.3):
        t = grid.Grid(-0.3, 10.4, size, int(12 / size) + 2, int(12 / size) + 2)
        out = grid.resample(cells, src, t, "sum")
        assert out.agg(F.sum("value")).first()[0] == pytest.approx(total, rel=1e-9)
        mean = {(r.row, r.col): (r.value, r.share) for r in grid.resample(cells, src, t).collect()}
        if size == 0.25:
            assert mean[12, 10][1] <= 1 + 1e-9 and mean[2, 2] == (0.0, pytest.approx(1.0))
    same = {(r.row, r.col): r.value for r in grid.resample(cells, src, src).collect()}
    assert same == {(r.row, r.col): pytest.approx(r.value) for r in cells.where("value is not null").collect()}
    assert grid.resample(cells, src, grid.Grid(50.0, 10.0, 1.0, 5, 5)).count() == 0
