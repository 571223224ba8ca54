"""Readers and writers of station files on small files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from isohyet.functions.stats import mean_and_deviation
from isohyet.sources import text


def put(tmp_path, name, *lines):
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    return str(tmp_path / name)


def test_inventories(spark, tmp_path):
    inventory = text.snotel_inventory(spark, put(tmp_path, "inventory.csv", "station id,cdbs_id,site_name, state,lat,lon,elev,start_date,end_date", "302,17d02s, Aneroid lake ,or,45.21,-117.19,7400,1980-10-01,2100-01-01")).collect()
    assert inventory[0]["site_name"] == "ANEROID LAKE" and inventory[0]["state"] == "OR" and inventory[0]["elev"] == pytest.approx(7400 * 0.3048)
    raws = text.raws_stations(spark, put(tmp_path, "raws.txt", "  ABCD 198501 201012 45.5 110.25 1500 Bear Creek Ridge", "WXYZ 199001 201012 44.0 111.00 900 Low"))
    assert [tuple(x) for x in raws.orderBy("station_id").collect()] == [("RAWS_ABCD", "Bear Creek Ridge", -110.25, 45.5, 1500.0), ("RAWS_WXYZ", "Low", -111.0, 44.0, 900.0)]
    ghcn = spark.createDataFrame([("GHCND_USR0000ABCD",), ("GHCND_USC0000WXYZ",)], "station_id string")
    assert [x.station_id for x in text.raws_in_ghcn(raws, ghcn).collect()] == ["RAWS_ABCD"]


def test_observation_times_and_histories(spark, tmp_path):
    path = put(tmp_path, "2001.csv", "USC00000001,20010102,TMAX,111,,,7,0700", "USC00000001,20010103,TMAX,111,,,7,2400", "USC00000001,20010104,TMIN,50,,,7,0800", "MXN00000001,20010105,TMAX,50,,,7,", "FR000000001,20010105,TMAX,50,,,7,0900")
    assert [tuple(x) for x in text.tobs_lines(spark, path, "TMAX").collect()] == [("USC00000001", dt.date(2001, 1, 2), 700)]
    history = text.sensor_history(spark, put(tmp_path, "sensors.csv", "station_id,date_new_sensor", "302,1999-07-15", "303,unknown")).collect()
    assert [tuple(x) for x in sorted(history)] == [("NRCS_302", dt.date(1999, 7, 15)), ("NRCS_303", None)]
    ids = text.id_list(spark, put(tmp_path, "a.txt", "S1", " S2 ", ""), put(tmp_path, "b.txt", "S2", "S3"))
    assert sorted(x.station_id for x in ids.collect()) == ["S1", "S2", "S3"]


def test_unions(spark, tmp_path):
    a, b = put(tmp_path, "a.csv", "station_id,x", "A,1"), put(tmp_path, "b.csv", "station_id,y", "B,2")
    both = text.union_files(spark, [a, b], lambda p: spark.read.option("header", True).csv(p), lambda d: d.withColumn("station_id", F.lower("station_id")))
    assert sorted(tuple(x) for x in both.select("station_id", "x", "y").collect()) == [("a", "1", None), ("b", None, "2")]
    s = lambda *ids: spark.createDataFrame([(i,) for i in ids], "station_id string")
    assert [x.station_id for x in text.load_stations(s("C", "A"), s("B")).collect()] == ["A", "B", "C"]


def test_observations_written_and_read(spark, tmp_path):
    rows = [("A", dt.date(2001, m, 1), float(m), m + 10.0, "X" if m == 3 else "", "") for m in range(1, 13)] + [("B", dt.date(2001, 1, 1), 1.0, 2.0, "", "")]
    obs = spark.createDataFrame(rows, "station_id string, obs_date date, tmin double, tmax double, qflag_tmin string, qflag_tmax string")
    path = str(tmp_path / "obs")
    text.write_observations(obs, path)
    some = text.read_observations(spark, path, "2001-02-01", "2001-11-30", spark.createDataFrame([("A",)], "station_id string"), "tmin", months=(3, 4, 12))
    assert [(x.obs_date.month, x.tmin) for x in some.orderBy("obs_date").collect()] == [(3, None), (4, 4.0)]
    raw = text.read_observations(spark, path, unflagged=False)
    assert raw.columns == ["station_id", "obs_date", "tmin", "tmax"] and raw.where("tmin is null").count() == 0
    got = {x.station_id: (x["mean"], x["std"]) for x in mean_and_deviation(raw.withColumnRenamed("tmin", "value"), ["station_id"]).collect()}
    assert got["A"] == (6.5, pytest.approx(3.4520525)) and got["B"] == (1.0, 0.0)
    assert text.add_column(raw, "note", "string").where("note is null").count() == 13


def test_fixed_width_writers(spark, tmp_path):
    stations = spark.createDataFrame([("GHCND_USC00000001", 45.5, -110.25)], "station_id string, lat double, lon double")
    text.write_station_list(stations, str(tmp_path / "list"))
    line = spark.read.text(str(tmp_path / "list")).first()[0]
    assert line == "USC00000001  45.5000 -110.2500"
    monthly = spark.createDataFrame([("GHCND_USC00000001", 2001, m, None if m == 2 else m + 0.25) for m in range(1, 13)], "station_id string, year int, month int, mean double")
    text.write_monthly(monthly, str(tmp_path / "monthly"))
    back = {x.month: x.value for x in text.ushcn_monthly(spark, str(tmp_path / "monthly")).collect()}
    assert back == {m: None if m == 2 else m + 0.25 for m in range(1, 13)}


def test_location_failures_file(spark, tmp_path):
    failed = spark.createDataFrame([("A", "Bear, Creek", -110.0, 45.0, 900.0, 1400.0, -500.0, None, 45.0, None)], "station_id string, station_name string, longitude double, latitude double, elevation double, elevation_dem double, elevation_dif double, longitude_qa double, latitude_qa double, elevation_qa double")
    text.write_location_failures(failed, str(tmp_path / "failures"))
    got = spark.read.option("header", True).csv(str(tmp_path / "failures")).collect()
    assert got[0].station_name == "Bear  Creek" and got[0].elevation_dif == "-500.0" and got[0].longitude_qa is None
