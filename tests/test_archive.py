"""Station files through the data source, and small operators that had no test."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

from isohyet.functions import kernels
from isohyet.functions.scalars import is_close
from isohyet.operators import homog, infill, qa_prcp
from isohyet.operators import stations as st
from isohyet.sources import archive, schema, text

START = dt.date(2001, 1, 1)


def put(folder, name, *lines):
    (folder / name).write_text("\n".join(lines) + "\n")


def ghcn_line(code, month, element, values):
    return f"{code}2001{month:02d}{element}" + "".join(f"{v:5d} {q} " for v, q in [*values, *[(-9999, " ")] * (31 - len(values))])


def files(tmp_path):
    for kind in ("ghcn", "snotel", "raws"):
        (tmp_path / kind).mkdir()
    for code in ("USC00000001", "USC00000002"):
        put(tmp_path / "ghcn", f"{code}.dly", *[ghcn_line(code, m, e, [(10 * m + d, "G" if d == 2 else " ") for d in range(28)]) for m in (1, 2) for e in ("TMIN", "TMAX", "PRCP", "SNOW")])
    for code in ("302", "303"):
        put(tmp_path / "snotel", f"{code}.csv", "x", "y", "Site Id,Date,Time,TMIN.D-1 (degC) ,TMAX.D-1 (degC) ", *[f"{code},2001-01-{d:02d},,{-99.9 if d == 3 else d},{d + 10}" for d in range(1, 29)])
    for code in ("ABCD", "WXYZ"):
        put(tmp_path / "raws", f"{code}.txt", "head", *[f"01/{d:02d}/2001 1 2 3 4 5 6 7 8 {d + 10}.5 {d}.0 11 12 13 {d}.0" for d in range(1, 29)], "Copyright x")


@pytest.mark.parametrize("kind,ending,stations,days", [("ghcn", "dly", 2, 59), ("snotel", "csv", 2, 28), ("raws", "txt", 2, 28)])
def test_a_partition_a_file_and_bounds_in_the_reader(spark, tmp_path, kind, ending, stations, days):
    files(tmp_path)
    archive.register(spark)
    read = spark.read.format("station_files").option("kind", kind).load(str(tmp_path / kind / f"*.{ending}"))
    assert read.rdd.getNumPartitions() == 2
    rows = read.collect()
    assert len(rows) == stations * days and len({r.station_id for r in rows}) == stations
    bounded = read.where("obs_date >= '2001-01-05' and obs_date < '2001-01-08' and tmax is not null")
    got = bounded.collect()
    assert sorted({r.obs_date.day for r in got}) == [5, 6, 7] and len(got) == 6
    plan = bounded._jdf.queryExecution().executedPlan().toString()
    assert not any("obs_date" in line for line in plan.splitlines() if "Filter" in line and "Scan" not in line)  # Spark no longer filters days
    options = spark.read.format("station_files").option("kind", kind).option("first", "2001-01-20").option("last", "2001-01-21").load(str(tmp_path / kind / f"*.{ending}"))
    assert options.count() == 4
    # the same rows as the readers of text give
    if kind == "ghcn":
        want = text.ghcn_daily(spark, str(tmp_path / kind))
        columns = ["station_id", "obs_date", "tmin", "tmax", "prcp", "qflag_tmin", "qflag_tmax", "qflag_prcp"]
        assert sorted(map(tuple, want.select(*columns).collect())) == sorted(tuple(r) for r in rows)
    elif kind == "raws":
        want = text.raws_daily(spark, str(tmp_path / kind / "ABCD.txt"), "RAWS_ABCD")
        assert sorted((r.obs_date, r.tmin, r.tmax, round(r.prcp, 9)) for r in want.collect()) == sorted((r.obs_date, r.tmin, r.tmax, round(r.prcp, 9)) for r in rows if r.station_id == "RAWS_ABCD")
    else:
        want = text.snotel_daily(spark, str(tmp_path / kind / "302.csv"), "NRCS_302")
        assert sorted(((r.obs_date, r.tmin, r.tmax) for r in want.collect()), key=str) == sorted(((r.obs_date, r.tmin, r.tmax) for r in rows if r.station_id == "NRCS_302"), key=str)


def test_filters_that_the_reader_takes():
    r = archive.StationReader([], archive.raws, dt.date(2000, 1, 1), None)
    rest = list(r.pushFilters([GreaterThan(("obs_date",), dt.date(2001, 5, 1)), LessThanOrEqual(("obs_date",), dt.date(2001, 6, 1)), EqualTo(("station_id",), "X")]))
    assert [f.attribute for f in rest] == [("station_id",)] and (r.first, r.last) == (dt.date(2001, 5, 2), dt.date(2001, 6, 1))


def test_kinds_of_ones_own(spark, tmp_path):
    def pairs(lines, station, first, last):
        for i, line in enumerate(lines):
            yield station, START + dt.timedelta(i), float(line), None, None, "", "", ""

    put(tmp_path, "S1.txt", "1.5", "2.5")
    archive.register(spark, pairs=pairs)
    got = spark.read.format("station_files").option("kind", "pairs").load(str(tmp_path / "*.txt")).collect()
    assert sorted((r.station_id, r.obs_date, r.tmin) for r in got) == [("S1", START, 1.5), ("S1", START + dt.timedelta(1), 2.5)]
    with pytest.raises(Exception, match="kind is one of"):
        spark.read.format("station_files").option("kind", "none").load(str(tmp_path)).collect()


def test_lists_of_stations(spark):
    s = spark.createDataFrame([(1, 0.5, True, 3, True), (2, None, True, 3, False), (3, 0.1, True, None, None), (4, 0.2, False, None, True)], "station_id int, tdi double, mask boolean, climdiv int, bad boolean")
    other = spark.createDataFrame([(9,), (1,)], "station_id int")
    assert sorted(r.station_id for r in st.bad_stations(s, other).collect()) == [1, 2, 3, 9]
    assert {r.station_id: r.bad for r in st.set_bad(s, other).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert {r.station_id: r.bad for r in st.set_bad(s, other, reset=False).collect()} == {1: True, 2: False, 3: False, 4: True}
    assert sorted(r.station_id for r in homog.usable(s, other).collect()) == [2, 3, 4]
    assert sorted(r.station_id for r in st.good_stations(s).collect()) == [2, 3]
    assert sorted(r.station_id for r in st.in_domain(s).collect()) == [1, 2, 3]
    assert sorted(r.station_id for r in st.validation_ids(s, other, other, s.where("station_id = 3")).collect()) == [1, 3]
    serial = spark.createDataFrame([(2, START, 1.0), (4, START, None)], "station_id int, obs_date date, value double")
    assert st.complete(serial, s.where("station_id = 2")) and not st.complete(serial, s.where("station_id = 4"))


def test_closeness(spark):
    x = spark.createDataFrame([(1.0, 1.0 + 5e-6), (1.0, 1.00002), (0.0, 5e-9), (0.0, 1e-7)], "a double, b double")
    assert [r.c for r in x.select(is_close(F.col("a"), F.col("b"), 1e-5, 1e-8).alias("c")).collect()] == [bool(np.isclose(a, b)) for a, b in ((1.0, 1.0 + 5e-6), (1.0, 1.00002), (0.0, 5e-9), (0.0, 1e-7))]


def test_bad_infill(spark):
    r = np.random.default_rng(2)
    calm, wild = r.standard_normal(400), np.concatenate([r.standard_normal(200), 30 * r.standard_normal(200)])
    rows = [(i, START + dt.timedelta(d), float(v)) for i, x in ((1, calm), (2, wild), (3, np.append(calm[:399], 70.0))) for d, v in enumerate(x)]
    got = sorted((x.station_id, x.reason) for x in infill.bad_infill(spark.createDataFrame(rows, "station_id int, obs_date date, infilled double")).collect())
    assert (2, "variance change") in got and (3, "impossible value") in got and 1 not in {i for i, _ in got}


def test_infill_cross_validation(spark):
    """Days held back are predicted without having been seen; a poor fit has its reasons."""
    r = np.random.default_rng(4)
    base = np.cumsum(r.standard_normal(59)) / 3
    values = {(j, d): float(base[d] + j + 0.05 * r.standard_normal()) for j in range(5) for d in range(59)}
    daily = spark.createDataFrame([(j, START + dt.timedelta(d), v) for (j, d), v in values.items()], "station_id int, obs_date date, value double")
    pairs = spark.createDataFrame([(a, b, 10.0) for a in range(5) for b in range(5) if a != b], "station_id int, ngh_id int, dist_km double")
    split = daily.where("station_id = 0").withColumn("train", F.day("obs_date") % 7 != 0)
    got = {x.station_id: x for x in infill.cross_validate(daily.where("station_id > 0").unionByName(daily.where("station_id = 0")), split, pairs).collect()}
    assert set(got) == {0} and got[0].mae < 0.3
    noise = spark.createDataFrame([(j, START + dt.timedelta(d), None if j == 0 and d % 4 == 0 else float(20 * r.standard_normal())) for j in range(5) for d in range(31)], "station_id int, obs_date date, value double")
    rows = infill.matrices(noise, pairs.select("station_id", F.lit(1).alias("month"), "ngh_id", F.lit(0.5).alias("d1")))
    stats = infill.monthly_statistics(rows)
    bad = infill.infill(rows, stats, explain=0.3).where("station_id = 0").select("reasons").distinct().collect()
    assert len(bad) == 1 and set(bad[0].reasons) & {"mae", "r2"}


def test_precipitation_drivers(spark):
    r = np.random.default_rng(6)
    rain = [(j, START + dt.timedelta(d), 500.0 if (j, d) == (1, 100) else float(max(0.0, r.normal(0, 2)))) for j in range(4) for d in range(300)]
    x = spark.createDataFrame(rain, "station_id int, obs_date date, prcp double").withColumn("tavg", F.lit(10.0))
    one = qa_prcp.run_non_spatial(x)
    assert one.count() == 1200 and {(r.station_id, r.obs_date) for r in one.where("qflag = 'X'").collect()} == {(1, START + dt.timedelta(100))}
    pairs = spark.createDataFrame([(a, b, 10.0) for a in range(4) for b in range(4) if a != b], "station_id int, ngh_id int, dist_km double")
    both = qa_prcp.run_all(x, pairs)
    assert both.count() == 1200 and both.where("qflag = 'X'").count() == 1


def test_adjustments_and_monthly_files(spark, tmp_path):
    seg = spark.createDataFrame([(1, 19950101, 19961231, 0.5), (1, 19970101, 19991231, 0.0)], "station_id int, ymd_start int, ymd_end int, adj double")
    more = spark.createDataFrame([(2, 19950101, 19961231, -0.25)], "station_id int, ymd_start int, ymd_end int, adj double")
    s = spark.createDataFrame([(1, "A"), (2, "B")], "station_id int, station_name string")
    got = sorted(tuple(r) for r in homog.adjustment_report(st.union_all([seg, more]), s, "tmin").collect())
    assert got == [(1, "tmin", "199701", -0.5, "A"), (2, "tmin", "199701", 0.25, "B")]
    table = homog.adjustment_table(seg, more, s)
    assert sorted((r.station_id, r.elem, r.adj) for r in table.collect()) == [(1, "tmin", -0.5), (2, "tmax", 0.25)]
    m = spark.createDataFrame([("U1", "tmin", y, mo, float(y + mo)) for y in (1999, 2000, 2001) for mo in (1, 2, 12)] + [("U2", "tmax", 2000, 1, 5.0)], "station_id string, elem string, year int, month int, value double")
    text.write_monthly_means(m, str(tmp_path / "m"))
    back = text.read_monthly(spark, str(tmp_path / "m"), 2000, 2001, elem="tmin", ids=spark.createDataFrame([("U1",)], "station_id string"))
    assert sorted((r.station_id, r.year, r.month, r.value) for r in back.collect()) == [("U1", y, mo, float(y + mo)) for y in (2000, 2001) for mo in (1, 2, 12)]
    wide = text.monthly_series(back).orderBy("station_id", "year").collect()
    assert [(r.year, r["values"][:3]) for r in wide] == [(2000, [2001.0, 2002.0, None]), (2001, [2002.0, 2003.0, None])]


def test_d1_of_constant_series():
    assert kernels.d1(np.ones(5), np.ones(5)) == 1.0


def test_schemas(spark, tmp_path):
    variables = [("tmin", "double", None, "daily minimum", "C"), ("n", "int", -1, "count", None)]
    s = spark.createDataFrame([("A",), ("B",)], "station_id string")
    days = spark.createDataFrame([(START + dt.timedelta(i),) for i in (1, 0, 1)], "obs_date date")
    cube = schema.observations_of(s, days, variables)
    cube.write.parquet(str(tmp_path / "cube"))
    back = spark.read.parquet(str(tmp_path / "cube"))
    assert back.schema["tmin"].metadata == {"comment": "daily minimum", "units": "C"} and back.schema["n"].metadata["fill"] == -1
    assert sorted(map(tuple, back.collect())) == [(i, START + dt.timedelta(d), None, -1) for i in "AB" for d in (0, 1)]
    for name in schema.TABLES:
        assert schema.empty(spark, name).count() == 0
    x = schema.conform(spark.createDataFrame([(7, 1.5, "x")], "month int, norm double, other string").withColumn("station_id", F.lit(3)), "station_month")
    assert x.schema.names[0] == "station_id" and x.first().station_id == "3" and x.first().norm == 1.5 and x.first().lst is None
