"""Stations: unions, matching, duplicates, flags, serial series, location checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions.scalars import is_close


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_distinct(frames: list[DataFrame], key: str = "station_id") -> DataFrame:
    return union_all([f.select(key) for f in frames]).distinct()


def within(df: DataFrame, ids: DataFrame, key: str = "station_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def without(df: DataFrame, ids: DataFrame, key: str = "station_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the last row by order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def cascade_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """a's (station_id, station_name, state, lon, lat) with b's match: b_id by the last
    six characters of the id where that is unique in b, else by name and state, else by
    coordinates to four decimals, else 'NONE'."""

    def step(df, keys, name):
        one = df.groupBy(*keys.values()).agg(F.count(F.lit(1)).alias("_n"), F.min("station_id").alias(name)).where("_n = 1").drop("_n")
        return one.toDF(*keys.keys(), name)

    tail = F.right(F.col("station_id").cast("string"), F.lit(6))
    round4 = {"_x": F.round("lon", 4), "_y": F.round("lat", 4), "_t": tail}
    left, right = a.withColumns(round4), b.withColumns(round4)
    left = left.join(step(right, {"_t": "_t"}, "_b1"), "_t", "left").join(step(right, {"station_name": "station_name", "state": "state"}, "_b2"), ["station_name", "state"], "left").join(step(right, {"_x": "_x", "_y": "_y"}, "_b3"), ["_x", "_y"], "left")
    return left.select("station_id", F.coalesce(F.col("_b1").cast("string"), F.col("_b2").cast("string"), F.col("_b3").cast("string"), F.lit("NONE")).alias("b_id"))


def duplicate_stations(stations: DataFrame, infilled: DataFrame) -> DataFrame:
    """Stations at one place as another but with more infilled days (station_id, n)
    than the least there; ties stay."""
    w = Window.partitionBy("lon", "lat")
    x = stations.join(infilled, "station_id").withColumns({"_c": F.count(F.lit(1)).over(w), "_m": F.min("n").over(w)})
    return x.where("_c > 1 and n <> _m").select("station_id")


def set_bad(stations: DataFrame, bad: DataFrame, reset: bool = True) -> DataFrame:
    """stations with bad true for the ids given; unknown ids are ignored."""
    old = F.coalesce("bad", F.lit(False)) if "bad" in stations.columns and not reset else F.lit(False)
    return stations.join(bad.select("station_id").distinct().withColumn("_b", F.lit(True)), "station_id", "left").withColumn("bad", F.coalesce("_b", old)).drop("_b")


def bad_stations(stations: DataFrame, *others: DataFrame) -> DataFrame:
    """Bad by themselves (no tdi, or in the mask without climdiv) or by other lists."""
    own = stations.where("tdi is null or (mask and climdiv is null)")
    return union_distinct([own, *others])


def good_stations(stations: DataFrame) -> DataFrame:
    """Stations that are not bad; not marked is good."""
    return stations.where(~F.coalesce(F.col("bad"), F.lit(False)))


def in_domain(stations: DataFrame) -> DataFrame:
    """Stations inside the mask; without a mask they are outside."""
    return stations.where(F.coalesce(F.col("mask"), F.lit(False)))


def validation_ids(stations: DataFrame, *lists: DataFrame) -> DataFrame:
    """The stations (station_id) of the lists that there are, each once."""
    return within(union_distinct([*lists]), stations)


def complete(serial: DataFrame, good: DataFrame) -> bool:
    """Whether no value of a good station is missing."""
    return serial.join(good.select("station_id"), "station_id", "left_semi").where("value is null").isEmpty()


def longest_run(df: DataFrame, flag: str) -> DataFrame:
    """station_id, run: the most consecutive dense days with the flag (0 if none)."""
    day = Window.partitionBy("station_id").orderBy("obs_date")
    x = df.withColumn("_i", F.row_number().over(day) - F.sum(F.col(flag).cast("int")).over(day.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.groupBy("station_id", F.when(F.col(flag), F.col("_i")).alias("_i")).agg(F.count_if(flag).alias("n"))
    return runs.groupBy("station_id").agg(F.max("n").alias("run"))


def serially_complete(infill: DataFrame, max_run: int = 1826) -> DataFrame:
    """station_id, obs_date, value, flag_infilled from (value, infilled): observed
    days keep their value; a station with max_run infilled days in a row takes all
    days from the infill model."""
    x = infill.withColumn("_f", F.col("value").isNull())
    x = x.join(longest_run(x, "_f"), "station_id")
    take = F.col("_f") | (F.col("run") >= max_run)
    return x.select("station_id", "obs_date", F.when(take, F.col("infilled")).otherwise(F.col("value")).alias("value"), take.alias("flag_infilled"))


def upsert_infill(old: DataFrame, new: DataFrame) -> DataFrame:
    """Series of the stations in new replace those in old."""
    return without(old, new.select("station_id").distinct()).unionByName(new)


def aux_series(raw: DataFrame, homog: DataFrame, serial: DataFrame, good: DataFrame, first: int, last: int) -> DataFrame:
    """Raw, homogenised (null where infilled) and infilled values of good stations and
    a range of years; each input is station_id, obs_date, value."""
    key = ["station_id", "obs_date"]
    s = within(serial, good).where(F.year("obs_date").between(first, last)).withColumnRenamed("value", "infilled")
    out = s.join(raw.select(*key, F.col("value").alias("raw")), key, "left").join(homog.select(*key, F.col("value").alias("homog")), key, "left")
    return out.withColumn("homog", F.when(~F.col("flag_infilled"), F.col("homog")))


def location_failures(stations: DataFrame, dem: DataFrame, max_dif: float = 200.0) -> DataFrame:
    """Stations whose elevation is off the terrain's, or without one, and whose
    location was not corrected (a qa coordinate is null); dem: station_id and
    elevation_dem, longitude_qa, latitude_qa, elevation_qa."""
    x = stations.join(dem, "station_id", "left").withColumn("elevation_dif", F.col("elevation") - F.col("elevation_dem"))
    qa = F.col("longitude_qa").isNull() | F.col("latitude_qa").isNull() | F.col("elevation_qa").isNull()
    return x.where((F.col("elevation_dif").isNull() | (F.abs("elevation_dif") > max_dif)) & qa)


def update_locations(stations: DataFrame, qa: DataFrame) -> DataFrame:
    """Coordinates from the qa columns where all three are there."""
    x = stations.join(qa, "station_id", "left")
    ok = F.col("longitude_qa").isNotNull() & F.col("latitude_qa").isNotNull() & F.col("elevation_qa").isNotNull()
    new = {c: F.when(ok, F.col(f"{c}_qa")).otherwise(F.col(c)) for c in ("longitude", "latitude", "elevation")}
    return x.withColumns(new).select(stations.columns)


def moved(stations: DataFrame, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Stations whose qa location is not close to the one on file."""
    same = is_close(F.col("longitude"), F.col("longitude_qa"), rtol, atol) & is_close(F.col("latitude"), F.col("latitude_qa"), rtol, atol)
    return stations.where(~same)


def precise_locations(stations: DataFrame, precise: DataFrame) -> DataFrame:
    """longitude, latitude and elevation (feet to m) overridden by a lookup."""
    p = precise.select("station_id", F.col("lon").alias("_x"), F.col("lat").alias("_y"), (F.col("elev_ft") * F.lit(0.3048)).alias("_z"))
    return stations.join(p, "station_id", "left").withColumns({"longitude": F.coalesce("_x", "longitude"), "latitude": F.coalesce("_y", "latitude"), "elevation": F.coalesce("_z", "elevation")}).drop("_x", "_y", "_z")


def utc_offset_by_longitude(stations: DataFrame) -> DataFrame:
    """Standard offset in hours by bands of 15 degrees, for stations that no table of
    zones covers."""
    return stations.withColumn("utc_offset", F.bround(F.col("lon") / 15, 0).cast("short"))


def utc_offset(stations: DataFrame, zones: DataFrame) -> DataFrame:
    """From a table of boxes (lon0, lon1, lat0, lat1, hours; lower ends included), of
    several the one with the least corner, else by longitude. Boxes meet the stations in
    whole degrees of latitude; polygons are zones.utc_offset."""
    x = utc_offset_by_longitude(stations).withColumn("_lat", F.floor("lat"))
    z = zones.where("lat0 < lat1 and lon0 < lon1").withColumn("_lat", F.explode(F.sequence(F.floor("lat0"), F.ceil("lat1") - 1)))
    inside = (F.col("lon") >= F.col("lon0")) & (F.col("lon") < F.col("lon1")) & (F.col("lat") >= F.col("lat0")) & (F.col("lat") < F.col("lat1"))
    found = x.select("lon", "lat", "_lat").distinct().join(z, "_lat").where(inside).groupBy("lon", "lat").agg(F.min(F.struct("lon0", "lat0", "lon1", "lat1", F.col("hours").cast("short").alias("hours"))).alias("_z"))
    return x.join(found, ["lon", "lat"], "left").withColumn("utc_offset", F.coalesce("_z.hours", "utc_offset")).select(*stations.columns, "utc_offset")


def bad_from_log(lines: DataFrame) -> DataFrame:
    """Ids of stations that an infill log names as not optimal or not done."""
    v = F.col("value")
    i = F.when(v.startswith("ERROR|") & v.contains("nonoptimal"), F.substring_index(F.substring_index(v, "|", -1), " ", 1)).when(v.startswith("ERROR: Could not infill "), F.substring_index(F.substring_index(F.substring(v, 25, 1000), "|", 1), " ", 1))
    return lines.select(i.alias("station_id")).where("station_id is not null").distinct()


def holdout_split(daily: DataFrame, years: float = 5.0) -> DataFrame:
    """daily with train: the last round(years * 365.25) valid days of each station."""
    w = Window.partitionBy("station_id").orderBy(F.desc("obs_date"))
    valid = daily.where("value is not null").withColumn("train", F.row_number().over(w) <= round(years * 365.25))
    return valid


def best_by_region(mae: DataFrame) -> DataFrame:
    """climdiv, month, n_nghs: the number of neighbours with the least mean error over
    stations, of equal ones the smallest; rows with a status other than ok are left."""
    ok = mae.where("status = 'ok'") if "status" in mae.columns else mae
    m = ok.groupBy("climdiv", "month", "n_nghs").agg(F.avg("mae").alias("mae"))
    return m.groupBy("climdiv", "month").agg(F.min(F.struct("mae", "n_nghs")).alias("x")).select("climdiv", "month", F.col("x.n_nghs").alias("n_nghs"), F.col("x.mae").alias("mae"))


def region_parameters(station_month: DataFrame, column: str) -> DataFrame:
    """Per climdiv and month the value of the station with the smallest id."""
    return station_month.groupBy("climdiv", "month").agg(F.min_by(column, "station_id").alias(column))


def z_outliers(errors: DataFrame, z: float = 6.0) -> DataFrame:
    """Stations with an error (station_id, month, err) more than z sample deviations
    from the month's mean in any month."""
    m = errors.groupBy("month").agg(F.avg("err").alias("_m"), F.stddev_samp("err").alias("_s"))
    return errors.join(F.broadcast(m), "month").where(F.abs(F.try_divide(F.col("err") - F.col("_m"), F.col("_s"))) > z).select("station_id").distinct()  # 13 months
