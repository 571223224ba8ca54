"""Time of observation and homogenisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions.scalars import ymd


def shift_morning_tmax(df: DataFrame, literal: bool = True) -> DataFrame:
    """station_id, obs_date, tmin, tmax, tobs_tmax (HHMM, null if unknown) on dense
    days: a maximum read in the morning (0 < HHMM < 1100) moves to the day before,
    unless that day holds a valid maximum that was not read in the morning; what
    cannot move is dropped. literal: only where a station has more than one to move.
    tmin passes through."""
    w = Window.partitionBy("station_id").orderBy("obs_date")
    am = F.coalesce((F.col("tobs_tmax") > 0) & (F.col("tobs_tmax") < 1100) & F.col("tmax").isNotNull(), F.lit(False))
    x = df.withColumn("_am", am).withColumn("_free", F.col("tmax").isNull() | F.col("_am"))
    x = x.withColumns({"_next": F.lead("tmax").over(w), "_next_am": F.coalesce(F.lead("_am").over(w), F.lit(False))})
    x = x.withColumn("_n", F.count_if(F.col("_next_am") & F.col("_free")).over(Window.partitionBy("station_id")))
    moved = F.when(F.col("_next_am") & F.col("_free"), F.col("_next")).when(~F.col("_am"), F.col("tmax"))
    new = F.when(F.col("_n") > (1 if literal else 0), moved).otherwise(F.col("tmax"))
    return x.select("station_id", "obs_date", "tmin", new.alias("tmax"))


def tobs_stations(tmin_ids: DataFrame, tmax_ids: DataFrame) -> DataFrame:
    """Stations with minima, and those with maxima only, in order."""
    return tmin_ids.select("station_id").distinct().unionByName(tmax_ids.select("station_id").distinct().join(tmin_ids, "station_id", "left_anti")).orderBy("station_id")


def segment_adjustment(months: DataFrame, segments: DataFrame) -> DataFrame:
    """months (station_id, year, month) with adj: that of the segment (ymd_start,
    ymd_end, adj) the month begins in; before the first one the first's, after the
    last 0. More than one segment for a month is an error.

    Segments of a station are few: they meet its months in an equi-join by station."""
    w = Window.partitionBy("station_id")
    s = segments.withColumn("_lo", F.min("ymd_start").over(w)).withColumn("_hi", F.max("ymd_end").over(w))
    m = months.select("station_id", "year", "month").distinct().withColumn("_ymd", F.col("year") * 10000 + F.col("month") * 100 + 1)
    j = m.join(s, "station_id", "left").groupBy("station_id", "year", "month", "_ymd").agg(F.collect_list(F.when(F.col("_ymd").between(F.col("ymd_start"), F.col("ymd_end")), F.col("adj"))).alias("_in"), F.min("_lo").alias("_lo"), F.min_by("adj", "ymd_start").alias("_first"))
    adj = F.when(F.size("_in") > 1, F.raise_error(F.lit("a month lies in two segments")).cast("double")).when(F.size("_in") == 1, F.get("_in", F.lit(0))).when(F.col("_ymd") < F.col("_lo"), F.col("_first")).otherwise(0.0)
    return j.select("station_id", "year", "month", adj.alias("adj"))


def homogenise(daily: DataFrame, raw: DataFrame, homog: DataFrame, segments: DataFrame) -> DataFrame:
    """daily (station_id, obs_date, value) adjusted: where the raw and the homogenised
    monthly mean (station_id, year, month, mean) are both there and differ, by their
    difference; where only the homogenised one is and the month has days, by the
    negative of its segment's adjustment; rounded to hundredths, else as it is."""
    key = ["station_id", "year", "month"]
    d = daily.withColumns({"year": F.year("obs_date"), "month": F.month("obs_date")})
    both = raw.select(*key, F.col("mean").alias("_raw")).join(homog.select(*key, F.col("mean").alias("_hom")), key, "full")
    alone = segment_adjustment(both.where("_raw is null and _hom is not null"), segments)
    m = both.join(alone, key, "left").select(*key, F.when(F.col("_raw").isNotNull() & F.col("_hom").isNotNull(), F.nullif(F.col("_hom") - F.col("_raw"), F.lit(0.0))).when(F.col("_hom").isNotNull(), -F.col("adj")).alias("_delta"))
    out = d.join(m, key, "left")
    return out.select("station_id", "obs_date", F.when(F.col("_delta").isNotNull(), F.round(F.col("value") + F.col("_delta"), 2)).otherwise(F.col("value")).alias("value"))


def adjustment_report(segments: DataFrame, stations: DataFrame, elem: str) -> DataFrame:
    """Adjustments that are not 0, negated, from the month after the segment, with
    the stations' data."""
    s = segments.join(stations, "station_id").where("adj <> 0")
    month = F.add_months(F.to_date((F.col("ymd_end")).cast("string"), "yyyyMMdd"), 1)
    return s.select("station_id", F.lit(elem).alias("elem"), F.date_format(month, "yyyyMM").alias("yearmonth"), (-F.col("adj")).alias("adj"), *[c for c in stations.columns if c != "station_id"])


def adjustment_table(tmin: DataFrame, tmax: DataFrame, stations: DataFrame) -> DataFrame:
    """The reports of both elements, one after the other."""
    return adjustment_report(tmin, stations, "tmin").unionByName(adjustment_report(tmax, stations, "tmax"))


def usable(stations: DataFrame, not_listed: DataFrame) -> DataFrame:
    """Stations that the homogenisation could process."""
    return stations.join(not_listed.select("station_id"), "station_id", "left_anti")


def ymd_column(df: DataFrame) -> DataFrame:
    return df.withColumn("ymd", ymd(F.col("obs_date")))
