"""Calendars and what is aligned to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.functions.scalars import ymd


def days(spark: SparkSession, first: str, last: str) -> DataFrame:
    """obs_date, year, month, day, yday, ymd for each day, both ends included."""
    dates = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day"))).alias("obs_date"))
    return dates.select("obs_date", F.year("obs_date").alias("year"), F.month("obs_date").alias("month"), F.day("obs_date").alias("day"), F.dayofyear("obs_date").alias("yday"), ymd(F.col("obs_date")).alias("ymd"))


def months(spark: SparkSession, first: str, last: str) -> DataFrame:
    dates = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(first).cast("date"), "month"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias("month_date"))
    return dates.select("month_date", F.year("month_date").alias("year"), F.month("month_date").alias("month"), ymd(F.col("month_date")).alias("ymd"))


def densify(obs: DataFrame, stations: DataFrame | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """obs with a row for each station and day: missing days get nulls. Without
    stations, those of obs; without bounds, the first and last day of all of obs.

    Each station generates its own days (no cross join); one shuffle by station."""
    ids = (stations if stations is not None else obs).select("station_id").distinct()
    if first is None or last is None:
        bounds = obs.agg(F.min("obs_date").alias("_lo"), F.max("obs_date").alias("_hi"))
        ids = ids.crossJoin(F.broadcast(bounds)).where("_lo is not null")  # one row
    else:
        ids = ids.withColumns({"_lo": F.lit(first).cast("date"), "_hi": F.lit(last).cast("date")})
    cells = ids.select("station_id", F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day"))).alias("obs_date"))
    return cells.join(obs, ["station_id", "obs_date"], "left")


def month_day_windows(half: int) -> list[tuple[bool, int, int]]:
    """(leap, yday, month*100+day) of the days within `half` days of each day of a
    365-day and of a 366-day year, going round at its ends; the 365-day windows
    never hold February 29."""
    import datetime as dt

    out = []
    for leap, year in ((False, 2003), (True, 2004)):
        n = 366 if leap else 365
        dates = [dt.date(year, 1, 1) + dt.timedelta(i) for i in range(n)]
        for i in range(n):
            out += [(leap, i + 1, dates[(i + k) % n].month * 100 + dates[(i + k) % n].day) for k in range(-half, half + 1)]
    return out


def window_table(spark: SparkSession, half: int = 7) -> DataFrame:
    return spark.createDataFrame(month_day_windows(half), "leap boolean, yday int, md int")
