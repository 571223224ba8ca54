"""Means, normals, counts and periods of record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def monthly_means(daily: DataFrame, max_miss: int | None = 9, value: str = "value", quirk: bool = False) -> DataFrame:
    """station_id, year, month, mean, n_miss from (station_id, obs_date, value) rows
    of observed days; a mean is null when more than max_miss days of the month are
    missing. Days without a row are missing, so daily need not be dense. quirk: as
    long as no month of a station is wholly missing, nothing counts as missing."""
    days = F.day(F.last_day(F.make_date("year", "month", F.lit(1))))
    base = daily.groupBy("station_id", F.year("obs_date").alias("year"), F.month("obs_date").alias("month")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    out = base.select("station_id", "year", "month", "mean", (days - F.col("n")).cast("int").alias("n_miss"))
    if quirk:
        from pyspark.sql import Window

        seen = F.max(F.col("mean").isNull().cast("int")).over(Window.partitionBy("station_id"))
        out = out.withColumn("n_miss", F.when(seen == 1, F.col("n_miss")).otherwise(0))
    return out if max_miss is None or max_miss < 0 else out.withColumn("mean", F.when(F.col("n_miss") <= max_miss, F.col("mean")))


def monthly_normals(daily: DataFrame, first: int = 1981, last: int = 2010, max_miss: int | None = 9, value: str = "value") -> DataFrame:
    """station_id, month, norm, n_years: the mean over years of monthly means."""
    m = monthly_means(daily.where(F.year("obs_date").between(first, last)), max_miss, value)
    return normals_of_months(m)


def normals_of_months(monthly: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    m = monthly if first is None else monthly.where(F.col("year").between(first, last))
    return m.groupBy("station_id", "month").agg(F.avg("mean").alias("norm"), F.count("mean").alias("n_years"))


def annual_means(monthly: DataFrame, max_miss: int | None = None) -> DataFrame:
    """The mean of monthly means; with max_miss, null if more months are missing."""
    out = monthly.groupBy("station_id", "year").agg(F.avg("mean").alias("mean"), F.count("mean").alias("n_months"))
    return out if max_miss is None or max_miss < 0 else out.withColumn("mean", F.when(12 - F.col("n_months") <= max_miss, F.col("mean")))


def eight_day_means(daily: DataFrame, value: str = "value") -> DataFrame:
    """Means over the 46 bins of a year that begin on days 1, 9, ... 361; the last
    one goes to the end of the year."""
    return daily.groupBy("station_id", F.year("obs_date").alias("year"), F.floor((F.dayofyear("obs_date") - 1) / 8).cast("int").alias("bin")).agg(F.avg(value).alias("mean"))


def observation_counts(daily: DataFrame, first: str | None = None, last: str | None = None, value: str = "value", exclude_flagged: bool = False) -> DataFrame:
    """station_id, month, cnt of observed days of each calendar month, all 12 of
    them. Flags do not matter unless exclude_flagged (column qflag)."""
    rows = daily if first is None else daily.where(F.col("obs_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    v = F.when(F.coalesce("qflag", F.lit("")) == "", F.col(value)) if exclude_flagged else F.col(value)
    per = [F.count(F.when(F.month("obs_date") == m, v)).alias(str(m)) for m in range(1, 13)]
    wide = rows.groupBy("station_id").agg(*per)
    return wide.select("station_id", F.posexplode(F.array(*[F.col(str(m)) for m in range(1, 13)])).alias("month", "cnt")).select("station_id", (F.col("month") + 1).alias("month"), "cnt")


#: Days of the months of a common year (fixed values).
DAYS_IN_MONTH = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def period_of_record(counts: DataFrame, min_years: float) -> DataFrame:
    """Stations all of whose 12 counts reach min_years of that month (of any element
    if counts has a column elem)."""
    need = F.element_at(F.array(*[F.lit(x) for x in DAYS_IN_MONTH]), F.col("month"))
    keys = [c for c in ("station_id", "elem") if c in counts.columns]
    return counts.groupBy(*keys).agg((F.count_if(F.col("cnt") >= need * min_years) == 12).alias("ok")).groupBy("station_id").agg(F.bool_or("ok").alias("ok"))


def flag_summary(obs: DataFrame, value: str = "value", flag: str = "qflag") -> DataFrame:
    """Percent of the observed values of a station that are flagged; null if none."""
    flagged = F.count_if(F.coalesce(flag, F.lit("")) != "")
    return obs.where(F.col(value).isNotNull()).groupBy("station_id").agg(F.try_multiply(F.try_divide(flagged, F.count(value)), F.lit(100.0)).alias("pct_flagged"))


def annual_sums(daily: DataFrame, min_days: int = 245, value: str = "value") -> DataFrame:
    """Yearly sums of years with enough observed days."""
    return daily.groupBy("station_id", F.year("obs_date").alias("year")).agg(F.sum(value).alias("total"), F.count(value).alias("n")).where(F.col("n") >= min_days).drop("n")


def period_bounds(daily: DataFrame, value: str = "value") -> DataFrame:
    return daily.where(F.col(value).isNotNull()).groupBy("station_id").agg(F.min("obs_date").alias("first"), F.max("obs_date").alias("last"))


def time_reduction(cells: DataFrame, how: str) -> DataFrame:
    """AVG or SUM over time of (row, col, value)."""
    return cells.groupBy("row", "col").agg((F.avg if how == "AVG" else F.sum)("value").alias("value"))
