"""Quality rules for daily precipitation in cm: (station_id, obs_date, prcp, qflag).

As for temperatures, a flagged value becomes null (raw keeps it) and the first flag
stays. Where the original procedure cannot run as written, what it means is done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions.scalars import QA_FLAGS
from isohyet.operators.calendar import window_table

_KEYS = ["station_id", "obs_date"]


def prepare(df: DataFrame) -> DataFrame:
    flag = F.coalesce("qflag", F.lit("")) if "qflag" in df.columns else F.lit("")
    tavg = F.col("tavg") if "tavg" in df.columns else F.lit(None).cast("double")
    return df.select(*_KEYS, F.col("prcp").cast("double"), F.col("prcp").cast("double").alias("raw"), flag.alias("qflag"), tavg.alias("tavg")).repartition("station_id")


def update(df: DataFrame, mask: Column, rule: str) -> DataFrame:
    df = df.withColumn("_k", F.coalesce(mask, F.lit(False)))
    return df.select(*_KEYS, F.when(~F.col("_k"), F.col("prcp")).alias("prcp"), "raw", F.when(F.col("_k") & (F.col("qflag") == ""), F.lit(QA_FLAGS[rule])).otherwise(F.col("qflag")).alias("qflag"), "tavg")


def impossible(df: DataFrame, high: float = 182.88) -> DataFrame:
    return update(df, (F.col("prcp") < 0) | (F.col("prcp") > high), "impossible")


def _dup(df: DataFrame, period: list[str], pair: Column, min_wet: int) -> DataFrame:
    df = df.withColumns({"_year": F.year("obs_date"), "_month": F.month("obs_date")})
    s = df.groupBy("station_id", *period).agg(F.transform(F.array_sort(F.collect_list(F.struct("obs_date", F.col("prcp").alias("v")))), lambda x: x["v"]).alias("_v"), F.count_if(F.col("prcp") > 0).alias("_wet")).where(F.col("_wet") >= min_wet)
    s = s.withColumn("_first", F.get("_v", F.lit(0))).where("_first is not null")
    side = lambda t: s.select("station_id", "_first", F.col("_v").alias(f"_v{t}"), *[F.col(p).alias(f"{p}_{t}") for p in period])
    n = F.least(F.size("_va"), F.size("_vb"))
    same = F.forall(F.arrays_zip(F.slice("_va", F.lit(1), n).alias("a"), F.slice("_vb", F.lit(1), n).alias("b")), lambda x: F.coalesce(x["a"] == x["b"], F.lit(False)))
    hit = side("a").join(side("b"), ["station_id", "_first"]).where(pair & same)
    mark = hit.select("station_id", F.explode(F.array(*[F.struct(*[F.col(f"{p}_{t}").alias(p) for p in period]) for t in "ab"])).alias("_p")).select("station_id", "_p.*").distinct().withColumn("_hit", F.lit(True))
    return update(df.join(mark, ["station_id", *period], "left"), F.col("_hit"), "dup")


def duplicates(df: DataFrame, min_wet: int = 3) -> DataFrame:
    """Equal years, months of a year, and one month of different years, where both
    sides have enough wet days."""
    y, m = (lambda t: F.col(f"_year_{t}")), (lambda t: F.col(f"_month_{t}"))
    df = _dup(df, ["_year"], y("a") < y("b"), min_wet)
    df = _dup(df, ["_year", "_month"], (y("a") == y("b")) & (m("a") < m("b")), min_wet)
    return _dup(df, ["_year", "_month"], (y("a") < y("b")) & (m("a") == m("b")), min_wet)


def gap(df: DataFrame, threshold: float = 30.0) -> DataFrame:
    """From the first upward jump of the sorted positive amounts on."""
    wet = F.when(F.col("prcp") > 0, F.col("prcp"))
    df = df.withColumn("_j", wet - F.lag(wet).over(Window.partitionBy("station_id").orderBy(wet.asc_nulls_first())))
    df = df.withColumn("_g", F.min(F.when(F.col("_j") >= threshold, F.col("prcp"))).over(Window.partitionBy("station_id")))
    return update(df, F.col("prcp") >= F.col("_g"), "gap")


def wet_percentiles(df: DataFrame, keys: list[str], value: str = "value", min_values: int = 20) -> DataFrame:
    """p30 ... p95 of positive values, linearly interpolated."""
    p = df.where(F.col(value) > 0).groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(x) for x in (0.3, 0.5, 0.7, 0.9, 0.95)])).alias("_p"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_values)
    return p.select(*keys, *[F.get("_p", F.lit(i)).alias(c) for i, c in enumerate(("p30", "p50", "p70", "p90", "p95"))])


def seasonal_percentiles(df: DataFrame, half: int = 14) -> DataFrame:
    """By station and day of the (leap or common) year, over the days around it."""
    pooled = df.select("station_id", F.col("prcp").alias("value"), (F.month("obs_date") * 100 + F.day("obs_date")).alias("md")).join(F.broadcast(window_table(df.sparkSession, half)), "md")
    return wet_percentiles(pooled, ["station_id", "leap", "yday"])


def climate_outlier(df: DataFrame, times: float = 9.0, times_cold: float = 5.0, half: int = 14) -> DataFrame:
    p = seasonal_percentiles(df, half).select("station_id", "leap", "yday", "p95")
    df = df.withColumns({"leap": F.dayofyear(F.make_date(F.year("obs_date"), F.lit(12), F.lit(31))) == 366, "yday": F.dayofyear("obs_date")}).join(p, ["station_id", "leap", "yday"], "left")
    return update(df, F.col("prcp") >= F.col("p95") * F.when(F.col("tavg") < 0, times_cold).otherwise(times), "clim_outlier")


def yearly_outliers(df: DataFrame, pairs: DataFrame, min_days: int = 245, percent: float = 1000.0) -> DataFrame:
    """(station_id, year, total, est): years whose total is that many percent off the
    d1-weighted regressions on neighbours (pairs: station_id, ngh_id)."""
    a = df.groupBy("station_id", F.year("obs_date").alias("year")).agg(F.sum("prcp").alias("total"), F.count("prcp").alias("n")).where(F.col("n") >= min_days).drop("n")
    both = a.join(pairs, "station_id").join(a.select(F.col("station_id").alias("ngh_id"), "year", F.col("total").alias("nt")), ["ngh_id", "year"])
    w = Window.partitionBy("station_id", "ngh_id")
    both = both.withColumn("_m", F.avg("total").over(w)).withColumns({"slope": F.regr_slope("total", "nt").over(w), "icpt": F.regr_intercept("total", "nt").over(w), "d1": 1 - F.try_divide(F.sum(F.abs(F.col("nt") - F.col("total"))).over(w), F.sum(F.abs(F.col("nt") - F.col("_m")) + F.abs(F.col("total") - F.col("_m"))).over(w))})
    est = both.groupBy("station_id", "year", "total").agg(F.try_divide(F.sum((F.col("icpt") + F.col("slope") * F.col("nt")) * F.col("d1")), F.sum("d1")).alias("est"))
    return est.where(F.abs(F.try_divide(F.col("total") - F.col("est"), F.col("est"))) * 100 >= percent)


def spatial_corroboration(df: DataFrame, pairs: DataFrame, min_nghs: int = 3, max_nghs: int = 7, default: float = 26.924) -> DataFrame:
    """Flag amounts that differ from all neighbours' amounts on the three days by more
    than a threshold that falls with the difference of their percentile ranks:
    (-45.72 ln(difference) + 269.24) / 10 cm, else the default. pairs: station_id,
    ngh_id, dist_km."""
    wet = Window.partitionBy("station_id").orderBy("prcp")
    whole = Window.partitionBy("station_id")
    rank = F.when(F.col("prcp") > 0, 100.0 * (F.rank().over(wet) + F.count(F.lit(1)).over(wet.rangeBetween(Window.unboundedPreceding, 0)) - 1) / (2 * F.count(F.lit(1)).over(whole)))
    r = df.where("prcp is not null").withColumn("pct", rank).select(*_KEYS, "prcp", "pct")
    ngh = r.select(F.col("station_id").alias("ngh_id"), F.col("obs_date").alias("d"), F.col("prcp").alias("np"), F.col("pct").alias("npct"))
    near = pairs.join(ngh, "ngh_id").withColumn("rank", F.row_number().over(Window.partitionBy("station_id", "d").orderBy("dist_km", "ngh_id"))).where(F.col("rank") <= max_nghs)
    day = near.groupBy("station_id", "d").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("np", "npct")).alias("x")).where(F.col("n") >= min_nghs)
    three = day.withColumn("obs_date", F.explode(F.array(F.date_sub("d", 1), F.col("d"), F.date_add("d", 1)))).groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("days"), F.flatten(F.collect_list("x")).alias("x")).where("days = 3")
    dp = F.array_min(F.transform("x", lambda x: F.abs(x["npct"] - F.col("pct"))))
    limit = F.when(dp > 0, (F.log(dp) * -45.72 + 269.24) / 10).otherwise(default)
    bad = r.join(three, _KEYS).where((F.col("prcp") > 0) & (F.array_min(F.transform("x", lambda x: F.abs(x["np"] - F.col("prcp")))) >= limit)).select(*_KEYS, F.lit(True).alias("_bad"))
    return update(df.join(bad, _KEYS, "left"), F.col("_bad"), "spatial_corrob")


def streak(df: DataFrame, length: int = 20) -> DataFrame:
    """Runs of equal positive amounts, dry and missing days passed over; a run at the
    end is not flagged."""
    day = Window.partitionBy("station_id").orderBy("obs_date")
    wet = F.when(F.col("prcp") > 0, F.col("prcp"))
    prev = F.last(wet, ignorenulls=True).over(day.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_new", F.when(wet.isNotNull(), F.coalesce((wet != prev).cast("int"), F.lit(1))).otherwise(0)).withColumn("_run", F.sum("_new").over(day.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_n", F.count(wet).over(Window.partitionBy("station_id", "_run"))).withColumn("_last", F.max("_run").over(Window.partitionBy("station_id")))
    return update(df, wet.isNotNull() & (F.col("_n") >= length) & (F.col("_run") < F.col("_last")), "streak")


def frequent(df: DataFrame, half: int = 14) -> DataFrame:
    """Windows of 10 wet days in which 9, 8, 7 or 5 amounts are equal and above p30,
    p50, p70 or p90 of their day: these amounts are flagged as a streak."""
    p = seasonal_percentiles(df, half).drop("p95")
    df = df.withColumns({"leap": F.dayofyear(F.make_date(F.year("obs_date"), F.lit(12), F.lit(31))) == 366, "yday": F.dayofyear("obs_date")}).join(p, ["station_id", "leap", "yday"], "left")
    wet = df.where("prcp > 0").withColumn("_i", F.row_number().over(Window.partitionBy("station_id").orderBy("obs_date")))
    # a wet day begins a window of 10; count the equal amounts above each percentile in it
    spread = wet.withColumn("_w", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_i") - 9), F.col("_i"))))
    n = [F.count_if(F.col("prcp") >= F.col(c)).alias(f"n_{c}") for c in ("p30", "p50", "p70", "p90")]
    hit = spread.groupBy("station_id", "_w", "prcp").agg(*n, F.collect_list("obs_date").alias("_d")).where("n_p30 >= 9 or n_p50 >= 8 or n_p70 >= 7 or n_p90 >= 5")
    bad = hit.select("station_id", F.explode("_d").alias("obs_date")).distinct().withColumn("_bad", F.lit(True))
    return update(df.join(bad, _KEYS, "left"), F.col("_bad"), "streak")


def run_non_spatial(df: DataFrame) -> DataFrame:
    return climate_outlier(gap(impossible(duplicates(prepare(df)))))


def run_all(df: DataFrame, pairs: DataFrame) -> DataFrame:
    return spatial_corroboration(run_non_spatial(df), pairs)
