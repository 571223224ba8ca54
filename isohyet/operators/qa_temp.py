"""Quality rules for daily temperatures.

Each rule takes dense rows (station_id, obs_date, tmin, tmax, flag_tmin, flag_tmax)
and returns them with what it flags set to null and its letter where no flag was.
The first rule to flag wins and later ones do not see flagged values, so their order
matters. All windows are by station, so a chain shuffles once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions.scalars import QA_FLAGS
from isohyet.functions.stats import biweight
from isohyet.operators.calendar import window_table

ELEMS = ("tmin", "tmax")
COLUMNS = ["station_id", "obs_date", "tmin", "tmax", "flag_tmin", "flag_tmax"]


def _day():
    return Window.partitionBy("station_id").orderBy("obs_date")


def _pool():
    """A calendar month of all years."""
    return Window.partitionBy("station_id", "_month")


def prepare(dense: DataFrame) -> DataFrame:
    """Rows for the rules, dealt by station once; flags begin empty unless there."""
    flag = lambda c: (F.coalesce(c, F.lit("")) if c in dense.columns else F.lit("")).alias(c)
    return dense.select("station_id", "obs_date", F.col("tmin").cast("double"), F.col("tmax").cast("double"), flag("flag_tmin"), flag("flag_tmax")).repartition("station_id")


def update(df: DataFrame, tmin: Column, tmax: Column, rule: str) -> DataFrame:
    """Null the values under the masks and flag those not yet flagged."""
    df = df.withColumns({"_k0": F.coalesce(tmin, F.lit(False)), "_k1": F.coalesce(tmax, F.lit(False))})
    out = [F.when(~F.col(k), F.col(e)).alias(e) for e, k in zip(ELEMS, ("_k0", "_k1"), strict=True)]
    flags = [F.when(F.col(k) & (F.col(f"flag_{e}") == ""), F.lit(QA_FLAGS[rule])).otherwise(F.col(f"flag_{e}")).alias(f"flag_{e}") for e, k in zip(ELEMS, ("_k0", "_k1"), strict=True)]
    return df.select("station_id", "obs_date", *out, *flags)


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumns({"_year": F.year("obs_date"), "_month": F.month("obs_date")})


def naught(df: DataFrame) -> DataFrame:
    both = lambda v: (F.round("tmin", 1) == v) & (F.round("tmax", 1) == v)
    mask = both(-17.8) | ((F.col("tmin") == 0) & (F.col("tmax") == 0))
    return update(df, mask, mask, "naught")


def _same_series(a: str, b: str) -> Column:
    """Equal from the first day up to the end of the shorter one, nothing missing."""
    n = F.least(F.size(a), F.size(b))
    return (n > 0) & F.forall(F.arrays_zip(F.slice(a, F.lit(1), n).alias("a"), F.slice(b, F.lit(1), n).alias("b")), lambda x: F.coalesce(x["a"] == x["b"], F.lit(False)))


def _dup(df: DataFrame, period: list[str], pair: Column, min_wet: int | None = None) -> DataFrame:
    """Flag both periods of a pair whose series are the same. Only periods of a
    station that begin with the same value are compared."""
    df = _dated(df)
    masks = {}
    for e in ELEMS:
        runs = df.groupBy("station_id", *period).agg(F.array_sort(F.collect_list(F.struct("obs_date", F.col(e).alias("v")))).alias("_s")).select("station_id", *period, F.transform("_s", lambda x: x["v"]).alias("_v")).withColumn("_first", F.get("_v", F.lit(0))).where("_first is not null")
        a = runs.select("station_id", "_first", F.col("_v").alias("_va"), *[F.col(p).alias(f"{p}_a") for p in period])
        b = runs.select("station_id", "_first", F.col("_v").alias("_vb"), *[F.col(p).alias(f"{p}_b") for p in period])
        hit = a.join(b, ["station_id", "_first"]).where(pair & _same_series("_va", "_vb"))
        masks[e] = hit.select("station_id", F.explode(F.array(F.struct(*[F.col(f"{p}_a").alias(p) for p in period]), F.struct(*[F.col(f"{p}_b").alias(p) for p in period]))).alias("_p")).select("station_id", *[F.col(f"_p.{p}") for p in period]).distinct().withColumn(f"_dup_{e}", F.lit(True))
    for e in ELEMS:
        df = df.join(masks[e], ["station_id", *period], "left")
    return update(df, F.col("_dup_tmin"), F.col("_dup_tmax"), "dup")


def dup_year(df: DataFrame) -> DataFrame:
    return _dup(df, ["_year"], F.col("_year_a") < F.col("_year_b"))


def dup_year_month(df: DataFrame, literal: bool = True) -> DataFrame:
    """Months of one year; literal: November is not compared with December."""
    pair = (F.col("_year_a") == F.col("_year_b")) & (F.col("_month_a") < F.col("_month_b"))
    return _dup(df, ["_year", "_month"], pair & (F.col("_month_a") != 11) if literal else pair)


def dup_month(df: DataFrame) -> DataFrame:
    """One calendar month of different years."""
    return _dup(df, ["_year", "_month"], (F.col("_year_a") < F.col("_year_b")) & (F.col("_month_a") == F.col("_month_b")))


def dup_within_month(df: DataFrame, min_days: int = 10) -> DataFrame:
    mask = F.count_if(F.col("tmin") == F.col("tmax")).over(Window.partitionBy("station_id", "_year", "_month")) >= min_days
    return update(_dated(df).withColumn("_m", mask), F.col("_m"), F.col("_m"), "dup")


def impossible(df: DataFrame, low: float = -89.4, high: float = 57.7) -> DataFrame:
    m = lambda e: (F.col(e) < low) | (F.col(e) > high)
    return update(df, m("tmin"), m("tmax"), "impossible")


def streak(df: DataFrame, length: int = 20, literal: bool = True) -> DataFrame:
    """Runs of equal values, missing days passed over; literal: the run that reaches
    the end of the series is never flagged."""
    for e in ELEMS:
        prev = F.last(F.col(e), ignorenulls=True).over(_day().rowsBetween(Window.unboundedPreceding, -1))
        df = df.withColumn(f"_new_{e}", F.when(F.col(e).isNotNull(), F.coalesce((F.col(e) != prev).cast("int"), F.lit(1))).otherwise(0))
    for e in ELEMS:
        df = df.withColumn(f"_run_{e}", F.sum(f"_new_{e}").over(_day().rowsBetween(Window.unboundedPreceding, 0)))
    for e in ELEMS:
        run = Window.partitionBy("station_id", f"_run_{e}")
        df = df.withColumn(f"_n_{e}", F.count(e).over(run)).withColumn(f"_last_{e}", F.max(f"_run_{e}").over(Window.partitionBy("station_id")))
    m = lambda e: F.col(e).isNotNull() & (F.col(f"_n_{e}") >= length) & (F.lit(not literal) | (F.col(f"_run_{e}") < F.col(f"_last_{e}")))
    return update(df, m("tmin"), m("tmax"), "streak")


def gap(df: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Per station and calendar month: from the median outward, everything from the
    first jump of sorted values on."""
    df = _dated(df)
    for e in ELEMS:
        median = F.median(e).over(_pool())
        df = df.withColumn(f"_med_{e}", median)
    for e in ELEMS:
        up, down = F.col(e) >= F.col(f"_med_{e}"), F.col(e) <= F.col(f"_med_{e}")
        above = Window.partitionBy("station_id", "_month").orderBy(F.when(up, F.col(e)).asc_nulls_last())
        below = Window.partitionBy("station_id", "_month").orderBy(F.when(down, F.col(e)).desc_nulls_last())
        df = df.withColumn(f"_ju_{e}", F.when(up, F.col(e) - F.lag(F.when(up, F.col(e))).over(above))).withColumn(f"_jd_{e}", F.when(down, F.lag(F.when(down, F.col(e))).over(below) - F.col(e)))
    masks = []
    for e in ELEMS:
        top = F.min(F.when(F.col(f"_ju_{e}") >= threshold, F.col(e))).over(_pool())
        bottom = F.max(F.when(F.col(f"_jd_{e}") >= threshold, F.col(e))).over(_pool())
        df = df.withColumn(f"_top_{e}", top).withColumn(f"_bot_{e}", bottom)
        masks.append(F.coalesce(F.col(e) >= F.col(f"_top_{e}"), F.lit(False)) | F.coalesce(F.col(e) <= F.col(f"_bot_{e}"), F.lit(False)))
    return update(df, *masks, "gap")


def internal_inconsistency(df: DataFrame) -> DataFrame:
    mask = F.col("tmax") < F.col("tmin")
    return update(df, mask, mask, "internal")


def spike_dip(df: DataFrame, threshold: float = 25.0) -> DataFrame:
    m = lambda e: (F.abs(F.col(e) - F.lag(e).over(_day())) >= threshold) & (F.abs(F.col(e) - F.lead(e).over(_day())) >= threshold)
    return update(df.withColumns({"_s0": m("tmin"), "_s1": m("tmax")}), F.col("_s0"), F.col("_s1"), "spike")


def lagged_range(df: DataFrame, threshold: float = 40.0) -> DataFrame:
    """A value too far from all of the other element on the three days around it; the
    other element's three days are flagged with it."""
    near = _day().rowsBetween(-1, 1)
    df = df.withColumns({"_hi": F.coalesce(F.col("tmax") >= F.max("tmin").over(near) + threshold, F.lit(False)), "_lo": F.coalesce(F.col("tmin") <= F.min("tmax").over(near) - threshold, F.lit(False))})
    df = df.withColumns({"_m0": F.col("_lo") | F.max("_hi").over(near), "_m1": F.col("_hi") | F.max("_lo").over(near)})
    return update(df, F.col("tmin").isNotNull() & F.col("_m0"), F.col("tmax").isNotNull() & F.col("_m1"), "lagrange")


def mega_inconsistency(df: DataFrame) -> DataFrame:
    df = _dated(df).withColumns({"_a": F.max("tmax").over(_pool()), "_b": F.min("tmin").over(_pool())})
    return update(df, F.col("tmin") > F.col("_a"), F.col("tmax") < F.col("_b"), "mega")


def seasonal_norms(df: DataFrame, half: int = 7, min_values: int = 100) -> DataFrame:
    """station_id, elem, leap, yday, n, bi_mean, bi_std: biweight statistics of the
    values within `half` days of a day of the year, over all years; null with fewer
    than min_values."""
    long = df.select("station_id", F.explode(F.array(*[F.struct(F.lit(e).alias("elem"), F.col(e).alias("value")) for e in ELEMS])).alias("x"), (F.month("obs_date") * 100 + F.day("obs_date")).alias("md")).select("station_id", "x.elem", "x.value", "md").where("value is not null")
    pooled = long.join(F.broadcast(window_table(df.sparkSession, half)), "md")  # 731 * 15 rows
    out = biweight(pooled, ["station_id", "elem", "leap", "yday"])
    return out.where(F.col("n") >= min_values)


def _with_norms(df: DataFrame, norms: DataFrame, names: tuple[str, str]) -> DataFrame:
    df = df.withColumns({"leap": F.dayofyear(F.make_date(F.year("obs_date"), F.lit(12), F.lit(31))) == 366, "yday": F.dayofyear("obs_date")})
    for e in ELEMS:
        n = norms.where(F.col("elem") == e).select("station_id", "leap", "yday", F.col("bi_mean").alias(f"{names[0]}_{e}"), F.col("bi_std").alias(f"{names[1]}_{e}"))
        df = df.join(n, ["station_id", "leap", "yday"], "left")
    return df


def climate_outlier(df: DataFrame, z: float = 6.0, half: int = 7, min_values: int = 100) -> DataFrame:
    df = _with_norms(df, seasonal_norms(df, half, min_values), ("_n", "_s"))
    m = lambda e: F.abs(F.try_divide(F.col(e) - F.col(f"_n_{e}"), F.col(f"_s_{e}"))) >= z
    return update(df, m("tmin"), m("tmax"), "clim_outlier")


def duplicates(df: DataFrame, literal: bool = True) -> DataFrame:
    return dup_within_month(dup_month(dup_year_month(dup_year(df), literal)))


NON_SPATIAL: tuple[Callable[[DataFrame], DataFrame], ...] = (naught, duplicates, impossible, streak, gap, climate_outlier, internal_inconsistency, spike_dip, lagged_range, mega_inconsistency)


def run_non_spatial(dense: DataFrame, rules: tuple[Callable[[DataFrame], DataFrame], ...] = NON_SPATIAL, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rules in order. cut, if given, is applied after each (checkpoint, or a
    table written and read) so that plans stay short."""
    df = prepare(dense)
    for rule in rules:
        df = rule(df)
        df = cut(df) if cut else df
    return df


def run_spatial(df: DataFrame, stations: DataFrame, cut: Callable[[DataFrame], DataFrame] | None = None, **how) -> DataFrame:
    from isohyet.operators.spatial import spatial_corroboration, spatial_regression

    for rule in (lambda x: spatial_regression(x, stations, **how), lambda x: spatial_corroboration(x, stations), mega_inconsistency):
        df = rule(df)
        df = cut(df) if cut else df
    return df


def run_all(dense: DataFrame, stations: DataFrame, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    return run_spatial(run_non_spatial(dense, cut=cut), stations, cut)


def merge_flags(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Flags of a rerun over those kept: a row counts as new if either element was
    newly flagged; the new flag wins, else the previous one stays."""
    p = previous.select("station_id", "obs_date", F.col("flag_tmin").alias("_p0"), F.col("flag_tmax").alias("_p1"))
    n = new.where("flag_tmin <> '' or flag_tmax <> ''").select("station_id", "obs_date", F.nullif("flag_tmin", F.lit("")).alias("_n0"), F.nullif("flag_tmax", F.lit("")).alias("_n1"))
    return p.join(n, ["station_id", "obs_date"], "full").select("station_id", "obs_date", F.coalesce("_n0", "_p0", F.lit("")).alias("flag_tmin"), F.coalesce("_n1", "_p1", F.lit("")).alias("flag_tmax"))
