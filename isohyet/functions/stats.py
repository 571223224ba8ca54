"""Aggregate expressions and grouped statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ioa_d1(df: DataFrame, keys: list[str], obs: str = "obs", pred: str = "pred", identical: float | None = None) -> DataFrame:
    """Index of agreement d1 per group over rows where both are there: 1 less the
    absolute errors over the absolute distances from the mean observation; identical
    (null, or 1 for a perfect index) if all are equal to it."""
    both = df.where(F.col(obs).isNotNull() & F.col(pred).isNotNull()).withColumn("_m", F.avg(obs).over(Window.partitionBy(*keys)))
    d1 = 1 - F.try_divide(F.sum(F.abs(F.col(pred) - F.col(obs))), F.sum(F.abs(F.col(pred) - F.col("_m")) + F.abs(F.col(obs) - F.col("_m"))))
    return both.groupBy(*keys).agg(F.coalesce(d1, F.lit(identical).cast("double")).alias("d1"), F.count(F.lit(1)).alias("n"))


def _varies(v: Column, over: WindowSpec | None = None) -> Column:
    """Whether there is more than one value. A variance can't tell: merged sums of a
    constant are off by rounding, so its variance needn't be 0."""
    low, high = (p if over is None else p.over(over) for p in (F.min(v), F.max(v)))
    return low < high


def _both(a: str, b: str) -> tuple[Column, Column]:
    """Each side where the other is there."""
    return F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))


def correlation(a: str, b: str, over: WindowSpec | None = None) -> Column:
    """Pearson's r over rows with both, as an aggregate or over a window; null where a
    side is constant (corr divides by zero there)."""
    x, y = _both(a, b)
    parts = F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)
    c, sx, sy = parts if over is None else (p.over(over) for p in parts)
    return F.when(_varies(x, over) & _varies(y, over), F.try_divide(c, sx * sy))


def errors(obs: str = "obs", pred: str = "pred") -> list[Column]:
    """mae, bias (prediction less observation) and r2 as aggregates; r2 is null where a
    side is constant."""
    o, p = F.col(obs), F.col(pred)
    return [F.avg(F.abs(p - o)).alias("mae"), F.avg(p - o).alias("bias"), F.pow(correlation(pred, obs), 2).alias("r2")]


def mean_and_deviation(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """n, mean and population standard deviation per group over rows with a value."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def biweight(df: DataFrame, keys: list[str], value: str = "value", c: float = 7.5) -> DataFrame:
    """Biweight mean and standard deviation per group (n, bi_mean, bi_std); where the
    median absolute deviation is 0 the plain mean and sample deviation."""
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_x"))
    m = v.groupBy(*keys).agg(F.median("_x").alias("_m"))
    dev = v.join(m, keys)
    mad = dev.groupBy(*keys).agg(F.median(F.abs(F.col("_x") - F.col("_m"))).alias("_mad"))
    dev = dev.join(mad, keys)
    u = F.least(F.lit(1.0), F.abs(F.try_divide(F.col("_x") - F.col("_m"), c * F.col("_mad"))))
    w, e = 1 - F.pow(u, 2), F.col("_x") - F.col("_m")
    out = dev.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("_m").alias("_m"), F.min("_mad").alias("_mad"), F.avg("_x").alias("_avg"), F.stddev_samp("_x").alias("_sd"),
        F.sum(e * F.pow(w, 2)).alias("_a"), F.sum(F.pow(w, 2)).alias("_b"), F.sum(F.pow(e, 2) * F.pow(w, 4)).alias("_c"), F.sum(w * (1 - 5 * F.pow(u, 2))).alias("_d"),
    )
    flat = F.col("_mad") == 0
    return out.select(*keys, "n", F.when(flat, F.col("_avg")).otherwise(F.col("_m") + F.try_divide(F.col("_a"), F.col("_b"))).alias("bi_mean"), F.when(flat, F.col("_sd")).otherwise(F.try_divide(F.sqrt(F.col("n") * F.col("_c")), F.abs(F.col("_d")))).alias("bi_std"))


def weighted_mean(value: str, weight: str) -> Column:
    """Over rows where the value is there."""
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight))))


def linear_model(x: str, y: str) -> list[Column]:
    """slope, intercept and r of y on x as aggregates; null where they are not defined."""
    a, b = _both(x, y)
    constant = ~_varies(b)  # exactly: slope 0, and the value itself
    slope = F.when(_varies(a), F.when(constant, 0.0).otherwise(F.regr_slope(y, x)))
    intercept = F.when(_varies(a), F.when(constant, F.min(b)).otherwise(F.regr_intercept(y, x)))
    return [slope.alias("slope"), intercept.alias("intercept"), correlation(y, x).alias("r")]
