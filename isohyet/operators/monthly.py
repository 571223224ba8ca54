"""Points interpolated with the number of neighbours and the variogram of their place:
both are learned at the stations by region and month, and a point takes the weighted mean
of what its own neighbours have.

station_month: station_id, month, norm, the monthly predictors, optim_nnghs (neighbours
for normals), optim_nnghs_anom (for days), vario_nug, vario_psill, vario_rng. A point's
monthly predictors come from point_month (point_id, month, ...)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions import kernels
from isohyet.functions.stats import errors
from isohyet.operators import interp, neighbourhoods
from isohyet.operators.spatial import nearest
from isohyet.tables import dealt, table

#: Neighbours over which the numbers of neighbours are averaged.
INITIAL = 100
VARIOGRAM = ("vario_nug", "vario_psill", "vario_rng")
FIXED = ("lon", "lat", "elev")


def neighbour_counts(points: DataFrame, stations: DataFrame, station_month: DataFrame, column: str = "optim_nnghs", initial: int = INITIAL, **how) -> DataFrame:
    """point_id, month, k: the weighted mean of the numbers of neighbours at the initial
    nearest stations, rounded half to even; null where none of them has one."""
    near = nearest(points, stations, initial, strict=False, **how)
    months = sorted(r[0] for r in station_month.select("month").distinct().collect())  # twelve at most
    if not months:
        return points.select("point_id", F.lit(None).cast("int").alias("month"), F.lit(None).cast("int").alias("k")).where("false")
    of = lambda m: F.get(column, F.lit(m - 1))
    mean = lambda m: F.try_divide(F.sum(F.col("wgt") * of(m)), F.sum(F.when(of(m).isNotNull(), F.col("wgt"))))
    # all months of a neighbour in one row
    k = dealt(near).join(neighbourhoods.by_month(station_month, "station_id", (column,), ""), "station_id").groupBy("point_id").agg(*[mean(m).alias(f"m{m}") for m in months])
    x = points.select("point_id").join(dealt(k), "point_id", "left")
    each = F.explode(F.array(*[F.struct(F.lit(m).cast("int").alias("month"), F.bround(f"m{m}", 0).cast("int").alias("k")) for m in months]))
    return table(x.select("point_id", each.alias("x")).select("point_id", "x.month", "x.k"), "counts")


def neighbour_lists(points: DataFrame, stations: DataFrame, counts: DataFrame, **how) -> DataFrame:
    """The lists by distance, as long as the greatest number of neighbours asked for."""
    most = counts.agg(F.max("k")).first()[0] or 1
    return nearest(points, stations, int(most), strict=False, **how)


def _status(found: DataFrame, counts: DataFrame, value: str, points: DataFrame) -> DataFrame:
    """The rows of all points and months, those without a result with a status why."""
    x = counts.select("point_id", "month", "k").join(dealt(found.drop("k")), ["point_id", "month"], "left")
    return x.withColumn("status", F.when(F.coalesce("k", F.lit(0)) < 1, "no number of neighbours").when(F.col(value).isNull(), "no result").otherwise("ok"))


def station_variograms(stations: DataFrame, station_month: DataFrame, fixed: tuple[str, ...] = FIXED, monthly: tuple[str, ...] = (), initial: int = INITIAL, **how) -> DataFrame:
    """station_id, month, k, vario_nug, vario_psill, vario_rng, status: of each station's
    place the variogram of as many neighbours (itself among them) as it asks for."""
    pts = stations.withColumn("point_id", F.col("station_id"))
    s = neighbourhoods.usable(stations, station_month, fixed, ("norm", *monthly))
    counts = neighbour_counts(pts, s, station_month, initial=initial, **how)
    rows = neighbourhoods.packed(pts, neighbour_lists(pts, s, counts, **how), s, station_month, counts, fixed, monthly, ("norm",), station_month.withColumn("point_id", F.col("station_id")))

    def kernel(x):
        return kernels.fit_variograms(x["f"], x["norm"], x["lon"], x["lat"], x["dist"].max(1))

    found = neighbourhoods.solve(rows, fixed, monthly, ("norm",), kernel, ", ".join(f"{c} double" for c in VARIOGRAM))
    return _status(found, counts, "vario_nug", pts).withColumnRenamed("point_id", "station_id")


def _own_variogram(x: dict) -> tuple[np.ndarray, ...]:
    """The weighted mean of the neighbours' variograms; NaN where none has one."""
    out = []
    for c in VARIOGRAM:
        w = np.where(np.isnan(x[c]), 0.0, x["wgt"])
        with np.errstate(invalid="ignore"):
            out.append((w * np.nan_to_num(x[c])).sum(1) / w.sum(1))
    return tuple(out)


def normals(points: DataFrame, stations: DataFrame, station_month: DataFrame, fixed: tuple[str, ...] = FIXED, monthly: tuple[str, ...] = (), point_month: DataFrame | None = None, initial: int = INITIAL, **how) -> DataFrame:
    """point_id, month, k, nug, psill, rng, norm, variance, status: kriging with external
    drift, each point and month with its own neighbours and variogram.

    how goes to both searches for neighbours (exclude, drop_zero)."""
    s = neighbourhoods.usable(stations, station_month, fixed, ("norm", *monthly))
    counts = neighbour_counts(points, s, station_month, initial=initial, **how)
    rows = neighbourhoods.packed(points, neighbour_lists(points, s, counts, **how), s, station_month, counts, fixed, monthly, ("norm", *VARIOGRAM), point_month)

    def kernel(x):
        nug, psill, rng = _own_variogram(x)
        bad = ~np.isfinite(nug + psill + rng)
        clean = (np.where(bad, 1.0, nug), np.where(bad, 0.0, psill), np.where(bad, 0.0, rng))
        return (np.where(bad, np.nan, v) for v in interp.kriging(x, *clean))

    found = neighbourhoods.solve(rows, fixed, monthly, ("norm", *VARIOGRAM), kernel, "nug double, psill double, rng double, norm double, variance double")
    return _status(found, counts, "norm", points)


def daily_weights(points: DataFrame, stations: DataFrame, station_month: DataFrame, fixed: tuple[str, ...] = FIXED, monthly: tuple[str, ...] = (), point_month: DataFrame | None = None, initial: int = INITIAL, **how) -> DataFrame:
    """point_id, month, k, station_id, z: regression weights of the neighbours of each
    point and month; any anomaly series of the stations at the point is the sum of
    z * value."""
    s = neighbourhoods.usable(stations, station_month, fixed, ("norm", *monthly))
    counts = neighbour_counts(points, s, station_month, "optim_nnghs_anom", initial, **how)
    rows = neighbourhoods.packed(points, neighbour_lists(points, s, counts, **how), s, station_month, counts, fixed, monthly, ("norm",), point_month)
    return neighbourhoods.solve(rows, fixed, monthly, ("norm",), lambda x: (kernels.gwr_weights(x["f"], x["f0"], x["wgt"])[0],), "z double", each=True)


def daily(points: DataFrame, stations: DataFrame, station_month: DataFrame, values: DataFrame, point_norms: DataFrame, **how) -> DataFrame:
    """point_id, obs_date, value: anomalies from the stations' norms by the weights of
    the month, plus the point's norm (point_id, month, norm). values: station_id,
    obs_date, value. A day on which a neighbour has no value is null."""
    z = daily_weights(points, stations, station_month, **how)
    whole = Window.partitionBy("point_id", "month")
    z = z.withColumn("_n", F.count(F.lit(1)).over(whole))
    a = values.where("value is not null").withColumn("month", F.month("obs_date")).join(station_month.select("station_id", "month", "norm"), ["station_id", "month"])
    a = a.select("station_id", "month", "obs_date", (F.col("value") - F.col("norm")).alias("a"))
    sums = dealt(z).join(a, ["station_id", "month"]).groupBy("point_id", "month", "obs_date").agg(F.sum(F.col("z") * F.col("a")).alias("a"), F.count("a").alias("n"), F.max("_n").alias("_n"))
    out = sums.join(point_norms.select("point_id", "month", F.col("norm").alias("_p")), ["point_id", "month"])
    return out.select("point_id", "obs_date", F.when(F.col("n") == F.col("_n"), F.col("a") + F.col("_p")).alias("value"))


def interpolate(points: DataFrame, stations: DataFrame, station_month: dict[str, DataFrame], values: DataFrame | None = None, normal_years: tuple[int, int] = (1981, 2010), point_month: dict[str, DataFrame] | None = None, **how) -> tuple[DataFrame | None, DataFrame]:
    """Daily minima and maxima of points and their normals, by elements tmin and tmax of
    station_month; without values (station_id, obs_date, tmin, tmax) the normals only.

    Crossed days are mended; the normals of points that had any are means over years of
    the monthly means of their mended days."""
    day, normal = None, None
    for e in ("tmin", "tmax"):
        of_point = {"point_month": point_month[e]} if point_month else {}
        pn = normals(points, stations, station_month[e], **of_point, **how)
        if values is not None:
            d = daily(points, stations, station_month[e], values.select("station_id", "obs_date", F.col(e).alias("value")), pn, **of_point, **how).withColumnRenamed("value", e)
            day = d if day is None else day.join(d, ["point_id", "obs_date"])
        pn = pn.select("point_id", "month", F.col("norm").alias(f"{e}_norm"), F.sqrt(F.greatest("variance", F.lit(0.0))).alias(f"{e}_se"))
        normal = pn if normal is None else normal.join(pn, ["point_id", "month"])
    return (None, normal) if values is None else interp.mend_range(day, normal, normal_years)


def without_own(stations: DataFrame) -> dict:
    """Arguments that keep every station out of its own neighbours."""
    return {"others": True}


def leave_one_out(stations: DataFrame, station_month: DataFrame, values: DataFrame | None = None, monthly: tuple[str, ...] = (), **how) -> tuple[DataFrame, DataFrame | None]:
    """(station_id, month, norm, pred) and (station_id, obs_date, obs, pred): every station
    predicted as if it were not there, by the whole chain: numbers of neighbours, lists,
    variograms, normals and days all leave it out. Its days stand on its predicted norm."""
    pts = stations.withColumn("point_id", F.col("station_id"))
    of_point = {"monthly": monthly, "point_month": station_month.withColumn("point_id", F.col("station_id"))}
    how = of_point | without_own(stations) | how
    pn = normals(pts, stations, station_month, **how)
    norm = station_month.select("station_id", "month", "norm").join(dealt(pn).select(F.col("point_id").alias("station_id"), "month", F.col("norm").alias("pred")), ["station_id", "month"])
    if values is None:
        return norm, None
    d = daily(pts, stations, station_month, values, pn, **how).select(F.col("point_id").alias("station_id"), "obs_date", F.col("value").alias("pred"))
    return norm, values.select("station_id", "obs_date", F.col("value").alias("obs")).join(d, ["station_id", "obs_date"])


def validation(days: DataFrame) -> DataFrame:
    """station_id, month, mae, bias, r2 of predicted days, by calendar month."""
    return days.where("obs is not null and pred is not null").withColumn("month", F.month("obs_date")).groupBy("station_id", "month").agg(*errors())
