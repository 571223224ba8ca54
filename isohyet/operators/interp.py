"""Interpolation of normals and daily values to points.

Kernels work on many points (or stations and months) at once and give weights of the
neighbours; the values, which are the large side, are joined and summed by Spark."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions import kernels, variograms
from isohyet.functions.scalars import bisquare
from isohyet.functions.stats import errors, weighted_mean
from isohyet.operators import neighbourhoods
from isohyet.operators.neighbourhoods import lots
from isohyet.operators.spatial import SENT, nearest, station_pairs
from isohyet.shipping import map_arrow, ship
from isohyet.tables import dealt, table

PREDICTORS_NORM = ("lon", "lat", "elev", "lst")
PLACE = ("lon", "lat", "elev")
PREDICTORS_ANOM = ("lon", "lat", "elev", "tdi", "lst")


def point_parameter(near: DataFrame, station_month: DataFrame, column: str, whole: bool = True) -> DataFrame:
    """point_id, month and the weighted mean of a station parameter over neighbours
    (point_id, station_id, wgt) that have one, rounded half to even if whole."""
    v = dealt(near).join(station_month.select("station_id", "month", F.col(column).cast("double").alias("_v")), "station_id").groupBy("point_id", "month").agg(weighted_mean("_v", "wgt").alias(column))
    return v.withColumn(column, F.bround(column, 0).cast("int")) if whole else v


def _neighbourhoods(points: DataFrame, near: DataFrame, stations: DataFrame, predictors: tuple[str, ...]) -> DataFrame:
    """One row a point and neighbour, with both sides' predictors. Solving takes far longer
    than rows are large, so points are dealt by number: small partitions are not put together."""
    spread = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = stations.select("station_id", *[F.col(p).cast("double").alias(f"s_{p}") for p in dict.fromkeys((*predictors, "lon", "lat"))])
    p = points.select("point_id", *[F.col(c).cast("double").alias(f"p_{c}") for c in dict.fromkeys((*predictors, "lon", "lat"))])
    return dealt(near).join(s, "station_id").repartition(spread, "point_id").join(dealt(p), "point_id")


def _solve(rows: DataFrame, ngh: list[str], point: list[str], kernel: Callable, out: str) -> DataFrame:
    """point_id, station_id and the columns out, from kernel on many points at once.

    A point's neighbours (at most k) are put in one row; of each Arrow batch the points
    with equally many go to kernel as arrays: its arguments are of shape (points,
    neighbours) for ngh, (points,) for point; its results are of the first shape."""
    each, once = list(dict.fromkeys(ngh)), list(dict.fromkeys(point))
    packed = rows.groupBy("point_id").agg(F.collect_list(F.struct("station_id", *each)).alias("n"), *[F.first(c).alias(c) for c in once])
    names = [c.split()[0] for c in out.split(", ")]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("point_id", "station_id"))

    def run(batches):
        for b in batches:
            lists = b.column(1)
            flat, start = lists.flatten(), lists.offsets.to_numpy()
            start = start - start[0]
            size = np.diff(start)
            values = {c: flat.field(1 + i).to_numpy(zero_copy_only=False) for i, c in enumerate(each)}
            own = {c: b.column(2 + i).to_numpy(zero_copy_only=False) for i, c in enumerate(once)}
            for i in lots(size):
                m = size[i[0]]
                at = start[i][:, None] + np.arange(m)
                found = kernel(*(values[c][at] for c in ngh), *(own[c][i] for c in point))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(i, m))), flat.field(0).take(pa.array(at.ravel())), *(pa.array(x.ravel()) for x in found)], ["point_id", "station_id", *names])

    return map_arrow(packed, run, f"{kinds}, {out}")


def _regression(predictors: tuple[str, ...]) -> tuple[list[str], list[str], Callable]:
    """Columns of neighbours and points and the kernel of weighted regression."""
    p = len(predictors)

    def kernel(w, *x):
        z, deficient = kernels.gwr_weights(np.stack(x[:p], 2), np.stack(x[p:], 1), w)
        return z, np.repeat(np.where(deficient, "rank_deficient", "ok")[:, None], w.shape[1], 1)

    return ["wgt", *(f"s_{c}" for c in predictors)], [f"p_{c}" for c in predictors], kernel


def gwr_weights(points: DataFrame, near: DataFrame, stations: DataFrame, predictors: tuple[str, ...] = ("lon", "lat", "elev")) -> DataFrame:
    """point_id, station_id, z, status: the weights of geographically weighted
    regression; any series of the stations at the point is the sum of z * value."""
    return _solve(_neighbourhoods(points, near, stations, predictors), *_regression(predictors), "z double, status string")


def drift_weights(points: DataFrame, near: DataFrame, stations: DataFrame, variogram: DataFrame, predictors: tuple[str, ...] = ("lon", "lat", "elev")) -> DataFrame:
    """point_id, station_id, lam, variance: kriging with external drift (ordinary
    kriging without predictors). variogram: point_id, nug, psill, rng (range 0: pure
    nugget). The mean is the sum of lam * norm."""
    p = len(predictors)

    def kernel(lon, lat, *x):
        f, (lon0, lat0, nug, psill, rng), f0 = x[:p], x[p : p + 5], x[p + 5 :]
        f = np.stack(f, 2) if p else np.zeros((*lon.shape, 0))
        f0 = np.stack(f0, 1) if p else np.zeros((len(lon), 0))
        h = kernels.km(lon[:, :, None], lat[:, :, None], lon[:, None, :], lat[:, None, :])
        lam, var = kernels.drift_weights(f, f0, h, kernels.km(lon, lat, lon0[:, None], lat0[:, None]), nug, psill, rng)
        return lam, np.repeat(var[:, None], lam.shape[1], 1)

    v = variogram.select("point_id", *[F.col(c).cast("double").alias(c) for c in ("nug", "psill", "rng")])
    rows = _neighbourhoods(points, near, stations, predictors).join(dealt(v), "point_id")
    return _solve(rows, ["s_lon", "s_lat", *(f"s_{c}" for c in predictors)], ["p_lon", "p_lat", "nug", "psill", "rng", *(f"p_{c}" for c in predictors)], kernel, "lam double, variance double")


def variogram_bins(residuals: DataFrame, pairs: DataFrame, width: float = 5.0) -> DataFrame:
    """bin, n, h, gamma of (station_id, r) over pairs (station_id, ngh_id, dist_km)."""
    r = residuals.select("station_id", F.col("r").alias("_a"))
    x = pairs.where("station_id < ngh_id and dist_km > 0").join(r, "station_id").join(r.select(F.col("station_id").alias("ngh_id"), F.col("_a").alias("_b")), "ngh_id")
    return x.groupBy(F.floor(F.col("dist_km") / width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("dist_km").alias("h"), (F.sum(F.pow(F.col("_a") - F.col("_b"), 2)) / (2 * F.count(F.lit(1)))).alias("gamma"))


def variogram_bins_of_places(residuals: DataFrame, radius: float, width: float = 5.0) -> DataFrame:
    """variogram_bins of all pairs within the radius; residuals: station_id, lon, lat, r.
    Stations at one place are counted together by their number, mean and squares, so the
    work grows with the pairs of places, not of stations. A pair at one place is at
    distance 0 and counts for nothing."""
    there = residuals.where("lon is not null and lat is not null and r is not null")
    p = table(there.groupBy("lon", "lat").agg(F.min("station_id").alias("station_id"), F.count(F.lit(1)).alias("n"), F.avg("r").alias("m"), F.var_pop("r").alias("v")), "places")
    side = lambda x, key: p.select(F.col("station_id").alias(key), *[F.col(c).alias(f"{c}{x}") for c in ("n", "m", "v")])
    x = station_pairs(p, radius).where("station_id < ngh_id and dist_km > 0").join(side("a", "station_id"), "station_id").join(side("b", "ngh_id"), "ngh_id")
    both = (F.col("na") * F.col("nb")).cast("double")
    square = both * (F.col("va") + F.col("vb") + F.pow(F.col("ma") - F.col("mb"), 2))
    n = F.sum(F.col("na") * F.col("nb"))
    return x.groupBy(F.floor(F.col("dist_km") / width).cast("int").alias("bin")).agg(n.alias("n"), (F.sum(both * F.col("dist_km")) / n).alias("h"), (F.sum(square) / (2 * n)).alias("gamma"))


def variogram_bins_by(stations: DataFrame, key: str, radius: float, width: float) -> DataFrame:
    """key, bin, n, h, gamma of all pairs at different places within the radius, by the key
    of the station that stands first by id. stations: station_id, lon, lat, r and key.

    While there are at most SENT stations they go whole to every task, and a task takes
    places: all stations in reach are put in bins, in the order of their ids, so running
    sums say what a station of the place has behind it. Memory follows the number of
    stations, the work places times stations, and no pair is a row."""
    there = stations.select("station_id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), F.col("r").cast("double").alias("r"), key).where("lon is not null and lat is not null and station_id is not null")
    kind = there.schema[key].dataType.simpleString()
    if there.count() <= SENT:
        t = there.orderBy("station_id").toArrow().combine_chunks()
        lon, lat, r = (t.column(c).to_numpy() for c in ("lon", "lat", "r"))
        codes = t.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
        known = np.isfinite(r)
        middle = r[known].mean() if known.any() else 0.0
        ids = t.column("station_id").to_numpy()
        shared = there.sparkSession.sparkContext.broadcast((ids, lon, lat, np.where(known, r - middle, 0.0), known, codes.indices.to_numpy(), codes.dictionary))

        def run(batches):
            ids, lon, lat, r, known, code, names = shared.value
            at, place = np.unique(np.stack([lon, lat]), axis=1, return_inverse=True)
            place = place.ravel()
            by_place = np.argsort(place, kind="stable")
            start = np.searchsorted(place[by_place], np.arange(at.shape[1] + 1))
            here = {(x, y): i for i, (x, y) in enumerate(at.T)}
            for b in batches:
                sums: dict[tuple[int, int], np.ndarray] = {}
                for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    i = here[x, y]
                    d = kernels.km(x, y, at[0], at[1])
                    in_bin = np.where((d > 0) & (d <= radius), np.floor(d / width), -1).astype(np.int32)
                    other = np.flatnonzero(in_bin[place] >= 0)
                    other = other[np.argsort(in_bin[place[other]], kind="stable")]
                    bins = in_bin[place[other]]
                    columns = np.stack([np.ones(len(other)), d[place[other]], known[other], r[other], r[other] ** 2])
                    running = np.concatenate([np.zeros((5, 1)), columns.cumsum(1)], 1)
                    own = by_place[start[i] : start[i + 1]]
                    for k in np.unique(bins):
                        low, high = np.searchsorted(bins, [k, k + 1])
                        after = low + np.searchsorted(ids[other[low:high]], ids[own], side="right")
                        n, dist, n_r, s_r, s_rr = running[:, [high]] - running[:, after]
                        square = np.where(known[own], n_r * r[own] ** 2 - 2 * r[own] * s_r + s_rr, 0.0)
                        total = np.stack([np.bincount(code[own], v, len(names)) for v in (n, dist, square, np.where(known[own], n_r, 0.0))])
                        for c in np.flatnonzero(total[0]):
                            sums[c, k] = sums.get((c, k), 0.0) + total[:, c]
                if sums:
                    c, k = np.array(list(sums)).T
                    n, dist, square, n_r = np.array(list(sums.values())).T
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(c)), pa.array(k, pa.int32()), pa.array(n.astype(np.int64)), pa.array(dist), pa.array(square), pa.array(n_r)], [key, "bin", "n", "dist", "square", "known"])

        spread = int(there.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        places = there.select("lon", "lat").distinct().repartition(spread, F.xxhash64("lon", "lat"))
        x = map_arrow(places, run, f"{key} {kind}, bin int, n long, dist double, square double, known double")
    else:
        side = lambda of, to: there.select(F.col("station_id").alias(of), F.col("r").alias(to), *([key] if to == "_a" else []))
        pairs = dealt(station_pairs(there, radius).where("station_id < ngh_id and dist_km > 0")).join(side("station_id", "_a"), "station_id").join(side("ngh_id", "_b"), "ngh_id")
        square = F.pow(F.col("_a") - F.col("_b"), 2)
        x = pairs.select(key, F.floor(F.col("dist_km") / width).cast("int").alias("bin"), F.lit(1).cast("long").alias("n"), F.col("dist_km").alias("dist"), F.coalesce(square, F.lit(0.0)).alias("square"), square.isNotNull().cast("double").alias("known"))
    n = F.sum("n")
    return x.groupBy(key, "bin").agg(n.alias("n"), (F.sum("dist") / n).alias("h"), F.when(F.sum("known") > 0, F.sum("square") / (2 * n)).alias("gamma"))


def autofit_variograms(bins: DataFrame, key: str, models: tuple[str, ...] = variograms.MODELS, kappas: tuple[float, ...] = variograms.KAPPAS) -> DataFrame:
    """key, model, kappa, nug, psill, rng, sserr, status of each empirical variogram (key,
    n, h, gamma): the model with the least weighted squares. A variogram's bins are one
    row; many are fitted together. Bins without pairs or at distance 0 count for nothing."""
    rows = bins.groupBy(key).agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("n", "h", "gamma")])).alias("b"))
    kind = bins.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                flat, start = part.column(1).flatten(), part.column(1).offsets.to_numpy()
                size = np.diff(start)
                place = np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
                n, h, gamma = (np.zeros((len(size), max(1, int(size.max(initial=0))))) for _ in range(3))
                for to, i in ((n, 0), (h, 1), (gamma, 2)):
                    to[place] = flat.field(i).to_numpy(zero_copy_only=False)
                bad = ~np.isfinite(n + h + gamma)
                n[bad] = h[bad] = gamma[bad] = 0.0
                out = variograms.autofit(h, gamma, n, models, kappas)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out["model"], pa.string()), *(pa.array(out[c], pa.float64(), from_pandas=True) for c in ("kappa", "nug", "psill", "rng", "sserr")), pa.array(out["status"], pa.string())], [key, "model", "kappa", "nug", "psill", "rng", "sserr", "status"])

    return map_arrow(rows, run, f"{key} {kind}, model string, kappa double, nug double, psill double, rng double, sserr double, status string")


def fit_variograms(points: DataFrame, near: DataFrame, stations: DataFrame, norms: DataFrame, predictors: tuple[str, ...] = ("lon", "lat", "elev")) -> DataFrame:
    """point_id, month, nug, psill, rng fitted over each point's neighbours; near is a
    list of neighbours (nearest). Stations without a norm in a month count in none."""
    near = dealt(near).join(neighbourhoods.usable(stations, norms, predictors, ("norm",)).select("station_id"), "station_id", "left_semi")
    rows = neighbourhoods.packed(points, near, stations, norms, 1 << 20, predictors, (), ("norm",))

    def kernel(x):
        return kernels.fit_variograms(x["f"], x["norm"], x["lon"], x["lat"], x["dist"].max(1))

    return neighbourhoods.solve(rows, predictors, (), ("norm",), kernel, "nug double, psill double, rng double").drop("k")


def apply_weights(weights: DataFrame, values: DataFrame, weight: str, keys: list[str]) -> DataFrame:
    """point_id, keys, value: the sum of weight * value over stations."""
    return dealt(weights).join(values, "station_id").groupBy("point_id", *keys).agg(F.sum(F.col(weight) * F.col("value")).alias("value"))


def interpolate_daily(points: DataFrame, stations: DataFrame, daily: DataFrame, norms: DataFrame, point_norms: DataFrame, k: int, **how) -> DataFrame:
    """point_id, obs_date, value: anomalies from the stations' monthly norms by
    geographically weighted regression, plus the point's norm (point_id, month, norm)."""
    near = nearest(points, stations, k, **how)
    z = gwr_weights(points, near, stations)
    a = daily.withColumn("month", F.month("obs_date")).join(norms.select("station_id", "month", "norm"), ["station_id", "month"])
    out = apply_weights(z, a.select("station_id", "obs_date", "month", (F.col("value") - F.col("norm")).alias("value")), "z", ["obs_date", "month"])
    return out.join(point_norms, ["point_id", "month"]).select("point_id", "obs_date", (F.col("value") + F.col("norm")).alias("value"))


def interpolate_normals(points: DataFrame, stations: DataFrame, norms: DataFrame, k: int, predictors: tuple[str, ...] = ("lon", "lat", "elev"), **how) -> DataFrame:
    """point_id, month, norm, variance: of each point and month the variogram of its k
    neighbours' norms, kriging weights and their sum, all in one pass over the lists.
    Stations need a norm in every month."""
    s = neighbourhoods.usable(stations, norms, predictors, ("norm",))
    rows = neighbourhoods.packed(points, nearest(points, s, k, **how), s, norms, k, predictors, (), ("norm",))
    return neighbourhoods.solve(rows, predictors, (), ("norm",), fitted_kriging, "nug double, psill double, rng double, norm double, variance double").select("point_id", "month", "norm", "variance")


def kriging(x: dict, nug: np.ndarray, psill: np.ndarray, rng: np.ndarray) -> tuple[np.ndarray, ...]:
    """nug, psill, rng, norm, variance of a lot of systems (neighbourhoods.solve)."""
    h = kernels.km(x["lon"][:, :, None], x["lat"][:, :, None], x["lon"][:, None, :], x["lat"][:, None, :])
    lam, var = kernels.drift_weights(x["f"], x["f0"], h, x["dist"], nug, psill, rng)
    return nug, psill, rng, (lam * x["norm"]).sum(1), var


def fitted_kriging(x: dict) -> tuple[np.ndarray, ...]:
    return kriging(x, *kernels.fit_variograms(x["f"], x["norm"], x["lon"], x["lat"], x["dist"].max(1)))


def fix_crossed(daily: DataFrame, tail: int = 15, literal: bool = True) -> DataFrame:
    """point_id, obs_date, tmin, tmax with days where tmin >= tmax mended. literal: one
    after the other, so what is mended counts for later days; else all from valid
    days only, by a window, which is the same if such days lie more than tail apart."""
    if not literal:
        near = Window.partitionBy("point_id").orderBy("obs_date").rowsBetween(-tail, tail)
        span = F.avg(F.when(F.col("tmin") < F.col("tmax"), F.col("tmax") - F.col("tmin"))).over(near)
        mid, bad = (F.col("tmin") + F.col("tmax")) / 2, F.col("tmin") >= F.col("tmax")
        x = daily.withColumns({"_s": span, "_m": mid, "_b": bad})
        return x.select("point_id", "obs_date", F.when(F.col("_b"), F.col("_m") - F.col("_s") / 2).otherwise(F.col("tmin")).alias("tmin"), F.when(F.col("_b"), F.col("_m") + F.col("_s") / 2).otherwise(F.col("tmax")).alias("tmax"))
    ship(daily.sparkSession)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("obs_date")
        a, b, _ = kernels.fix_crossed(g["tmin"].to_numpy(float), g["tmax"].to_numpy(float), tail)
        return g[["point_id", "obs_date"]].assign(tmin=a, tmax=b)

    return daily.groupBy("point_id").applyInPandas(run, f"point_id {daily.schema['point_id'].dataType.simpleString()}, obs_date date, tmin double, tmax double")


def interpolate_range(points: DataFrame, stations: DataFrame, daily: DataFrame, norms: DataFrame, k_norm: int, k_anom: int, normal_years: tuple[int, int] = (1981, 2010), **how) -> tuple[DataFrame, DataFrame]:
    """Daily minima and maxima of points, and their normals. daily: station_id, obs_date,
    tmin, tmax; norms: station_id, month, tmin, tmax.

    Per element the normals by kriging and the days by weighted regression; crossed
    days are mended, and the normals of points that had any are the means over years
    of the monthly means of their mended days. A point outside the mask (column mask,
    if there is one) is an error."""
    if "mask" in points.columns:
        points = points.withColumn("lon", F.when(F.col("mask"), F.col("lon")).otherwise(F.raise_error(F.lit("a point lies outside the mask")).cast("double")))
    day, normal = None, None
    for e in ("tmin", "tmax"):
        n = norms.select("station_id", "month", F.col(e).alias("norm"))
        pn = interpolate_normals(points, stations, n, k_norm, **how).select("point_id", "month", "norm", "variance")
        d = interpolate_daily(points, stations, daily.select("station_id", "obs_date", F.col(e).alias("value")), n, pn.select("point_id", "month", "norm"), k_anom, **how).withColumnRenamed("value", e)
        pn = pn.select("point_id", "month", F.col("norm").alias(f"{e}_norm"), F.sqrt(F.greatest("variance", F.lit(0.0))).alias(f"{e}_se"))
        day = d if day is None else day.join(d, ["point_id", "obs_date"])
        normal = pn if normal is None else normal.join(pn, ["point_id", "month"])
    return mend_range(day, normal, normal_years)


def mend_range(day: DataFrame, normal: DataFrame, normal_years: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Crossed days mended, and the normals of the points that had any made again from
    their days."""
    mended = fix_crossed(day)
    crossed = day.where("tmin >= tmax").select("point_id").distinct().withColumn("_c", F.lit(True))
    monthly = mended.join(crossed, "point_id").where(F.year("obs_date").between(*normal_years)).groupBy("point_id", F.year("obs_date").alias("year"), F.month("obs_date").alias("month")).agg(F.avg("tmin").alias("a"), F.avg("tmax").alias("b"))
    again = monthly.groupBy("point_id", "month").agg(F.avg("a").alias("_a"), F.avg("b").alias("_b"))
    normal = normal.join(again, ["point_id", "month"], "left").select("point_id", "month", F.coalesce("_a", "tmin_norm").alias("tmin_norm"), "tmin_se", F.coalesce("_b", "tmax_norm").alias("tmax_norm"), "tmax_se")
    return mended, normal


def leave_one_out(stations: DataFrame, values: DataFrame, k: int, predictors: tuple[str, ...] = ("lon", "lat", "elev"), drop_zero: bool = True, **how) -> DataFrame:
    """station_id, keys of values, obs, pred: each station from its neighbours only, by
    weighted regression. values: station_id, month (or obs_date), value. drop_zero: other
    stations at the same place are no neighbours either."""
    pts = stations.withColumn("point_id", F.col("station_id"))
    near = nearest(pts, stations, k, drop_zero=drop_zero, others=True, **how)
    z = gwr_weights(pts, near, stations, predictors)
    keys = [c for c in values.columns if c not in ("station_id", "value")]
    pred = apply_weights(z, values, "z", keys).select(F.col("point_id").alias("station_id"), *keys, F.col("value").alias("pred"))
    return values.withColumnRenamed("value", "obs").join(dealt(pred), ["station_id", *keys])


def leave_one_out_normals(stations: DataFrame, norms: DataFrame, k: int, **how) -> DataFrame:
    """station_id, month, obs, pred: each station's norm (station_id, month, norm) by
    kriging from its neighbours only."""
    pts = stations.withColumn("point_id", F.col("station_id"))
    pred = interpolate_normals(pts, stations, norms, k, drop_zero=True, **how).select(F.col("point_id").alias("station_id"), "month", F.col("norm").alias("pred"))
    return norms.where("norm is not null").select("station_id", "month", F.col("norm").alias("obs")).join(dealt(pred), ["station_id", "month"])


def normal_errors(stations: DataFrame, station_month: DataFrame, k: int = 100, drop_zero: bool = True, **how) -> DataFrame:
    """station_id, month, err: predicted less observed monthly norm of each station, and
    annual (month 13, means of both columns), by weighted regression on lst, elev, lon
    and lat of its neighbours only. station_month: station_id, month, norm, lst. Its
    outliers are stations.z_outliers. drop_zero: as for leave_one_out."""
    m = station_month.select("station_id", "month", "norm", "lst")
    m = m.unionByName(m.groupBy("station_id").agg(F.lit(13).alias("month"), F.avg("norm").alias("norm"), F.avg("lst").alias("lst"))).where("norm is not null and lst is not null")
    predictors = ("lst", "elev", "lon", "lat")
    near = nearest(stations.withColumn("point_id", F.col("station_id")), stations, k, drop_zero=drop_zero, others=True, **how).select("point_id", "station_id", "wgt")
    place = ("elev", "lon", "lat")
    side = lambda x, key: m.join(stations.select("station_id", *place), "station_id").select(F.col("station_id").alias(key), "month", F.col("norm").alias(f"{x}_norm"), *[F.col(c).cast("double").alias(f"{x}_{c}") for c in predictors])
    rows = dealt(near).join(side("s", "station_id"), "station_id").join(dealt(side("p", "point_id")), ["point_id", "month"])
    both = rows.withColumn("point_id", F.struct("point_id", "month", F.col("p_norm").alias("norm")))
    ngh, point, kernel = _regression(predictors)

    def value(w, norm, *x):
        z, _ = kernel(w, *x)
        return (z * norm,)

    parts = _solve(both, [ngh[0], "s_norm", *ngh[1:]], point, value, "part double")
    return parts.groupBy("point_id").agg(F.sum("part").alias("pred")).select(F.col("point_id.point_id").alias("station_id"), "point_id.month", (F.col("pred") - F.col("point_id.norm")).alias("err"))


def bandwidth_errors(stations: DataFrame, values: DataFrame, ks: list[int], method: str = "regression", **how) -> DataFrame:
    """climdiv, month, n_nghs, station_id, mae, status for each number of neighbours:
    leaving stations out, by weighted regression, or with method kriging the monthly
    values as norms. values: station_id, month, value."""
    kriged = method != "regression"
    pts = stations.withColumn("point_id", F.col("station_id"))
    near = table(nearest(pts, stations, max(ks), drop_zero=True, **how), "bandwidths")  # one search for all
    norms = values.withColumnRenamed("value", "norm")
    out = None
    for k in ks:  # a fixed list of a dozen bandwidths
        some = first_neighbours(near, k)
        if kriged:
            rows = neighbourhoods.packed(pts, some, stations, norms, k, PLACE, (), ("norm",))
            pred = neighbourhoods.solve(rows, PLACE, (), ("norm",), fitted_kriging, "nug double, psill double, rng double, norm double, variance double").select(F.col("point_id").alias("station_id"), "month", F.col("norm").alias("pred"))
        else:
            pred = apply_weights(gwr_weights(pts, some, stations), values, "z", ["month"]).select(F.col("point_id").alias("station_id"), "month", F.col("value").alias("pred"))
        loo = values.withColumnRenamed("value", "obs").join(pred, ["station_id", "month"])
        e = loo.groupBy("station_id", "month").agg(F.avg(F.abs(F.col("pred") - F.col("obs"))).alias("mae"))
        e = e.join(stations.select("station_id", "climdiv"), "station_id").select("climdiv", "month", F.lit(k).alias("n_nghs"), "station_id", "mae", F.when(F.col("mae").isNull(), "failed").otherwise("ok").alias("status"))
        out = e if out is None else out.unionByName(e)
    return out


def first_neighbours(near: DataFrame, k: int) -> DataFrame:
    """The first k of longer lists (nearest), weighted up to the next one."""
    beyond = F.coalesce(F.max(F.when(F.col("rank") == k + 1, F.col("dist_km"))).over(Window.partitionBy("point_id")), F.col("bandwidth"))
    cut = near.withColumn("bandwidth", beyond).where(F.col("rank") <= k)
    return cut.withColumn("wgt", F.when(F.col("bandwidth") > 0, bisquare(F.col("dist_km"), F.col("bandwidth"))).otherwise(1.0))


def validation(loo: DataFrame) -> DataFrame:
    return loo.groupBy("station_id").agg(*errors())


def principal_components(vectors: DataFrame, value: str = "value") -> DataFrame:
    """component, variance, share of tall data (array<double> rows): sums and products
    of each partition by numpy, then by Spark; the small eigenproblem of the
    correlations on the driver. Rows without an array are left out."""
    x = vectors.select(F.col(value).alias("v")).where("v is not null")
    head = x.select(F.size("v")).first()
    if head is None:
        return vectors.sparkSession.createDataFrame([], "component int, variance double, share double")
    size = head[0]

    def run(batches):
        total = np.zeros((size + 1, size + 1))
        for b in batches:
            if b.num_rows:
                a = np.column_stack([np.ones(b.num_rows), b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)])
                total += a.T @ a
        if total[0, 0]:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["s"])

    sums = map_arrow(x, run, "s array<double>").select(F.posexplode("s").alias("p", "v")).groupBy("p").agg(F.sum("v").alias("v")).orderBy("p")
    total = np.array([r["v"] for r in sums.select("v").collect()]).reshape(size + 1, size + 1)  # (size + 1) ** 2 numbers
    n, m = total[0, 0], total[0, 1:] / total[0, 0]
    cov = (total[1:, 1:] - n * np.outer(m, m)) / (n - 1)
    sd = np.sqrt(np.diag(cov))
    var = np.linalg.eigvalsh(cov / np.outer(sd, sd))[::-1]
    return vectors.sparkSession.createDataFrame([(i + 1, float(v), float(v / var.sum())) for i, v in enumerate(var)], "component int, variance double, share double")
