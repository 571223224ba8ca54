"""Infilling missing days from neighbours and upper-air components."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions import kernels
from isohyet.operators.spatial import WHOLE_KM, station_pairs
from isohyet.shipping import ship
from isohyet.tables import table

#: Columns of a target's matrix, the target's own included.
MAX_COLUMNS = 31


def with_statistics(statistics: DataFrame) -> DataFrame:
    """station_id, month of those with a finite mean and a finite variance above 0."""
    finite = lambda c: F.col(c).isNotNull() & (F.abs(c) < float("inf"))  # noqa: E731  (NaN is above all)
    return statistics.where(finite("mean") & finite("vari") & (F.col("vari") > 0)).select("station_id", "month")


def candidates(daily: DataFrame, pairs: DataFrame, share: float = 2 / 3, min_d1: float = 0.7, usable: DataFrame | None = None) -> DataFrame:
    """(station_id, month, ngh_id, dist_km, n, d1, ok): neighbours that are observed on
    that share of the target's days of a calendar month. ok are those observed on that
    share of all days of the month, too; of the others only the one with the best d1 is
    kept, where it is the best of all and good enough.

    daily: station_id, obs_date, value (observed days). usable: the stations and months
    (station_id, month) that may be neighbours, else all; the others are no candidates
    at all, so they don't stand in the way of a best one either."""
    d = daily.where("value is not null").withColumn("month", F.month("obs_date"))
    days = d.agg(F.min("obs_date").alias("lo"), F.max("obs_date").alias("hi")).select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("x")).groupBy(F.month("x").alias("month")).agg(F.count(F.lit(1)).alias("n_days"))
    n = d.groupBy("station_id", "month").agg(F.count(F.lit(1)).alias("n_own"))
    ngh = d if usable is None else d.join(usable.select("station_id", "month"), ["station_id", "month"], "left_semi")
    ngh = ngh.select(F.col("station_id").alias("ngh_id"), "obs_date", F.col("value").alias("nv"))
    both = d.join(pairs, "station_id").join(ngh, ["ngh_id", "obs_date"])
    w = Window.partitionBy("station_id", "month", "ngh_id")
    both = both.withColumn("_m", F.avg("value").over(w))
    s = both.groupBy("station_id", "month", "ngh_id", "dist_km").agg(F.count(F.lit(1)).alias("n"), (1 - F.try_divide(F.sum(F.abs(F.col("nv") - F.col("value"))), F.sum(F.abs(F.col("nv") - F.col("_m")) + F.abs(F.col("value") - F.col("_m"))))).alias("d1"))
    s = s.join(n, ["station_id", "month"]).join(n.select(F.col("station_id").alias("ngh_id"), "month", F.col("n_own").alias("n_ngh")), ["ngh_id", "month"]).join(F.broadcast(days), "month")  # 12 rows
    s = s.where(F.col("n") >= F.round(share * F.col("n_own"))).withColumn("ok", F.col("n_ngh") >= F.round(share * F.col("n_days")))
    best = F.row_number().over(Window.partitionBy("station_id", "month").orderBy(F.desc("d1"), "ngh_id")) == 1
    return s.withColumn("_b", best).where(F.col("ok") | (F.col("_b") & (F.col("d1") >= min_d1))).select("station_id", "month", "ngh_id", "dist_km", "n", "d1", "ok")


def day_bits(days: DataFrame, key: str = "station_id") -> DataFrame:
    """key, month, words, bits: of each calendar month a bit for each of its days in days
    (key, obs_date), in words of 64 days; words without a day are left out."""
    at = F.year("obs_date") * 31 + F.day("obs_date") - 1
    word = days.groupBy(key, F.month("obs_date").alias("month"), F.floor(at / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("b"))
    x = word.groupBy(key, "month").agg(F.array_sort(F.collect_list(F.struct("word", "b"))).alias("x"))
    return x.select(key, "month", F.transform("x", lambda v: v["word"]).alias("words"), F.transform("x", lambda v: v["b"]).alias("bits"))


def _day_matrix(words: list, bits: list) -> np.ndarray:
    """Sets of days as rows of a boolean matrix, over the days of the first set."""
    there = np.asarray(words[0], np.int64)
    out = np.zeros((len(words), len(there)), np.uint64)
    for row, (w, b) in enumerate(zip(words, bits, strict=True)):
        w, b = np.asarray(w, np.int64), np.asarray(b, np.int64)
        known = np.isin(w, there)
        out[row, np.searchsorted(there, w[known])] = b[known].view(np.uint64)
    flat = np.unpackbits(out.view(np.uint8), axis=1, bitorder="little").astype(bool)
    return flat[:, flat[0]]


def kept_neighbours(daily: DataFrame, chosen: DataFrame, status: DataFrame | None = None, least: int = 3, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """station_id, month, ngh_id, rank, n_kept, n_bare: the neighbours of a target's
    matrix, in this order: of all candidates by falling d1 the shortest prefix that gives
    every day `least` values; of it the first `least` and each later one with a value on a
    day that has fewer so far; and only then the first max_columns - 1 of these. n_kept
    counts them before this cut, n_bare the days without any value after it.

    status (grown_candidates): where the radius had to grow, the prefix is longer than
    all candidates of the radius before. A group is one station and month, a bit a day
    and candidate."""
    ship(daily.sparkSession)
    own = day_bits(daily).withColumns({"ngh_id": F.lit(None).cast(chosen.schema["ngh_id"].dataType), "d1": F.lit(None).cast("double"), "ring": F.lit(-1)})
    ring = F.col("ring") if "ring" in chosen.columns else F.lit(0)
    held = day_bits(daily.where("value is not null")).withColumnRenamed("station_id", "ngh_id")
    rows = chosen.select("station_id", "month", "ngh_id", "d1", ring.alias("ring")).join(held, ["ngh_id", "month"])
    rows = rows.unionByName(own.join(chosen.select("station_id", "month").distinct(), ["station_id", "month"], "left_semi"))
    if status is not None:
        rows = rows.join(status.select("station_id", "month", F.col("ring").alias("last")), ["station_id", "month"], "left")
    else:
        rows = rows.withColumn("last", F.lit(0))
    ids = daily.schema["station_id"].dataType.simpleString()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["ring"], kind="stable")
        target, rest = g.iloc[:1], g.iloc[1:].sort_values(["d1", "ngh_id"], ascending=[False, True])
        g = pd.concat([target, rest])
        seen = _day_matrix(g["words"].tolist(), g["bits"].tolist())[1:]
        last = g["last"].iloc[0]
        total = len(rest)
        enough = (np.cumsum(seen, 0) >= least).all(1)
        prefix = int(enough.argmax()) + 1 if enough.any() and pd.notna(last) else total
        if pd.notna(last) and last > 0:
            prefix = max(prefix, int((rest["ring"] < last).sum()) + 1)
        prefix = min(total, max(prefix, least))
        keep = cover(np.where(seen[:prefix].T, 1.0, np.nan), least)
        cut = keep[: max_columns - 1]
        bare = int((~seen[cut].any(0)).sum())
        out = rest.iloc[cut]
        return pd.DataFrame({"station_id": out["station_id"], "month": out["month"], "ngh_id": out["ngh_id"], "rank": np.arange(1, len(cut) + 1), "n_kept": len(keep), "n_bare": bare})

    return rows.groupBy("station_id", "month").applyInPandas(run, f"station_id {ids}, month int, ngh_id {ids}, rank int, n_kept int, n_bare int")


def matrices(daily: DataFrame, chosen: DataFrame, max_columns: int = MAX_COLUMNS, least: int = 3) -> DataFrame:
    """Rows of the targets' matrices: station_id, month, obs_date, value, nghs (array of
    neighbour values by falling d1, null where missing) and their ids. chosen: what
    kept_neighbours gives, or candidates for it. At most max_columns - 1 neighbours, so a
    row and a group stay small."""
    top = chosen if "rank" in chosen.columns else kept_neighbours(daily, chosen, None, least, max_columns)
    d = daily.withColumn("month", F.month("obs_date"))
    ngh = daily.select(F.col("station_id").alias("ngh_id"), "obs_date", F.col("value").alias("nv"))
    wide = d.select("station_id", "month", "obs_date").join(top.select("station_id", "month", "ngh_id", "rank"), ["station_id", "month"]).join(ngh, ["ngh_id", "obs_date"], "left")
    rows = wide.groupBy("station_id", "month", "obs_date").agg(F.array_sort(F.collect_list(F.struct("rank", "ngh_id", "nv"))).alias("x"))
    rows = rows.select("station_id", "month", "obs_date", F.transform("x", lambda x: x["nv"]).alias("nghs"), F.transform("x", lambda x: x["ngh_id"]).alias("ngh_ids"))
    return d.select("station_id", "month", "obs_date", "value").join(rows, ["station_id", "month", "obs_date"])


def cover(m: np.ndarray, least: int = 3) -> np.ndarray:
    """Columns of neighbours (by falling worth) that are kept: the first `least`, and
    each later one with a value on a day that has fewer so far."""
    seen = ~np.isnan(m)
    keep = list(range(min(least, m.shape[1])))
    have = seen[:, keep].sum(1)
    for j in range(len(keep), m.shape[1]):
        if (seen[:, j] & (have < least)).any():
            keep.append(j)
            have = have + seen[:, j]
    return np.array(keep, int)


def upper_air_components(a: np.ndarray, explain: float = 0.99) -> np.ndarray:
    """The first scores that explain enough variance of an upper-air matrix."""
    scores, _, var = kernels.pca(a)
    return scores[:, : int(np.searchsorted(np.cumsum(var) / var.sum(), explain)) + 1]


def upper_air_matrix(points: DataFrame, cells: DataFrame, values: DataFrame, k: int = 4) -> DataFrame:
    """station_id, obs_date, x: the values (cell_id, obs_date, var, value) of the k
    nearest cells of a station, by rank and var, in an array."""
    from isohyet.sources.text import nearest_cells

    near = nearest_cells(points.select(F.col("station_id").alias("point_id"), "lon", "lat"), cells, k)
    rows = near.join(values, "cell_id").groupBy(F.col("point_id").alias("station_id"), "obs_date").agg(F.array_sort(F.collect_list(F.struct("rank", "var", "value"))).alias("x"))
    return rows.select("station_id", "obs_date", F.transform("x", lambda v: v["value"]).alias("x"))


def upper_air_scores(matrix: DataFrame, explain: float = 0.99) -> DataFrame:
    """station_id, obs_date, pcs: a station's first components of its complete days."""
    ship(matrix.sparkSession)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        size = g["x"].map(len).max()
        g = g[g["x"].map(lambda v: len(v) == size and not any(x is None or x != x for x in v))].sort_values("obs_date")
        scores = upper_air_components(np.array(g["x"].tolist(), float), explain) if len(g) > 2 else np.zeros((len(g), 0))
        return g[["station_id", "obs_date"]].assign(pcs=scores.tolist())

    kind = matrix.schema["station_id"].dataType.simpleString()
    return matrix.groupBy("station_id").applyInPandas(run, f"station_id {kind}, obs_date date, pcs array<double>")


def add_components(rows: DataFrame, scores: DataFrame, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """rows with the components after the neighbours, max_columns - 1 in all; where a
    group would have a day without any value, its last column is the first component."""
    x = rows.join(scores, ["station_id", "obs_date"], "left")
    room = F.slice(F.concat("nghs", F.coalesce("pcs", F.array().cast("array<double>"))), 1, max_columns - 1)
    x = x.withColumn("_x", room)
    bare = F.max((~F.exists("_x", lambda v: v.isNotNull())).cast("int")).over(Window.partitionBy("station_id", "month"))
    size = F.max(F.size("_x")).over(Window.partitionBy("station_id", "month"))
    x = x.withColumns({"_bare": bare, "_size": size})
    padded = F.transform(F.sequence(F.lit(0), F.col("_size") - 1), lambda i: F.get("_x", i))
    with_first = F.concat(F.slice(padded, F.lit(1), F.col("_size") - 1), F.array(F.get("pcs", F.lit(0))))
    replaced = (F.col("_bare") == 1) & F.col("pcs").isNotNull()
    if "ngh_ids" in x.columns:
        x = x.withColumn("ngh_ids", F.when(F.col("_bare") == 1, F.slice("ngh_ids", F.lit(1), F.col("_size") - 1)).otherwise(F.col("ngh_ids")))
    return x.withColumn("nghs", F.when(replaced, with_first).otherwise(padded)).drop("pcs", "_x", "_bare", "_size")


def _matrix(g: pd.DataFrame) -> np.ndarray:
    """The target's column and all of its neighbours (and components)."""
    m = np.array([[np.nan if v is None else v for v in r] for r in g["nghs"]], float)
    return np.column_stack([g["value"].to_numpy(float), m])


def _kinds(df: DataFrame) -> str:
    return f"station_id {df.schema['station_id'].dataType.simpleString()}, month int"


def monthly_statistics(rows: DataFrame) -> DataFrame:
    """station_id, month, mean, vari, status: maximum likelihood mean and variance of
    the target, given its neighbours, with missing days. A group is one station and
    calendar month of at most MAX_COLUMNS columns."""
    ship(rows.sparkSession)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        try:
            mu, cov = kernels.em_normal(_matrix(g))
            out, status = (float(mu[0]), float(cov[0, 0])), "ok"
        except Exception as e:
            out, status = (None, None), type(e).__name__
        return pd.DataFrame([[g["station_id"].iloc[0], int(g["month"].iloc[0]), *out, status]], columns=["station_id", "month", "mean", "vari", "status"])

    return rows.groupBy("station_id", "month").applyInPandas(run, f"{_kinds(rows)}, mean double, vari double, status string")


def infill(rows: DataFrame, statistics: DataFrame, explain: float = 0.99, tols: tuple[float, ...] = (1e-5, 1e-6, 1e-7), max_mae: float = 2.0, min_r2: float = 0.7) -> DataFrame:
    """station_id, month, obs_date, value, fitted, infilled, mae, bias, r2, reasons:
    probabilistic components of the standardised matrix, retried with finer
    tolerances while the fit is not good (where rows have ngh_ids, neighbours are
    standardised by their own mean and variance in statistics, and those for which it has
    none to give are left out; columns it does not know by what they hold); of the tries the one with the least error
    among those that are only inexact, else of all. infilled is the observation where
    there is one, else the fit."""
    ship(rows.sparkSession)
    x = rows.join(statistics.where("mean is not null and vari > 0").select("station_id", "month", "mean", "vari"), ["station_id", "month"])
    if "ngh_ids" in rows.columns:
        good = F.col("mean").isNotNull() & (F.col("vari") > 0)
        own = statistics.select(F.col("station_id").alias("ngh_id"), "month", F.struct(F.when(good, F.col("mean")).otherwise(float("inf")).alias("mean"), F.when(good, F.sqrt("vari")).otherwise(float("inf")).alias("std")).alias("s"))
        ids = rows.groupBy("station_id", "month").agg(F.first("ngh_ids").alias("ids")).select("station_id", "month", F.posexplode("ids").alias("at", "ngh_id")).join(own, ["ngh_id", "month"], "left")
        ids = ids.groupBy("station_id", "month").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("s.mean", F.lit(float("nan"))).alias("mean"), F.coalesce("s.std", F.lit(float("nan"))).alias("std")))).alias("s"))
        x = x.join(ids.select("station_id", "month", F.transform("s", lambda v: v["mean"]).alias("means"), F.transform("s", lambda v: v["std"]).alias("stds")), ["station_id", "month"], "left")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("obs_date")
        m = _matrix(g)
        mean, std = float(g["mean"].iloc[0]), float(np.sqrt(g["vari"].iloc[0]))
        z = m.copy()
        z[:, 0] = (z[:, 0] - mean) / std
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)  # a column without values
            c, s = np.nanmean(z[:, 1:], 0), np.nanstd(z[:, 1:], 0, ddof=1)
        keep = np.isfinite(c)
        if "means" in g and g["means"].iloc[0] is not None:
            n = min(len(g["means"].iloc[0]), len(c))
            means, stds = (np.asarray(g[k].iloc[0][:n], float) for k in ("means", "stds"))
            c[:n], s[:n] = np.where(np.isnan(means), c[:n], means), np.where(np.isnan(means), s[:n], stds)
            keep &= np.isfinite(c)
        with np.errstate(invalid="ignore"):
            z[:, 1:] = (z[:, 1:] - c) / np.where(s > 0, s, 1)
        z = z[:, np.concatenate([[True], keep])]
        obs = m[:, 0]
        seen = ~np.isnan(obs)
        tries = []
        for tol in tols if keep.any() else ():
            try:
                fit = kernels.ppca_series(z, mean, std, explain, tol)
            except np.linalg.LinAlgError:
                continue
            dif = fit[seen] - obs[seen]
            r = np.corrcoef(fit[seen], obs[seen])[0, 1] if seen.sum() > 2 and fit[seen].std() > 0 and obs[seen].std() > 0 else np.nan
            mae, bias, r2 = float(np.abs(dif).mean()), float(dif.mean()), float(r * r)
            reasons = [n for n, bad in (("mae", mae > max_mae), ("r2", not r2 >= min_r2), ("high", (fit > 57.7).any()), ("low", (fit < -89.4).any()), ("variance", kernels.variance_change(fit) is not None)) if bad]
            tries.append((reasons, mae, bias, r2, fit))
            if not reasons:
                break
        out = g[["station_id", "month", "obs_date", "value"]].copy()
        if not tries:
            return out.assign(fitted=None, infilled=out["value"], mae=None, bias=None, r2=None, reasons=[["failed"]] * len(out))
        fine = [t for t in tries if not set(t[0]) - {"mae", "r2"}] or tries
        reasons, mae, bias, r2, fit = min(fine, key=lambda t: t[1]) if tries[-1][0] else tries[-1]
        return out.assign(fitted=fit, infilled=np.where(seen, obs, fit), mae=mae, bias=bias, r2=r2, reasons=[reasons] * len(out))

    return x.groupBy("station_id", "month").applyInPandas(run, f"{_kinds(rows)}, obs_date date, value double, fitted double, infilled double, mae double, bias double, r2 double, reasons array<string>")


def infill_stations(daily: DataFrame, pairs: DataFrame, least: int = 3) -> DataFrame:
    """All of it: neighbours, statistics, infilled days."""
    rows = matrices(daily, candidates(daily, pairs), least=least)
    return infill(rows, monthly_statistics(rows))


def grown_candidates(daily: DataFrame, stations: DataFrame, least: int = 3, start: float = 75.0, step: float = 37.5, share: float = 2 / 3, min_d1: float = 0.7, targets: DataFrame | None = None, usable: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Neighbours from a radius that grows until every day has enough of them.

    First what candidates() gives with ring, the number of steps by which the radius
    must be wider than start to take a neighbour in; of those not ok only the best one
    of the first radius counts. Then station_id, month, ring, status: the least ring
    with `least` neighbours observed on every day of the period in that calendar month;
    status covered, or uncovered where all stations do not suffice (ring is then null
    and all count). daily: station_id, obs_date, value, of all days, value null where
    missing. targets: the stations (station_id) this is asked for, else all; usable: as
    for candidates().

    Of each day the ring of the least-th nearest value is what it needs, so one join
    finds the ring of a group at once; groups that need more than the radius searched
    are searched again within four times as much, until it is the whole globe."""
    seen = daily.where("value is not null").select(F.col("station_id").alias("ngh_id"), "obs_date")
    days = daily.select("station_id", "obs_date", F.month("obs_date").alias("month"))
    days = days if targets is None else days.join(targets.select("station_id"), "station_id", "left_semi")
    open_ = days.select("station_id", "month").distinct()
    ring = F.greatest(F.lit(0), F.ceil((F.col("dist_km") - start) / step)).cast("int")
    key = ["station_id", "month"]
    first, chosen, status, radius = None, None, None, start
    while True:
        last = radius >= WHOLE_KM
        pairs = station_pairs(stations, min(radius, WHOLE_KM)).join(open_.select("station_id").distinct(), "station_id", "left_semi")
        found = candidates(daily, pairs, share, min_d1, usable).withColumn("ring", ring).join(open_, key, "left_semi")
        # a best one that is not ok counts if it is the best of the first radius
        if first is None:
            found = first = table(found, "candidates")
            first = first.where("not ok")
        else:
            found = table(found.where("ok").unionByName(first.join(open_, key, "left_semi")), "candidates")
        have = found.select(*key, "ngh_id", "ring").join(seen, "ngh_id").where(F.month("obs_date") == F.col("month"))
        need = have.groupBy(*key, "obs_date").agg(F.get(F.array_sort(F.collect_list("ring")), F.lit(least - 1)).alias("need"))
        need = days.join(open_, key, "left_semi").join(need, [*key, "obs_date"], "left").groupBy(*key).agg(F.when(F.count("need") == F.count(F.lit(1)), F.max("need")).alias("ring"))
        need = table(need, "rings")
        done = need if last else need.where("ring is not null")
        out = found.join(done.select(*key, F.col("ring").alias("_r")), key).where("_r is null or ring <= _r").drop("_r")
        chosen = out if chosen is None else chosen.unionByName(out)
        of = done.select(*key, "ring", F.when(F.col("ring").isNull(), "uncovered").otherwise("covered").alias("status"))
        status = of if status is None else status.unionByName(of)
        open_ = need.where("ring is null").select(*key)
        if last or open_.isEmpty():
            return chosen, status
        radius *= 4


def grown_with_statistics(daily: DataFrame, stations: DataFrame, found: tuple[DataFrame, DataFrame], statistics: DataFrame, least: int = 3, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What grown_candidates gives where only stations with statistics are neighbours, and
    the groups (station_id, month) for which this differs from found, its result for all.

    A group none of whose candidates lacks them stays as it is: neither its ring nor its
    best one depends on what was no candidate. Only the others are searched again, and
    their radius grows on where taking a neighbour away left a day without enough."""
    chosen, status = found
    usable, key = table(with_statistics(statistics), "usable"), ["station_id", "month"]
    lacking = chosen.join(usable.withColumnRenamed("station_id", "ngh_id"), ["ngh_id", "month"], "left_anti")
    lacking = table(lacking.select(*key).distinct(), "lacking")
    if lacking.isEmpty():
        return chosen, status, lacking
    again = grown_candidates(daily, stations, least, targets=lacking.select("station_id").distinct(), usable=usable, **how)
    chosen, status = (a.join(lacking, key, "left_anti").unionByName(b.join(lacking, key, "left_semi")) for a, b in zip(found, again, strict=True))
    return chosen, status, lacking


def infill_network(daily: DataFrame, stations: DataFrame, least: int = 3, targets: DataFrame | None = None, scores: DataFrame | None = None, statistics: DataFrame | None = None, **how) -> DataFrame:
    """infill_stations with neighbours from a growing radius, for every station and
    month of daily; scores (upper_air_scores) go beside the neighbours. Those without any
    neighbour or fit keep their days as they are, with the reason; status says whether
    every day had `least` neighbours.

    statistics: station_id, month, mean, vari of all stations, as monthly_statistics gives
    them; else those of the matrices. With statistics of all stations (given, or
    worked out as there are no targets) only stations with a mean and a variance are
    neighbours in the days' matrices, and where one is not, its targets' neighbours are
    chosen anew without it."""
    found = grown_candidates(daily, stations, least, targets=targets, **how)
    key = ["station_id", "month"]
    widen = (lambda r: r) if scores is None else (lambda r: add_components(r, scores))
    rows = table(widen(matrices(daily, table(kept_neighbours(daily, *found, least), "neighbours"))), "matrices")  # read twice
    if statistics is None:
        own = table(monthly_statistics(rows), "statistics")
    else:
        own = statistics
    status = found[1]
    if statistics is not None or targets is None:
        chosen, status, lacking = grown_with_statistics(daily, stations, found, own, least, **how)
        if not lacking.isEmpty():
            chosen, of = (x.join(lacking, key, "left_semi") for x in (chosen, status))
            new = widen(matrices(daily, table(kept_neighbours(daily, chosen, of, least), "neighbours")))
            rows = table(rows.join(lacking, key, "left_anti").unionByName(new), "matrices")
    done = infill(rows, own)
    d = daily.select("station_id", "obs_date", F.month("obs_date").alias("month"), "value")
    d = d if targets is None else d.join(targets.select("station_id"), "station_id", "left_semi")
    rest = d.join(done.select("station_id", "month").distinct(), ["station_id", "month"], "left_anti")
    none = {"fitted": F.lit(None).cast("double"), "infilled": F.col("value"), **{c: F.lit(None).cast("double") for c in ("mae", "bias", "r2")}, "reasons": F.array(F.lit("no neighbours"))}
    return done.unionByName(rest.select("station_id", "month", "obs_date", "value", *[c.alias(n) for n, c in none.items()])).join(status.select("station_id", "month", "status"), ["station_id", "month"], "left")


def second_pass(infilled: DataFrame, daily: DataFrame, stations: DataFrame, suspect: DataFrame, least: int = 7, **how) -> DataFrame:
    """infilled with the series of the suspect stations (station_id) done again from
    more neighbours a day. The others' observations stay neighbours; with statistics
    (infill_network) only of stations that have them."""
    again = suspect.select("station_id").distinct()
    new = infill_network(daily, stations, least, targets=again, **how)
    return infilled.join(again, "station_id", "left_anti").unionByName(new)


def suspects(infilled: DataFrame) -> DataFrame:
    """Stations with a month whose fit was not good."""
    return infilled.where(F.size("reasons") > 0).select("station_id").distinct()


def cross_validate(daily: DataFrame, split: DataFrame, pairs: DataFrame) -> DataFrame:
    """mae, bias and r2 per station on the days that split (station_id, obs_date,
    value, train) holds back."""
    held = split.where("not train").select("station_id", "obs_date", F.lit(True).alias("_held"))
    masked = daily.join(held, ["station_id", "obs_date"], "left").select("station_id", "obs_date", F.when(F.col("_held").isNull(), F.col("value")).alias("value"))
    filled = infill_stations(masked, pairs).select("station_id", "obs_date", F.col("fitted").alias("pred"))
    from isohyet.functions.stats import errors

    return split.where("not train").select("station_id", "obs_date", F.col("value").alias("obs")).join(filled, ["station_id", "obs_date"]).groupBy("station_id").agg(*errors())


def bad_infill(infilled: DataFrame, bounds: tuple[float, float] = (-89.4, 57.7)) -> DataFrame:
    """station_id, reason: series with a change of variance or impossible values."""
    ship(infilled.sparkSession)
    kind = infilled.schema["station_id"].dataType.simpleString()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        v = g.sort_values("obs_date")["infilled"].dropna().to_numpy()
        why = [n for n, bad in (("variance change", kernels.variance_change(v) is not None), ("impossible value", bool(len(v)) and (v.min() < bounds[0] or v.max() > bounds[1]))) if bad]
        return pd.DataFrame({"station_id": g["station_id"].iloc[:1].repeat(len(why)), "reason": pd.Series(why, g.index[:1].repeat(len(why)), dtype=object)})

    return infilled.groupBy("station_id").applyInPandas(run, f"station_id {kind}, reason string")
