"""Lists of neighbours of which every month takes its own part.

A point's neighbours are searched once and kept as one list by distance; the k nearest
of a month are the first k of it, weighted up to the distance of the next one. Points go
to numpy in one row each, with all months; systems of equal size are solved together."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.functions.scalars import bisquare
from isohyet.shipping import map_arrow
from isohyet.tables import dealt

#: Values that a lot of systems may hold in one array of pairs of neighbours.
PAIRS = 2 << 20


def lots(size: np.ndarray, most: int = PAIRS):
    """Systems of equal size, in lots with a bounded number of pairs."""
    for m in np.unique(size):
        i, step = np.flatnonzero(size == m), max(1, most // max(1, int(m * m)))
        yield from (i[k : k + step] for k in range(0, len(i), step))


def prefixes(near: DataFrame, counts: DataFrame) -> DataFrame:
    """point_id, month, k, station_id, rank, dist_km, bandwidth, wgt: of each list
    (nearest) the first k of the point's month, bisquare weights up to the distance of
    the next one. counts: point_id, month, k. A list shorter than k counts whole; a null
    k takes nothing."""
    lists = near.groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("rank", "station_id", "dist_km"))).alias("n"), F.max("bandwidth").alias("_beyond"))
    x = lists.join(dealt(counts.where("k > 0").select("point_id", "month", "k")), "point_id")
    x = x.withColumn("bandwidth", F.coalesce(F.get("n", F.col("k"))["dist_km"], "_beyond"))
    x = x.select("point_id", "month", "k", "bandwidth", F.explode(F.slice("n", F.lit(1), F.col("k"))).alias("s")).select("point_id", "month", "k", "s.station_id", "s.rank", "s.dist_km", "bandwidth")
    return x.withColumn("wgt", F.when(F.col("bandwidth") > 0, bisquare(F.col("dist_km"), F.col("bandwidth"))).otherwise(1.0))


def by_month(table: DataFrame, key: str, columns: tuple[str, ...], prefix: str) -> DataFrame:
    """key and of each column an array of its twelve values."""
    value = lambda c: F.array(*[F.max(F.when(F.col("month") == m, F.col(c).cast("double"))) for m in range(1, 13)])
    return table.groupBy(key).agg(*[value(c).alias(f"{prefix}{c}") for c in columns])


def usable(stations: DataFrame, station_month: DataFrame, fixed: tuple[str, ...], needed: tuple[str, ...]) -> DataFrame:
    """The stations with all fixed predictors and with every needed column of
    station_month in each of the months it has."""
    months = station_month.select("month").distinct().count()
    whole = station_month.groupBy("station_id").agg(*[F.count(F.when(F.col(c).isNotNull(), F.lit(1))).alias(f"_{i}") for i, c in enumerate(needed)])
    whole = whole.where(" and ".join(f"_{i} = {months}" for i in range(len(needed)))).select("station_id")
    return stations.join(whole, "station_id", "left_semi").dropna(subset=list(dict.fromkeys(("lon", "lat", *fixed))))


def packed(points: DataFrame, near: DataFrame, stations: DataFrame, station_month: DataFrame, counts: DataFrame | int, fixed: tuple[str, ...], monthly: tuple[str, ...], values: tuple[str, ...], point_month: DataFrame | None = None) -> DataFrame:
    """One row a point for solve(): its list with the stations' place, fixed predictors,
    monthly predictors and values (columns of station_month), the point's predictors
    (monthly ones from point_month) and its months, each with its k: counts (point_id,
    month, k), or one number for every month of station_month."""
    place = tuple(dict.fromkeys(("lon", "lat", *fixed)))
    s = stations.select("station_id", *[F.col(c).cast("double").alias(c) for c in place]).join(by_month(station_month, "station_id", tuple(dict.fromkeys((*monthly, *values))), ""), "station_id")
    each = ["rank", "dist_km", "station_id", *s.columns[1:]]
    lists = dealt(near.select("point_id", "station_id", "rank", "dist_km", "bandwidth")).join(s, "station_id").groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct(*each))).alias("n"), F.max("bandwidth").alias("beyond"))
    x = lists.join(dealt(points.select("point_id", *[F.col(c).cast("double").alias(f"p_{c}") for c in place])), "point_id")
    if monthly:
        x = x.join(dealt(by_month(point_month, "point_id", monthly, "p_")), "point_id")
    if isinstance(counts, int):
        months = sorted(r[0] for r in station_month.select("month").distinct().collect())  # twelve at most
        return x.withColumn("months", F.array(*[F.struct(F.lit(m).cast("int").alias("month"), F.lit(counts).alias("k")) for m in months]))
    asked = counts.groupBy("point_id").agg(F.collect_list(F.struct(F.col("month").cast("int").alias("month"), F.coalesce(F.col("k").cast("int"), F.lit(0)).alias("k"))).alias("months"))
    return x.join(dealt(asked), "point_id")


def solve(rows: DataFrame, fixed: tuple[str, ...], monthly: tuple[str, ...], values: tuple[str, ...], kernel: Callable, out: str, each: bool = False) -> DataFrame:
    """point_id, month, k, (each: station_id,) and the columns out, from packed rows.

    kernel takes a dict of arrays of many systems of one size: lon, lat, dist and wgt of
    shape (systems, k), f (systems, k, predictors), p_lon, p_lat, bandwidth (systems,),
    f0 (systems, predictors), and each of values (systems, k). It returns arrays of shape
    (systems,), or (systems, k) if each. NaN becomes null."""
    place = tuple(dict.fromkeys(("lon", "lat", *fixed)))
    names = [c.split()[0] for c in out.split(", ")]
    inner = rows.schema["n"].dataType.elementType
    kinds = f"point_id {rows.schema['point_id'].dataType.simpleString()}, month int, k int, " + (f"station_id {inner['station_id'].dataType.simpleString()}, " if each else "")
    tables = tuple(dict.fromkeys((*monthly, *values)))

    def numbers(a: pa.Array) -> np.ndarray:
        return a.to_numpy(zero_copy_only=False).astype(float)

    def run(batches):
        for b in batches:
            col = lambda c, b=b: b.column(b.schema.get_field_index(c))
            flat, start = col("n").flatten(), col("n").offsets.to_numpy()
            start = start - start[0]
            size = np.diff(start)
            field = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
            own = {c: numbers(field[c]) for c in ("dist_km", *place)}
            table = {c: numbers(field[c].flatten()).reshape(-1, 12) for c in tables}
            point = {c: numbers(col(f"p_{c}")) for c in place}
            of_month = {c: numbers(col(f"p_{c}").flatten()).reshape(-1, 12) for c in monthly}
            beyond = numbers(col("beyond"))
            asked, first = col("months").flatten(), col("months").offsets.to_numpy()
            owner = np.repeat(np.arange(b.num_rows), np.diff(first))
            month, k = asked.field(0).to_numpy(), asked.field(1).to_numpy()
            least = np.minimum(k, size[owner])
            for i in lots(least):
                m = int(least[i[0]])
                if not m:
                    continue
                o, mi = owner[i], month[i] - 1
                at = start[o][:, None] + np.arange(m)
                dist = own["dist_km"][at]
                more = size[o] > k[i]
                bandwidth = np.where(more, own["dist_km"][np.where(more, start[o] + m, 0)], beyond[o])[:, None]
                with np.errstate(invalid="ignore", divide="ignore"):
                    wgt = np.where(bandwidth > 0, (1 - (dist / bandwidth) ** 2) ** 2 * (dist < bandwidth), 1.0)
                lot = {"lon": own["lon"][at], "lat": own["lat"][at], "dist": dist, "wgt": wgt, "bandwidth": bandwidth[:, 0], "p_lon": point["lon"][o], "p_lat": point["lat"][o], "month": month[i]}
                lot["f"] = np.stack([own[c][at] for c in fixed] + [table[c][at, mi[:, None]] for c in monthly], 2) if fixed or monthly else np.zeros((len(i), m, 0))
                lot["f0"] = np.stack([point[c][o] for c in fixed] + [of_month[c][o, mi] for c in monthly], 1) if fixed or monthly else np.zeros((len(i), 0))
                lot |= {c: table[c][at, mi[:, None]] for c in values}
                found = kernel(lot)
                r = np.repeat(i, m) if each else i
                head = [col("point_id").take(pa.array(owner[r])), pa.array(month[r], pa.int32()), pa.array(k[r], pa.int32())]
                if each:
                    head.append(field["station_id"].take(pa.array(at.ravel())))
                yield pa.RecordBatch.from_arrays([*head, *(pa.array(np.ravel(x), from_pandas=True) for x in found)], ["point_id", "month", "k", *(["station_id"] if each else []), *names])

    # solving takes far longer than its rows are large: they are dealt anew, by number, so
    # that small partitions are not put together
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(rows.repartition(spread, F.xxhash64("point_id")), run, kinds + out)
