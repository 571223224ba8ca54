"""Which polygon a point lies in.

Polygons are cut by the cells of a grid and meet the points by an equi-join on the cell.
A cell without an edge lies inside or outside as a whole; in the others a point is inside
if the way to it from the cell's corner crosses an odd number of edges more or less."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.tables import table

#: The grid's corner lies off round numbers, on which borders like to lie.
_OFF = 0.2718281828


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size - _OFF)


def _corner(i: Column, size: float) -> Column:
    return (i + F.lit(_OFF)) * size


def edges(polygons: DataFrame) -> DataFrame:
    """zone_id, x0, y0, x1, y1 of the rings of polygons (zone_id, rings: arrays of rings,
    each an array of (lon, lat)); rings need not be closed. A zone may have many rows."""
    ring = polygons.select("zone_id", F.explode("rings").alias("p")).where(F.size("p") > 2)
    n = F.size("p")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("p", i).alias("a"), F.get("p", (i + 1) % n).alias("b")))
    e = ring.select("zone_id", F.explode(pairs).alias("e")).select("zone_id", F.col("e.a.lon").alias("x0"), F.col("e.a.lat").alias("y0"), F.col("e.b.lon").alias("x1"), F.col("e.b.lat").alias("y1"))
    return e.where("x0 <> x1 or y0 <> y1")


def _y_at(x: Column) -> Column:
    return F.col("y0") + (x - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))


def _x_at(y: Column) -> Column:
    return F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))


def cut(polygons: DataFrame, size: float) -> DataFrame:
    """zone_id, r, c, inside, edges: the cells a zone has a part in; inside says whether
    the cell's lower left corner is, edges are those that touch the cell."""
    e = table(edges(polygons), "edges")
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = e.withColumn("r", F.explode(F.sequence(_cell(low, size), _cell(high, size))))
    # within a row of cells an edge runs between where it enters and where it leaves it
    a = F.when(F.col("y0") == F.col("y1"), F.col("x0")).otherwise(_x_at(F.greatest(low, _corner(F.col("r"), size))))
    b = F.when(F.col("y0") == F.col("y1"), F.col("x1")).otherwise(_x_at(F.least(high, _corner(F.col("r") + 1, size))))
    slack = size * 1e-9  # an edge that runs along a border counts in both cells
    touched = rows.withColumn("c", F.explode(F.sequence(_cell(F.least(a, b) - slack, size), _cell(F.greatest(a, b) + slack, size))))
    touched = touched.groupBy("zone_id", "r", "c").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("edges"))
    # crossings of the lower borders of rows, in pairs: between them corners are inside
    line = _corner(F.col("r"), size)
    cross = rows.where((F.col("y0") <= line) != (F.col("y1") <= line)).select("zone_id", "r", _x_at(line).alias("x"))
    w = Window.partitionBy("zone_id", "r").orderBy("x")
    spans = cross.withColumns({"to": F.lead("x").over(w), "nth": F.row_number().over(w)}).where("nth % 2 = 1 and to is not null")
    # a corner with as many crossings to its right as make it odd: x <= corner < to
    first, last = F.ceil(F.col("x") / size - _OFF), F.ceil(F.col("to") / size - _OFF) - 1
    inner = spans.withColumns({"_a": first, "_b": last}).where("_a <= _b").select("zone_id", "r", F.explode(F.sequence("_a", "_b")).alias("c")).distinct()
    return touched.join(inner.withColumn("inside", F.lit(True)), ["zone_id", "r", "c"], "full").select("zone_id", "r", "c", F.coalesce("inside", F.lit(False)).alias("inside"), "edges")


def zone_of(points: DataFrame, polygons: DataFrame, size: float = 1.0) -> DataFrame:
    """points with zone_id: the polygon a point (lon, lat) lies in, of several the one
    with the smallest zone_id, else null.

    Rings within rings are holes (a point is inside if a line north from it crosses an odd
    number of edges). A point on a border belongs to what lies north of it, on a border
    that runs north to what lies east. Polygons must not cross the date line; points
    without a place are in none. size: degrees of a grid cell. Points may have any
    columns but zone_id; the same row twice stays twice."""
    key = points.withColumns({"_r": _cell(F.col("lat"), size), "_c": _cell(F.col("lon"), size)})
    cells = cut(polygons, size).withColumnsRenamed({"r": "_r", "c": "_c"})
    x, y = F.col("lon"), F.col("lat")
    left, low = _corner(F.col("_c"), size), _corner(F.col("_r"), size)

    def flips(e: Column) -> Column:
        x0, y0, x1, y1 = (e[c] for c in ("x0", "y0", "x1", "y1"))
        at = x0 + (low - y0) * (x1 - x0) / (y1 - y0)
        along = ((y0 <= low) != (y1 <= low)) & (at > left) & (at <= x)
        over = y0 + (x - x0) * (y1 - y0) / (x1 - x0)
        up = ((x0 <= x) != (x1 <= x)) & (over > low) & (over <= y)
        return F.coalesce(along, F.lit(False)) != F.coalesce(up, F.lit(False))

    odd = F.coalesce(F.size(F.filter("edges", flips)) % 2 == 1, F.lit(False))
    place = key.select("lon", "lat", "_r", "_c").where("_r is not null and _c is not null").distinct()
    found = place.join(cells, ["_r", "_c"]).where(F.col("inside") != odd).groupBy("lon", "lat").agg(F.min("zone_id").alias("zone_id"))
    return points.join(found, ["lon", "lat"], "left").select(*points.columns, "zone_id")


def utc_offset(stations: DataFrame, polygons: DataFrame, hours: DataFrame, size: float = 1.0) -> DataFrame:
    """stations with utc_offset: the hours (zone_id, hours) of the zone they lie in, else
    by longitude in bands of 15 degrees."""
    x = zone_of(stations, polygons, size).join(hours.select("zone_id", F.col("hours").cast("short").alias("_h")), "zone_id", "left")
    return x.withColumn("utc_offset", F.coalesce("_h", F.bround(F.col("lon") / 15, 0).cast("short"))).select(*stations.columns, "utc_offset")
