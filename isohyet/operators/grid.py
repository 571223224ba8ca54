"""Cells, tiles, raster lookups, packing and mosaics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions.scalars import haversine, pack
from isohyet.tables import table


@dataclass(frozen=True)
class Grid:
    """Upper left corner, cell size and numbers of rows and columns."""

    lon0: float
    lat0: float
    size: float
    rows: int
    cols: int

    def row(self, lat: Column) -> Column:
        return F.floor((F.lit(self.lat0) - lat) / self.size).cast("int")

    def col(self, lon: Column) -> Column:
        return F.floor((lon - F.lit(self.lon0)) / self.size).cast("int")

    def lat(self, row: Column) -> Column:
        """Of a cell's centre."""
        return F.lit(self.lat0) - (row + F.lit(0.5)) * self.size

    def lon(self, col: Column) -> Column:
        return F.lit(self.lon0) + (col + F.lit(0.5)) * self.size

    def inside(self, lon: Column, lat: Column) -> Column:
        return self.row(lat).between(0, self.rows - 1) & self.col(lon).between(0, self.cols - 1)

    def clip(self, row: Column, col: Column) -> tuple[Column, Column]:
        return F.least(F.greatest(row, F.lit(0)), F.lit(self.rows - 1)), F.least(F.greatest(col, F.lit(0)), F.lit(self.cols - 1))


def lookup(points: DataFrame, cells: DataFrame, g: Grid) -> DataFrame:
    """points (point_id, lon, lat) with the value of the cell (row, col, value) they
    are in; null outside or without data."""
    p = points.withColumns({"row": g.row(F.col("lat")), "col": g.col(F.col("lon"))})
    return p.join(cells, ["row", "col"], "left")


def bilinear(points: DataFrame, cells: DataFrame, g: Grid, fallback: bool = True) -> DataFrame:
    """point_id, value: from the four cell centres around a point; null if a corner
    is missing, then, with fallback, the value of its own cell."""
    x, y = (F.col("lon") - g.lon0) / g.size - 0.5, (F.lit(g.lat0) - F.col("lat")) / g.size - 0.5
    p = points.withColumns({"_c": F.floor(x).cast("int"), "_r": F.floor(y).cast("int")}).withColumns({"_fx": x - F.col("_c"), "_fy": y - F.col("_r")})
    corner = F.explode(F.array(*[F.struct((F.col("_r") + i).alias("row"), (F.col("_c") + j).alias("col"), ((F.col("_fy") if i else 1 - F.col("_fy")) * (F.col("_fx") if j else 1 - F.col("_fx"))).alias("w")) for i in (0, 1) for j in (0, 1)]))
    four = p.select("point_id", corner.alias("k")).select("point_id", "k.*").join(cells, ["row", "col"], "left")
    out = four.groupBy("point_id").agg(F.when(F.count("value") == 4, F.sum(F.col("w") * F.col("value"))).alias("value"))
    if not fallback:
        return out
    near = lookup(points, cells, g).select("point_id", F.col("value").alias("_near"))
    return out.join(near, "point_id").select("point_id", F.coalesce("value", "_near").alias("value"))


def nearest_with_data(points: DataFrame, cells: DataFrame, g: Grid, start: int = 4) -> DataFrame:
    """point_id, value: of the first ring of cells around the point's that has any
    data, the cell whose centre is nearest. Null only if no cell has data.

    Cells and points meet in blocks of cells, a point in the nine around it, which hold
    all its rings up to a block's side; points that have found nothing that near are
    searched again with blocks of four times the side, until none is left."""
    data = cells.where("value is not null").select("row", "col", "value")
    ends = data.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    p = points.select("point_id", "lon", "lat", g.row(F.col("lat")).alias("_r"), g.col(F.col("lon")).alias("_c"))
    if ends[0] is None:
        return p.select("point_id", F.lit(None).cast(cells.schema["value"].dataType).alias("value"))
    # points without a place find nothing; the others' farthest ring bounds the sides
    place = p.where("_r is not null and _c is not null")
    reach = place.agg(F.max(F.greatest(F.abs(F.col("_r") - ends[0]), F.abs(F.col("_r") - ends[1]), F.abs(F.col("_c") - ends[2]), F.abs(F.col("_c") - ends[3])))).first()[0] or 0
    dist = haversine(F.col("lon"), F.col("lat"), g.lon(F.col("col")), g.lat(F.col("row")))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    out, left, side = None, place, start
    while True:
        block = lambda c: F.floor(F.col(c) / side)
        near = left.withColumn("_k", around).withColumns({"_br": block("_r") + F.col("_k.i"), "_bc": block("_c") + F.col("_k.j")})
        met = near.join(data.withColumns({"_br": block("row"), "_bc": block("col")}), ["_br", "_bc"])
        ring = F.greatest(F.abs(F.col("row") - F.col("_r")), F.abs(F.col("col") - F.col("_c")))
        best = met.where(ring <= side).groupBy("point_id").agg(F.min(F.struct(ring.alias("ring"), dist.alias("d"), "row", "col", "value")).alias("x")).select("point_id", F.col("x.value").alias("value"))
        if side >= reach:
            out = best if out is None else out.unionByName(best)
            break
        best = table(best, "cells")
        out = best if out is None else out.unionByName(best)
        left = left.join(best.select("point_id"), "point_id", "left_anti")
        if left.isEmpty():
            break
        side *= 4
    return p.select("point_id").join(out, "point_id", "left")


def add_raster(points: DataFrame, cells: DataFrame, g: Grid, method: str = "bilinear", force: bool = False) -> DataFrame:
    """point_id, value by the method (bilinear or nearest); force fills what is left
    from the nearest cell with data."""
    out = bilinear(points, cells, g) if method == "bilinear" else lookup(points, cells, g).select("point_id", "value")
    if not force:
        return out
    left = points.join(out.where("value is null").select("point_id"), "point_id", "left_semi")
    return out.join(nearest_with_data(left, cells, g).withColumnRenamed("value", "_v"), "point_id", "left").select("point_id", F.coalesce("value", "_v").alias("value"))


def tile_of(row: str = "row", col: str = "col", size: int = 250) -> Column:
    return F.format_string("h%02dv%02d", F.floor(F.col(col) / size).cast("int"), F.floor(F.col(row) / size).cast("int"))


def tiles(cells: DataFrame, size: int = 250, chunk: int = 50) -> DataFrame:
    """tile_id, tile_num, n_cells of tiles with a cell in the mask, numbered by rows."""
    t = cells.where("mask").groupBy(tile_of(size=size).alias("tile_id"), F.floor(F.col("row") / size).cast("int").alias("v"), F.floor(F.col("col") / size).cast("int").alias("h")).agg(F.count(F.lit(1)).alias("n_cells"), F.count_distinct(F.floor(F.col("row") / chunk) * 1_000_000 + F.floor(F.col("col") / chunk)).alias("n_chunks"))
    number = F.row_number().over(Window.orderBy("v", "h")) - 1  # one row a tile
    return t.withColumn("tile_num", number).select("tile_id", "tile_num", "n_cells", "n_chunks")


def to_do(all_tiles: DataFrame, done: DataFrame) -> DataFrame:
    return all_tiles.join(done.select("tile_id").distinct(), "tile_id", "left_anti")


def expand(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """Cells cropped to the mask's box, which is then padded evenly to rows x cols:
    (row, col) of the new grid with the old value or null."""
    box = cells.where("mask").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    shift = box.select((F.col("r0") - F.floor((rows - (F.col("r1") - F.col("r0") + 1)) / 2)).cast("int").alias("dr"), (F.col("c0") - F.floor((cols - (F.col("c1") - F.col("c0") + 1)) / 2)).cast("int").alias("dc"), "r0", "r1", "c0", "c1")
    frame = cells.sparkSession.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    old = cells.crossJoin(F.broadcast(shift)).where(F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))).select((F.col("row") - F.col("dr")).alias("row"), (F.col("col") - F.col("dc")).alias("col"), "value")  # one row is broadcast
    return frame.join(old, ["row", "col"], "left")


def write_tiles(daily: DataFrame, path: str, size: int = 250) -> None:
    """Packed values partitioned by tile; a tile written again replaces the old one. A
    task writes a tile's year: a file each, sorted by cell and day."""
    out = daily.select(tile_of(size=size).alias("tile_id"), "row", "col", "obs_date", pack(F.col("tmin")).alias("tmin"), pack(F.col("tmax")).alias("tmax"))
    out.repartition("tile_id", F.year("obs_date")).sortWithinPartitions("tile_id", "row", "col", "obs_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile_id").parquet(path)


def yearly_mosaics(packed: DataFrame, path: str, rows: int = 20_000_000, block: int = 250) -> None:
    """Tiles joined, a folder a year of files of about so many rows, each a range of
    days and of blocks of rows of the grid, sorted for access by day.

    A day's file is found by the least and greatest day in its footer. Ranges are cut by
    days first, and within a day by rows and blocks of columns where a day alone is too
    large for one."""
    out = packed.withColumns({"year": F.year("obs_date"), "_r": F.floor(F.col("row") / block), "_c": F.floor(F.col("col") / block)})
    parts = max(1, -(-out.count() // rows))
    out = out.repartitionByRange(parts, "year", "obs_date", "_r", "_c").sortWithinPartitions("year", "obs_date", "row", "col").drop("_r", "_c")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def resample(cells: DataFrame, source: Grid, target: Grid, method: str = "average") -> DataFrame:
    """row, col, value and share (of its area that has data) of the target grid's cells
    that overlap any cell (row, col, value) with data.

    average: the mean by overlapping area; sum: what lies in the overlap of each cell, so
    that the sum over all cells stays the same where the target covers the source. A
    source cell knows by arithmetic which target cells it overlaps, so there is no join;
    sizes may differ in both directions. Areas are in degrees."""
    left, top = F.lit(source.lon0) + F.col("col") * source.size, F.lit(source.lat0) - F.col("row") * source.size
    c0, c1 = F.floor((left - target.lon0) / target.size), F.ceil((left + source.size - target.lon0) / target.size) - 1
    r0, r1 = F.floor((F.lit(target.lat0) - top) / target.size), F.ceil((F.lit(target.lat0) - top + source.size) / target.size) - 1
    c0, r0 = F.greatest(c0, F.lit(0)), F.greatest(r0, F.lit(0))
    c1, r1 = F.least(c1, F.lit(target.cols - 1)), F.least(r1, F.lit(target.rows - 1))
    x = cells.where("value is not null").select(left.alias("_x"), top.alias("_y"), "value", c0.alias("_c0"), c1.alias("_c1"), r0.alias("_r0"), r1.alias("_r1")).where("_c0 <= _c1 and _r0 <= _r1")
    x = x.withColumn("col", F.explode(F.sequence("_c0", "_c1"))).withColumn("row", F.explode(F.sequence("_r0", "_r1")))
    wide = F.least(F.col("_x") + source.size, F.lit(target.lon0) + (F.col("col") + 1) * target.size) - F.greatest(F.col("_x"), F.lit(target.lon0) + F.col("col") * target.size)
    high = F.least(F.col("_y"), F.lit(target.lat0) - F.col("row") * target.size) - F.greatest(F.col("_y") - source.size, F.lit(target.lat0) - (F.col("row") + 1) * target.size)
    x = x.withColumn("_w", F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))).where(F.col("_w") > 1e-12 * source.size * source.size)
    value = F.sum(F.col("value") * F.col("_w")) / (F.sum("_w") if method == "average" else F.lit(source.size**2))
    return x.groupBy(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).agg(value.alias("value"), (F.sum("_w") / target.size**2).alias("share"))


def normals_mosaic(normals: DataFrame) -> DataFrame:
    """row, col, elem, month, mid (day of month), packed normal and standard error."""
    return normals.select("row", "col", "elem", "month", F.make_date(F.lit(2001), "month", F.lit(15)).alias("mid"), pack(F.col("normal")).alias("normal"), pack(F.col("se")).alias("se"))


def monthly_mosaic(daily: DataFrame) -> DataFrame:
    """Monthly means of the mosaic (unpacked values), to hundredths."""
    return daily.groupBy("row", "col", F.year("obs_date").alias("year"), F.month("obs_date").alias("month")).agg(F.round(F.avg("tmin"), 2).alias("tmin"), F.round(F.avg("tmax"), 2).alias("tmax"))
