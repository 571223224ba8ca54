"""Text formats of the station archives, read and written as DataFrames.

Missing values become null here; no sentinel gets further."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.functions.scalars import archive_units, feet_to_m, station_code


def fixed(column: str, **fields: tuple[int, int]) -> list[Column]:
    """Trimmed substrings by first and end place, from 0."""
    return [F.trim(F.substring(column, a + 1, b - a)).alias(n) for n, (a, b) in fields.items()]


def number(c: Column | str, kind: str = "double") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.try_to_number(c, F.lit("S999999.999999")).cast(kind) if kind == "decimal" else c.try_cast(kind)


def ghcn_stations(spark: SparkSession, path: str, countries: tuple[str, ...] = ("US", "CA", "MX"), not_states: tuple[str, ...] = ("HI", "AK"), not_networks: tuple[str, ...] = ("S", "R")) -> DataFrame:
    x = spark.read.text(path).select(*fixed("value", station_id=(0, 11), lat=(12, 20), lon=(21, 30), elev=(31, 37), state=(38, 40), station_name=(41, 71), hcn=(76, 79)))
    x = x.where(F.substring("station_id", 1, 2).isin(*countries) & ~F.col("state").isin(*not_states) & ~F.substring("station_id", 3, 1).isin(*not_networks))
    return x.select(F.concat(F.lit("GHCND_"), "station_id").alias("station_id"), "station_name", "state", number("lon").alias("lon"), number("lat").alias("lat"), number("elev").alias("elev"), (F.col("hcn") == "HCN").alias("hcn"))


def ghcn_daily(spark: SparkSession, path: str) -> DataFrame:
    """station_id, obs_date, tmin, tmax, prcp and their flags from lines of a station,
    month and element with 31 groups of 8 characters; dates that are none go."""
    x = spark.read.text(path).select("value", *fixed("value", station_id=(0, 11), year=(11, 15), month=(15, 17), element=(17, 21))).where(F.col("element").isin("TMIN", "TMAX", "PRCP"))
    day = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.struct((k + 1).alias("day"), F.trim(F.substring(F.col("value"), k * 8 + 22, F.lit(5))).alias("v"), F.trim(F.substring(F.col("value"), k * 8 + 28, F.lit(1))).alias("q")))
    x = x.select("station_id", "year", "month", "element", F.explode(day).alias("d"))
    date = F.try_to_date(F.format_string("%s-%02d-%02d", "year", F.col("month").cast("int"), F.col("d.day")), "yyyy-MM-dd")
    x = x.select("station_id", date.alias("obs_date"), "element", archive_units(F.col("element"), number(F.col("d.v"))).alias("v"), F.col("d.q").alias("q")).where("obs_date is not null")
    out = x.groupBy("station_id", "obs_date").agg(*[F.max(F.when(F.col("element") == e.upper(), F.col("v"))).alias(e) for e in ("tmin", "tmax", "prcp")], *[F.coalesce(F.max(F.when(F.col("element") == e.upper(), F.col("q"))), F.lit("")).alias(f"qflag_{e}") for e in ("tmin", "tmax", "prcp")])
    return out.withColumn("station_id", F.concat(F.lit("GHCND_"), "station_id"))


def snotel_daily(spark: SparkSession, path: str, station_id: str) -> DataFrame:
    """Yearly files of a station: two lines, a header, dates a day late, -99.9 missing.
    A header that names an element twice is an error."""
    lines = spark.read.text(path).withColumn("_f", F.col("_metadata.file_path"))
    header = lines.where(F.col("value").contains("TMAX.D-1")).groupBy("_f").agg(F.max("value").alias("h"))
    x = lines.join(header, "_f").where(F.col("value").rlike(r"^[^,]*,\d{4}-\d{2}-\d{2},"))
    cells, heads = F.split("value", ","), F.split("h", ",")

    def of(name):
        n = F.size(F.filter(heads, lambda c: c == name))
        v = number(F.trim(F.get(cells, F.array_position(heads, F.lit(name)).cast("int") - 1)))
        return F.when(n > 1, F.raise_error(F.lit(f"{name} twice")).cast("double")).when((n == 1) & (v != -99.9), v)

    return x.select(F.lit(station_id).alias("station_id"), F.date_sub(F.try_to_date(F.get(cells, F.lit(1)), "yyyy-MM-dd"), 1).alias("obs_date"), of("TMIN.D-1 (degC) ").alias("tmin"), of("TMAX.D-1 (degC) ").alias("tmax"))


def snotel_inventory(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.option("header", True).csv(path)
    x = x.select(*[F.upper(F.trim(F.col(f"`{c}`"))).alias(c.strip()) for c in x.columns])
    return x.withColumn("elev", feet_to_m(number("elev")))


def raws_daily(spark: SparkSession, path: str, station_id: str) -> DataFrame:
    """Lines that begin with a date up to the footer: columns 9, 10 and 14 are the
    maximum, the minimum and mm of rain."""
    p = F.split(F.trim("value"), r"\s+")
    x = spark.read.text(path).where(F.trim("value").rlike(r"^\d{1,2}/\d{1,2}/\d{4}\s"))
    v = lambda i: F.when(number(F.get(p, F.lit(i))) > -9999, number(F.get(p, F.lit(i))))
    return x.select(F.lit(station_id).alias("station_id"), F.try_to_date(F.get(p, F.lit(0)), "M/d/yyyy").alias("obs_date"), v(10).alias("tmin"), v(9).alias("tmax"), (v(14) * F.lit(0.1)).alias("prcp"))


def raws_stations(spark: SparkSession, path: str) -> DataFrame:
    """id, start, end, lat, lon (positive west), elevation, name."""
    p = F.split(F.trim("value"), r"\s+", 7)
    x = spark.read.text(path).select(*[F.get(p, F.lit(i)).alias(c) for i, c in enumerate(("id", "start", "end", "lat", "lon", "elev", "name"))])
    return x.select(F.concat(F.lit("RAWS_"), "id").alias("station_id"), F.col("name").alias("station_name"), (-number("lon")).alias("lon"), number("lat").alias("lat"), number("elev").alias("elev"))


def raws_in_ghcn(raws: DataFrame, ghcn: DataFrame) -> DataFrame:
    """RAWS ids whose last four characters are those of a USR station."""
    usr = ghcn.where(F.substring_index("station_id", "_", -1).startswith("USR")).select(F.right("station_id", F.lit(4)).alias("_k")).distinct()
    return raws.join(usr, F.right(raws["station_id"], F.lit(4)) == F.col("_k"), "left_semi")


def ushcn_stations(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.text(path).select(*fixed("value", station_id=(0, 11), lat=(12, 20), lon=(21, 30), elev=(31, 37), state=(38, 40), station_name=(41, 71)))
    return x.select("station_id", "station_name", "state", number("lon").alias("lon"), number("lat").alias("lat"), number("elev").alias("elev"))


def ushcn_monthly(spark: SparkSession, path: str, year_at: int = 12, first: int = 17) -> DataFrame:
    """station_id, year, month, value from lines of a year with a 5-character value in
    hundredths every 9 places; also the format of the homogenised monthly files."""
    x = spark.read.text(path).select("value", *fixed("value", station_id=(0, 11), year=(year_at, year_at + 4)))
    m = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.struct((k + 1).alias("month"), F.trim(F.substring(F.col("value"), k * 9 + first + 1 - 1, F.lit(6))).alias("v")))
    x = x.select("station_id", number("year", "int").alias("year"), F.explode(m).alias("m"))
    v = number(F.col("m.v"))
    return x.select("station_id", "year", F.col("m.month").alias("month"), F.when(v != -9999, v / 100).alias("value"))


def tobs(spark: SparkSession, path: str) -> DataFrame:
    """station_id, obs_date, tobs (HHMM as a short, -1 is missing)."""
    x = spark.read.text(path).select(*fixed("value", station_id=(0, 11), ymd=(12, 20)), number(F.trim(F.right("value", F.lit(5))), "short").alias("tobs"))
    return x.select("station_id", F.try_to_date("ymd", "yyyyMMdd").alias("obs_date"), F.when(F.col("tobs") != -1, F.col("tobs")).alias("tobs"))


def tobs_lines(spark: SparkSession, path: str, element: str, countries: tuple[str, ...] = ("US", "CA", "MX")) -> DataFrame:
    """From files by year (id, date, element, value, m, q, s flags, HHMM) the times of
    observation of an element: lines that end in a digit other than by 2400."""
    x = spark.read.text(path).where(F.col("value").rlike(rf"^({'|'.join(countries)})[^,]*,[^,]*,{element},") & F.col("value").rlike(r"\d$") & ~F.col("value").rlike("2400$"))
    p = F.split("value", ",")
    return x.select(F.get(p, F.lit(0)).alias("station_id"), F.try_to_date(F.get(p, F.lit(1)), "yyyyMMdd").alias("obs_date"), number(F.element_at(p, -1), "short").alias("tobs"))


def pha_log(spark: SparkSession, path: str) -> DataFrame:
    """Adjustments: station_id, ymd_start, ymd_end (last day of its month), adj."""
    x = spark.read.text(path).select(*fixed("value", station_id=(10, 21), a=(25, 31), b=(45, 51), adj=(75, 81))).where("length(a) = 6 and length(b) = 6")
    end = F.date_format(F.last_day(F.try_to_date(F.concat("b", F.lit("01")), "yyyyMMdd")), "yyyyMMdd")
    return x.select("station_id", (number("a", "int") * 100 + 1).alias("ymd_start"), end.cast("int").alias("ymd_end"), number("adj").alias("adj")).where("adj is not null")


def sensor_history(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.option("header", True).csv(path)
    return x.select(F.concat(F.lit("NRCS_"), "station_id").alias("station_id"), F.try_to_date("date_new_sensor", "yyyy-MM-dd").alias("date_new_sensor"))


def id_list(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.text(list(paths)).select(F.trim("value").alias("station_id")).where("station_id <> ''").distinct()


def parameters(spark: SparkSession, path: str) -> DataFrame:
    """key and value of lines key=value; # begins a comment."""
    x = spark.read.text(path).select(F.trim(F.substring_index("value", "#", 1)).alias("v")).where(F.col("v").contains("="))
    return x.select(F.trim(F.substring_index("v", "=", 1)).alias("key"), F.trim(F.expr("substring(v, locate('=', v) + 1)")).alias("value"))


def union_files(spark: SparkSession, paths: list[str], read: Callable[[str], DataFrame], change: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """One frame of several sources, each changed first."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [change(read(p)) for p in paths])


def reanalysis(df: DataFrame, levels: list[int] | None, utc_hour: int, convert: Callable[[Column], Column] = lambda c: c, box: tuple[float, float, float, float] = (-135.0, -55.0, 10.0, 60.0), years: tuple[int, int] | None = None) -> DataFrame:
    """obs_date, lat, lon, level, value of (ts, lat, lon, level, value) in the box at an
    hour; 24 is hour 0 of the next day, dated back."""
    x = df.withColumn("lon", F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon"))).where(F.col("lon").between(box[0], box[1]) & F.col("lat").between(box[2], box[3]) & (F.hour("ts") == utc_hour % 24))
    x = x.where(F.col("level").isin(levels)) if levels else x
    date = F.date_sub(F.to_date("ts"), 1) if utc_hour == 24 else F.to_date("ts")
    x = x.select(date.alias("obs_date"), "lat", "lon", *([F.col("level")] if "level" in df.columns else []), convert(F.col("value")).alias("value"))
    return x.where(F.year("obs_date").between(*years)) if years else x


def thickness(df: DataFrame, upper: int, lower: int, utc_hour: int) -> DataFrame:
    """Upper less lower level by day and cell, in one grouping."""
    x = reanalysis(df, [upper, lower], utc_hour)
    at = lambda l: F.max(F.when(F.col("level") == l, F.col("value")))  # noqa: E731, E741
    return x.groupBy("obs_date", "lat", "lon").agg((at(upper) - at(lower)).alias("value"))


def nearest_cells(points: DataFrame, cells: DataFrame, k: int = 4) -> DataFrame:
    """point_id, cell_id, rank of the k nearest cells (cell_id, lon, lat)."""
    from isohyet.operators.spatial import nearest

    return nearest(points, cells.withColumnRenamed("cell_id", "station_id"), k, strict=False).select("point_id", F.col("station_id").alias("cell_id"), "rank")


def write_station_list(stations: DataFrame, path: str) -> None:
    """code, latitude, longitude as fixed columns."""
    stations.select(F.format_string("%11s %8.4f %9.4f", station_code(F.col("station_id")), "lat", "lon").alias("value")).sort("value").write.mode("overwrite").text(path)


def write_location_failures(failures: DataFrame, path: str) -> None:
    """CSV with a header for checking by hand; commas in names become blanks."""
    columns = ("station_id", "station_name", "longitude", "latitude", "elevation", "elevation_dem", "elevation_dif", "longitude_qa", "latitude_qa", "elevation_qa")
    failures.withColumn("station_name", F.replace("station_name", F.lit(","), F.lit(" "))).select(*columns).sort("station_id").write.mode("overwrite").option("header", True).csv(path)


def write_monthly(monthly: DataFrame, path: str) -> None:
    """A line a station and year: hundredths in 12 columns of 9, -9999 missing."""
    code = station_code(F.col("station_id"))
    v = lambda m: F.coalesce(F.max(F.when(F.col("month") == m, F.bround(F.col("mean") * 100, 0).cast("int"))), F.lit(-9999))
    x = monthly.groupBy(code.alias("code"), "year").agg(*[v(m).alias(f"m{m}") for m in range(1, 13)])
    x.select(F.format_string("%11s %4d" + "%6d   " * 12, "code", "year", *[f"m{m}" for m in range(1, 13)]).alias("value")).repartition("value").sortWithinPartitions("value").write.mode("overwrite").text(path)


def load_stations(*frames: DataFrame) -> DataFrame:
    """Union of networks in order of id."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).orderBy("station_id")


def write_observations(obs: DataFrame, path: str) -> None:
    """Parquet dealt by station, sorted by station and day, so that filters on either
    skip row groups."""
    obs.repartition("station_id").sortWithinPartitions("station_id", "obs_date").write.mode("overwrite").parquet(path)


def read_observations(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, ids: DataFrame | None = None, elem: str | None = None, unflagged: bool = True, months: tuple[int, ...] | None = None) -> DataFrame:
    """Observations of a period, of some stations and calendar months; flagged ones are
    null unless asked for. Bounds and columns reach the scan."""
    x = spark.read.parquet(path)
    x = x if first is None else x.where(F.col("obs_date") >= F.lit(first).cast("date"))
    x = x if last is None else x.where(F.col("obs_date") <= F.lit(last).cast("date"))
    x = x if months is None else x.where(F.month("obs_date").isin(*months))
    x = x if ids is None else x.join(ids.select("station_id"), "station_id", "left_semi")
    elems = [elem] if elem else [c for c in ("tmin", "tmax", "prcp") if c in x.columns]
    value = lambda e: (F.when(F.coalesce(f"qflag_{e}", F.lit("")) == "", F.col(e)) if unflagged and f"qflag_{e}" in x.columns else F.col(e)).alias(e)
    return x.select("station_id", "obs_date", *[value(e) for e in elems])


def write_monthly_means(monthly: DataFrame, path: str) -> None:
    """Monthly values (station_id, elem, year, month, value) dealt by station and sorted,
    so that filters on stations and years skip row groups."""
    monthly.repartition("station_id").sortWithinPartitions("station_id", "elem", "year", "month").write.mode("overwrite").parquet(path)


def read_monthly(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, ids: DataFrame | None = None, elem: str | None = None) -> DataFrame:
    """Monthly values of a range of years, of some stations, of one element. Bounds and
    the element reach the scan."""
    x = spark.read.parquet(path)
    x = x if first is None else x.where(F.col("year") >= first)
    x = x if last is None else x.where(F.col("year") <= last)
    x = x if elem is None else x.where(F.col("elem") == elem)
    return x if ids is None else x.join(ids.select("station_id"), "station_id", "left_semi")


def monthly_series(monthly: DataFrame) -> DataFrame:
    """station_id, elem, year, values: twelve a year, null where there is none."""
    v = F.array(*[F.max(F.when(F.col("month") == m, F.col("value"))) for m in range(1, 13)])
    return monthly.groupBy("station_id", "elem", "year").agg(v.alias("values"))


def add_column(df: DataFrame, name: str, kind: str, fill=None) -> DataFrame:
    return df.withColumn(name, F.lit(fill).cast(kind))
