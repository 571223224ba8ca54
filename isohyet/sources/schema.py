"""Schemas of the normalised tables, and tables made from lists of variables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

STATION = "station_id string, station_name string, state string, provider string, longitude double, latitude double, elevation double, utc_offset smallint, tdi double, climdiv int, mask boolean, bad boolean"
OBS = "station_id string, obs_date date, tmin double, tmax double, prcp double, tobs_tmax smallint, qflag_tmin string, qflag_tmax string"
CALENDAR = "obs_date date, year int, month int, day int, yday int, ymd int"
STATION_MONTH = "station_id string, elem string, month int, mean double, vari double, norm double, lst double, optim_nnghs int, optim_nnghs_anom int, vario_nug double, vario_psill double, vario_rng double"
OBS_COUNT = "station_id string, elem string, month int, cnt bigint"
INFILL = "station_id string, elem string, obs_date date, value double, infilled double, flag_infilled boolean"
SERIAL = "station_id string, elem string, obs_date date, value double, flag_infilled boolean"
PHA_ADJ = "station_id string, elem string, ymd_start int, ymd_end int, adj double"
USHCN_MONTH = "station_id string, elem string, year int, month int, value double"
REANALYSIS = "obs_date date, utc_hour int, var string, level int, lat double, lon double, value double"
CELL = "row int, col int, lat double, lon double, mask boolean, elev double, tdi double, climdiv int, lst_tmin array<double>, lst_tmax array<double>"
NEIGHBOR = "point_id string, station_id string, dist_km double, rank int, wgt double"
XVAL_MAE = "climdiv int, elem string, month int, n_nghs int, station_id string, mae double"
TILE_OUT = "tile_id string, row int, col int, obs_date date, tmin smallint, tmax smallint"
NORMAL_OUT = "row int, col int, elem string, month int, normal double, se double"
POINT = "point_id string, lon double, lat double, elev double, tdi double, climdiv int, mask boolean"
#: What a point has for each calendar month.
POINT_MONTH = "point_id string, month int, lst double, norm double"
TABLES = {"station": STATION, "obs": OBS, "calendar": CALENDAR, "station_month": STATION_MONTH, "obs_count": OBS_COUNT, "infill": INFILL, "serial": SERIAL, "pha_adj": PHA_ADJ, "ushcn_month": USHCN_MONTH, "reanalysis": REANALYSIS, "cell": CELL, "neighbor": NEIGHBOR, "xval_mae": XVAL_MAE, "tile_out": TILE_OUT, "normal_out": NORMAL_OUT, "point": POINT, "point_month": POINT_MONTH}


def schema_of(variables: list[tuple[str, str, object, str, str]]) -> StructType:
    """A schema of variables (name, type, fill value, long name, units); what is beside
    the type is kept as metadata of the column, and so in the Parquet files."""
    fields = []
    for name, kind, fill, long_name, units in variables:
        one = StructType.fromDDL(f"{name} {kind}")[0]
        fields.append(StructField(name, one.dataType, True, {k: v for k, v in (("fill", fill), ("comment", long_name), ("units", units)) if v is not None}))
    return StructType(fields)


def observations_of(stations: DataFrame, calendar: DataFrame, variables: list[tuple[str, str, object, str, str]]) -> DataFrame:
    """station_id, obs_date and the variables with their fill values, for every station
    and day: stations are dealt, the days of the calendar are few enough for each of
    them (one array)."""
    days = calendar.agg(F.array_sort(F.collect_set("obs_date")).alias("d"))
    x = stations.select("station_id").crossJoin(F.broadcast(days)).select("station_id", F.explode("d").alias("obs_date"))  # one row is broadcast
    return x.select("station_id", "obs_date", *[F.lit(f.metadata.get("fill")).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema_of(variables)])


def conform(df: DataFrame, table: str) -> DataFrame:
    """df as a table of TABLES: its columns in order and with its types, null where df has
    none; other columns go."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(TABLES[table])])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])
