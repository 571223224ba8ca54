"""Station and observation tables made from the driver's tables by arithmetic on
their keys, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STN = "stn AS (SELECT s_suppkey AS station_id, CAST(-124 AS DOUBLE) + CAST((s_suppkey*37)%1000 AS DOUBLE)*CAST(0.057 AS DOUBLE) AS lon, CAST(25 AS DOUBLE) + CAST((s_suppkey*61)%1000 AS DOUBLE)*CAST(0.024 AS DOUBLE) AS lat, s_acctbal AS elev, CAST(s_nationkey AS INT) AS climdiv FROM supplier)"
OBS = "obs AS (SELECT l_suppkey AS station_id, CAST(l_shipdate AS DATE) AS obs_date, min(l_quantity)-25 AS tmin, max(l_quantity)-25 AS tmax, min(l_quantity)-25 AS value FROM lineitem GROUP BY 1,2)"
NAT = "nat AS (SELECT CAST(s_nationkey AS BIGINT) AS station_id, CAST(l_shipdate AS DATE) AS obs_date, min(l_quantity)-25 AS tmin, max(l_quantity)-25 AS tmax FROM lineitem JOIN supplier ON l_suppkey=s_suppkey GROUP BY 1,2)"
#: nat with every day of the whole period for every station
DENSE = "dense AS (SELECT c.station_id, c.obs_date, n.tmin, n.tmax FROM (SELECT s.station_id, CAST(d.d AS DATE) AS obs_date FROM (SELECT DISTINCT station_id FROM nat) s, (SELECT unnest(generate_series(CAST(min(obs_date) AS TIMESTAMP), CAST(max(obs_date) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM nat) d) c LEFT JOIN nat n ON n.station_id=c.station_id AND n.obs_date=c.obs_date)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(key.alias("station_id"), (F.lit(-124.0) + (key * 37 % 1000).cast("double") * F.lit(0.057)).alias("lon"), (F.lit(25.0) + (key * 61 % 1000).cast("double") * F.lit(0.024)).alias("lat"), F.col("s_acctbal").alias("elev"), F.col("s_nationkey").cast("int").alias("climdiv"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("station_id"), F.col("l_shipdate").cast("date").alias("obs_date"))
    return rows.agg((F.min("l_quantity") - 25).alias("tmin"), (F.max("l_quantity") - 25).alias("tmax"), (F.min("l_quantity") - 25).alias("value"))


def national(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.col("s_nationkey").cast("long").alias("station_id"), F.col("l_shipdate").cast("date").alias("obs_date")).agg((F.min("l_quantity") - 25).alias("tmin"), (F.max("l_quantity") - 25).alias("tmax"))
