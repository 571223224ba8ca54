"""Streams: daily ranges and flags of arriving observations (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_range(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """station_id, obs_date, tmin, tmax, n of (station_id, ts, value), a day at a time;
    rows later than the delay are dropped and a day comes out when it is over by it."""
    x = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    out = x.groupBy("station_id", F.window("ts", "1 day").alias("w")).agg(F.min("value").alias("tmin"), F.max("value").alias("tmax"), F.count(F.lit(1)).alias("n"))
    return out.select("station_id", F.to_date("w.start").alias("obs_date"), "tmin", "tmax", "n")


def out_of_range(stream: DataFrame, low: float = -89.4, high: float = 57.7) -> DataFrame:
    """Arriving values that no station can have measured; stateless."""
    return stream.where((F.col("value") < low) | (F.col("value") > high))
