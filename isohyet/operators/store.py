"""Series of stations in a written store, replaced station by station.

A store is dealt to folders by a hash of the station. An upsert reads and replaces only
the folders of the stations it brings; the files of all others stay as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.tables import table

BUCKETS = 64


def bucket(key: str = "station_id", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, order: tuple[str, ...]) -> None:
    """Each folder by one task, sorted, so a station's rows lie together."""
    df.repartition("n_buckets", "bucket").sortWithinPartitions("n_buckets", "bucket", *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("n_buckets", "bucket").parquet(path)


def write_store(series: DataFrame, path: str, key: str = "station_id", order: tuple[str, ...] = ("station_id", "obs_date"), buckets: int = BUCKETS) -> None:
    """Write series (key and any columns) as a store; a folder holds about a buckets-th
    of the stations."""
    _write(series.withColumns({"n_buckets": F.lit(buckets), "bucket": bucket(key, buckets)}), path, order)


def read_store(spark: SparkSession, path: str, ids: list | None = None, key: str = "station_id") -> DataFrame:
    """The series; of some stations only their folders are read."""
    rows = spark.read.parquet(path)
    if ids is None:
        return rows.drop("n_buckets", "bucket")
    n = _buckets(rows)
    wanted = spark.createDataFrame([(i,) for i in ids], f"{key} {rows.schema[key].dataType.simpleString()}")
    folders = sorted({r[0] for r in wanted.select(bucket(key, n)).collect()})
    return rows.where(F.col("bucket").isin(folders)).join(wanted, key, "left_semi").drop("n_buckets", "bucket")


def _buckets(rows: DataFrame) -> int:
    """Into how many folders the store was dealt, as their parent says."""
    found = [r[0] for r in rows.select("n_buckets").distinct().collect()]
    if len(found) != 1:
        raise ValueError(f"a store is dealt in one way, this one in {len(found)}")
    return found[0]


def upsert_store(new: DataFrame, path: str, key: str = "station_id", order: tuple[str, ...] = ("station_id", "obs_date")) -> list[int]:
    """Replace the series of the stations in new, add those that are not there, and say
    which folders were written. All rows of a station come from new.

    What the folders are to hold is written to the shared folder first and then put in
    their place, so a task that is run again finds the same input, and the same upsert
    twice leaves the same rows."""
    spark = new.sparkSession
    old = spark.read.parquet(path)
    n = _buckets(old)
    columns = [c for c in old.columns if c not in ("n_buckets", "bucket")]
    put = table(new.select(columns).withColumn("bucket", bucket(key, n)), "upsert")
    folders = sorted(r[0] for r in put.select("bucket").distinct().collect())  # at most n
    if not folders:
        return []
    kept = old.where(F.col("bucket").isin(folders)).join(put.select(key).distinct(), key, "left_anti").select(*columns, "bucket")
    whole = table(kept.unionByName(put), "merged")
    _write(whole.withColumn("n_buckets", F.lit(n)), path, order)
    return folders
