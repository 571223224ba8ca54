"""Tables written in the folder that the cluster shares, which cut a plan's lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where
    it is unset (local tests), a temporary one is made and used."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="isohyet-")
    return _own[app]


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back. Cuts the lineage: later
    steps survive lost executors without repeating what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/isohyet/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """df for a join that shuffles both sides. Spark takes what a Python function returns
    for as large as its input, and a file that compresses well for as small as it is, so
    it would send millions of rows whole through the driver."""
    return df.hint("merge")


_written: list[tuple[SparkSession, str]] = []


def release() -> None:
    """Delete the tables written so far and the folder made where none was set;
    results that still read them are lost."""
    while _written:
        spark, path = _written.pop()
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session has ended
            break
    for folder in _own.values():
        shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)
    _own.clear()


atexit.register(release)
