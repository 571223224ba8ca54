"""Makes this package importable in Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, as addPyFile does:
    functions that Spark runs there refer to its modules."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # else it was itself imported from such an archive
        path = Path(tempfile.mkdtemp(prefix="isohyet-")) / "isohyet.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"isohyet/{f.relative_to(root)}")
        spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with the package shipped."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
