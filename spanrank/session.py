"""What a session needs before Python runs on its executors, and the folder they share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of any cluster, once a context."""
    context = spark.sparkContext
    if getattr(context, "_spanrank_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    if root.is_dir():  # else the package came as a zip itself
        place = tempfile.mkdtemp(prefix="spanrank-zip-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        name = f"spanrank_{uuid.uuid4().hex[:8]}"
        context.addPyFile(shutil.make_archive(os.path.join(place, name), "zip", root, "spanrank"))
    context._spanrank_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one of
    this process where the session names none (tests on one machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        own = tempfile.mkdtemp(prefix="spanrank-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext.getCheckpointDir()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and
    a lost executor costs nothing that was finished."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
