"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[object, str]] = []


def root(spark: SparkSession) -> str:
    """The shared scratch folder: spark.checkpoint.dir, or for a local master without one a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="filigree-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    _made.append((spark, f"file://{made}"))
    return f"file://{made}"


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the scratch folder; what is written there lives until release() or the end of the application."""
    path = f"{root(spark)}/filigree/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table once and reads it back: cuts lineage, survives lost executors, and is small as Parquet.

    The table lives until release() or the end of the application.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that stored() returned, once nothing lazy depends on it: rounds of a loop don't pile up."""
    path = getattr(df, "_stored_at", None)
    for spark, made in [x for x in _made if x[1] == path]:
        _made.remove((spark, made))
        _delete(spark, made)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; its folder goes with it
        pass


def release() -> None:
    """Deletes the tables written so far; results that still depend on them can't be read afterwards."""
    while _made:
        spark, path = _made.pop()
        _delete(spark, path)


atexit.register(release)

