"""Python workers of the session."""

from __future__ import annotations

import ctypes
import functools
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it.

    Enough where executors see the driver's files; elsewhere install the package or pass it with --py-files.
    """
    own = spark.sparkContext.environment
    parts = [x for x in own.get("PYTHONPATH", "").split(os.pathsep) if x]
    if ROOT not in parts:
        own["PYTHONPATH"] = os.pathsep.join([*parts, ROOT])


def trim() -> None:
    """Gives memory that a task has freed back to the system: workers wait for further tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    @functools.wraps(function)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from function(batches)
        finally:
            trim()

    return run
