"""Intermediate tables, and Python over Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame

from filigree.sources.scratch import folder, release, root, stored
from filigree.sources.workers import importable, trimmed

__all__ = ["arrow_map", "folder", "release", "root", "stored"]


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow, with a package that the workers can import."""
    importable(df.sparkSession)
    return df.mapInArrow(trimmed(function), schema)
