"""Image files through a decoder of the caller's: no codec of microscope files comes with the engine."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from filigree.operators.device import as_stack
from filigree.operators.volume import pack
from filigree.sources.workers import importable


def stacks(jobs: DataFrame, decode: Callable[[bytes, int], np.ndarray], channel: int = 0) -> tuple[DataFrame, DataFrame]:
    """Volumes (image_id, shape, dtype, data) of jobs (file_path, image_index), and a ledger of files that don't decode.

    Spark reads the bytes, so files may lie in any store that it reaches; `decode` runs where the bytes are.
    """
    spark = jobs.sparkSession
    importable(spark)
    paths = [r[0] for r in jobs.select("file_path").distinct().collect()]  # of one folder's listing
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    wanted = jobs.join(files, jobs["file_path"] == files["path"]).select("file_path", "image_index", "content")

    def run(batches):
        for pdf in batches:
            for path, index, content in pdf.itertuples(index=False):
                name, row = f"{path}#{index}", {"image_id": None, "shape": None, "dtype": None, "data": None, "message": None}
                try:
                    row |= pack(name, as_stack(decode(content, int(index)), channel))
                except Exception as error:
                    row |= {"image_id": name, "message": f"{type(error).__name__}: {error}"}
                yield pd.DataFrame([row])

    both = wanted.mapInPandas(run, "image_id string, shape array<int>, dtype string, data binary, message string")
    failed = both.filter("message IS NOT NULL").selectExpr("image_id AS name", "'FAILED' AS status", "message")
    return both.filter("message IS NULL").drop("message"), failed
