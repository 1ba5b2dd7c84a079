"""Result tables on disk: per-image CSVs, and cohorts of them."""

from __future__ import annotations

import functools
import io
import zipfile
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.schemas import null_to_nan
from filigree.sources.workers import importable


def write_image_tables(table: DataFrame, path: str, file: Column, index: Column, key: str = "image_id") -> None:
    """CSV with a header and three leading id columns, a folder for each image; absent values become NaN."""
    ids = [F.col(key).alias("image_name"), file.alias("source_file"), index.alias("image_index")]
    out = null_to_nan(table.select(*ids, *(c for c in table.columns if c != key)))
    out.withColumn("_folder", F.col("image_name")).write.mode("overwrite").partitionBy("_folder").option("header", True).csv(path)


def family(path: Column) -> Column:
    """By words of the whole path: analysis, else branch, else uncategorised."""
    low = F.lower(path)
    return F.when(F.contains(low, F.lit("analysis")), "analysis").when(F.contains(low, F.lit("branch")), "branch").otherwise("uncategorised")


def cohort(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """All CSVs of a family below a folder, by name; with the path and folder of each row's file.

    Files may have different columns: each distinct header is read once with all files that have it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root).select("path")
    wanted = files.filter(family(F.col("path")) == kind)
    # the line at a file's first byte: files aren't read as one string, whatever their size
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(root)
    first = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), "value").filter("at = 0")
    heads = first.groupBy("path").agg(F.min_by("value", "n").alias("header")).join(wanted, "path", "left_semi")
    groups = heads.groupBy("header").agg(F.collect_set("path").alias("paths")).collect()
    out = None
    for _, paths in groups:
        part = spark.read.option("header", True).option("inferSchema", True).option("nanValue", "NaN").csv(paths)
        part = part.withColumn("source_path", F.col("_metadata.file_path")).withColumn("source_folder", F.regexp_extract("source_path", r"([^/]+)/[^/]+$", 1))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], "source_path string, source_folder string")


def write_cohort(df: DataFrame, path: str, root: str) -> None:
    """One CSV; never below the folder that it was read from, where it would be read again."""
    if path.rstrip("/").startswith(root.rstrip("/") + "/"):
        raise ValueError("write the combined table outside the folder that is combined")
    null_to_nan(df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_arrays(spark: SparkSession, path: str, pattern: str = "*.npy") -> DataFrame:
    """.npy files as volumes (path, shape, dtype, data)."""
    importable(spark)

    def run(batches):
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                rows.append({"path": name, "shape": list(a.shape), "dtype": str(a.dtype), "data": np.ascontiguousarray(a).tobytes()})
            yield pd.DataFrame(rows, columns=["path", "shape", "dtype", "data"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(run, "path string, shape array<int>, dtype string, data binary")


def read_zipped_arrays(spark: SparkSession, path: str, pattern: str = "*.npz") -> tuple[DataFrame, DataFrame]:
    """The arrays of zipped files, a row each (path, member, shape, dtype, data), and a ledger (name, status, message) of the files.

    Members are listed by the archive's directory, stored or deflated; what isn't an array of plain numbers, and a file that
    isn't an archive, is told in the ledger and never ends the read. Spark reads the bytes, wherever they are.
    """
    importable(spark)

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                row = {"path": name, "member": None, "shape": None, "dtype": None, "data": None, "message": None}
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for member in archive.namelist():
                            try:
                                a = np.load(io.BytesIO(archive.read(member)), allow_pickle=False)
                                found = {"member": member.removesuffix(".npy"), "shape": list(a.shape), "dtype": str(a.dtype), "data": np.ascontiguousarray(a).tobytes()}
                                yield pd.DataFrame([row | found])
                            except (ValueError, EOFError, zipfile.BadZipFile, zlib.error) as error:
                                yield pd.DataFrame([row | {"member": member, "message": f"{type(error).__name__}: {error}"}])
                except zipfile.BadZipFile as error:
                    yield pd.DataFrame([row | {"message": f"{type(error).__name__}: {error}"}])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")
    both = files.mapInPandas(run, "path string, member string, shape array<int>, dtype string, data binary, message string")
    ledger = both.groupBy(F.col("path").alias("name")).agg(F.concat_ws("; ", F.sort_array(F.collect_list(F.concat_ws(": ", "member", "message")))).alias("all"), F.count("message").alias("n"))
    ledger = ledger.select("name", F.when(F.col("n") > 0, "FAILED").otherwise("OK").alias("status"), F.when(F.col("n") > 0, F.array_join(F.filter(F.split("all", "; "), lambda m: F.contains(m, F.lit(": "))), "; ")).alias("message"))
    return both.filter("message IS NULL").drop("message"), ledger


#: The endings of an output folder's files, and what each holds.
KINDS = {
    "original": "_cropped_stack_aligned.npy", "translation": "_vessel_translation_aligned.npy", "segmentation": "_clean_segmentation.npy", "skeleton": "_skeleton.npy",
    "organoid_mask": "_organoid_mask.npy", "holes": "_holes.npy", "clean_graph": "_clean_graph.pkl", "branch_metrics": "_branch_metrics.csv",
}


def outputs(spark: SparkSession, folder: str) -> DataFrame:
    """(folder, kind, path): the known files of each output folder; the first by name where a folder has several of a kind."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    kind = functools.reduce(lambda a, b: a.when(F.col("path").endswith(b[1]), b[0]), list(KINDS.items())[1:], F.when(F.col("path").endswith(KINDS["original"]), "original"))
    named = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), kind.alias("kind"), "path").filter("kind IS NOT NULL")
    return named.groupBy("folder", "kind").agg(F.min("path").alias("path"))


ARTEFACTS = ("branch_metrics", "junction_metrics", "analysis_metrics", "all_morphological_params")


def artefacts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The result tables that a folder has, by suffix; what is missing is left out."""
    found = {}
    for name in ARTEFACTS:
        try:
            found[name] = spark.read.option("header", True).option("inferSchema", True).option("pathGlobFilter", f"*{name}.csv").option("recursiveFileLookup", True).csv(folder)
        except Exception as error:
            if "UNABLE_TO_INFER_SCHEMA" not in str(error) and "PATH_NOT_FOUND" not in str(error):
                raise
    return {k: v for k, v in found.items() if v.columns}
