"""Image jobs: discovery, names, what is done already, ledgers, failure notes, curation manifests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from filigree.functions.labels import mask_mode, output_name
from filigree.schemas import LEDGER
from filigree.sources.workers import importable


def discovered(spark: SparkSession, folder: str, forced: str | None = None, is_forced: bool = False, merged_only: bool = False) -> DataFrame:
    """(file_path, image_index, mask_mode, image_name) of the image files right in a folder, by path.

    A file listing only, endings in any case: no bytes are read. A missing folder raises.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{[lL][iI][fF],[tT][iI][fF],[tT][iI][fF][fF]}").load(folder).select("path")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    jobs = files.select(F.col("path").alias("file_path"), F.lit(0).alias("image_index"), mask_mode(name, F.lit(""), F.lit(forced).cast("string"), F.lit(is_forced)).alias("mask_mode"), name.alias("image_name"))
    return (jobs.filter(F.contains(F.lower("image_name"), F.lit("merged"))) if merged_only else jobs).orderBy("file_path")


def expanded(files: DataFrame, listing: Callable[[str], list[str]], merged_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Jobs of containers (file_path), one for each image that `listing` names, and a ledger of those it can't read.

    listing runs where the files are and may raise; the images listed before it does remain.
    """
    importable(files.sparkSession)

    def run(batches):
        for pdf in batches:
            rows = []
            for path in pdf["file_path"]:
                try:
                    for i, image in enumerate(listing(path)):
                        rows.append((path, i, image, None))
                except Exception as error:
                    rows.append((path, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["file_path", "image_index", "image_name", "message"]).astype({"image_index": "Int32"})

    both = files.select("file_path").mapInPandas(run, "file_path string, image_index int, image_name string, message string")
    jobs = both.filter("message IS NULL").withColumn("mask_mode", mask_mode("file_path", "image_name"))
    if merged_only:
        jobs = jobs.filter(F.contains(F.lower("image_name"), F.lit("merged")))
    failed = both.filter("message IS NOT NULL").select(F.col("file_path").alias("name"), F.lit("FAILED").alias("status"), "message")
    return jobs.select("file_path", "image_index", "mask_mode", "image_name"), failed


def named(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("name", output_name("file_path", "image_name", "image_index"))


def pending(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs whose output name isn't among those done."""
    return named(jobs).join(done.select("name").distinct(), "name", "left_anti")


def labelled(jobs: DataFrame) -> DataFrame:
    """Numbered labels of images, by file and position."""
    return jobs.withColumn("label", F.concat(F.col("image_index").cast("string"), F.lit(": "), "image_name"))


def run_batch(images: DataFrame, analyse: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType, key: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """analyse on each image's rows, images in parallel; an image that fails gives a ledger row and never ends the batch."""
    importable(images.sparkSession)
    names = [f.name for f in schema]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image = pdf[key].iloc[0]
        try:
            out = analyse(pdf)[names].copy()
            out["_name"], out["_message"] = image, None
            return out if len(out) else pd.DataFrame([{**dict.fromkeys(names), "_name": image, "_message": ""}])
        except Exception as error:
            return pd.DataFrame([{**dict.fromkeys(names), "_name": image, "_message": f"{type(error).__name__}: {error}"}])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    both = images.groupBy(key).applyInPandas(run, f"{ddl}, _name string, _message string")
    ledger = both.select(F.col("_name").alias("name"), F.when(F.coalesce("_message", F.lit("")) == "", "OK").otherwise("FAILED").alias("status"), F.col("_message").alias("message")).distinct()
    return both.filter("_message IS NULL").select(*names), ledger


def ledger_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def curated(jobs: DataFrame) -> DataFrame:
    return jobs.filter("status = 'curated' AND inner_corners IS NOT NULL")


@dataclass(frozen=True)
class Settings:
    """What a run needs; checked() tells what is wrong with it."""

    source: str
    output: str
    translation_model: str
    segmentation_model: str
    device_width_um: float
    skip: str | None = None
    channel: int = 0
    merged_only: bool = False

    def checked(self, spark: SparkSession) -> list[str]:
        """Messages for a missing source or model, an empty output and a width that isn't above 0; none if the run can start.

        Paths are looked up by Spark, wherever they are; a skip folder that doesn't exist counts as none.
        """

        def exists(path: str) -> bool:
            try:
                spark.read.format("binaryFile").load(path).select("path").schema  # noqa: B018, resolves the path, reads nothing
                return bool(path)
            except AnalysisException:
                return False

        tests = {
            "the source folder must exist": bool(self.source) and exists(self.source), "an output folder is needed": self.output not in ("", "."), "the device's width must be above 0": self.device_width_um > 0,
            "the translation model must exist": bool(self.translation_model) and exists(self.translation_model), "the segmentation model must exist": bool(self.segmentation_model) and exists(self.segmentation_model),
        }
        return [message for message, good in tests.items() if not good]


def finished(jobs: DataFrame, done: Callable[[DataFrame], None] | None = None) -> DataFrame | None:
    """The jobs, once all are curated or skipped, after the callback has had them; None before."""
    if not may_finish(jobs).first()["done"]:
        return None
    if done:
        done(jobs)
    return jobs


def may_finish(jobs: DataFrame) -> DataFrame:
    """One row: whether every job is curated or skipped, and how many have each status."""
    return jobs.agg(F.bool_and(F.col("status").isin("curated", "skip")).alias("done"), *(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "curated", "skip", "failed")))


def moved(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Jobs with the statuses and corners of changes (file_path, image_index, status, inner_corners) in place of theirs."""
    c = changes.withColumnsRenamed({"status": "_s", "inner_corners": "_c"})
    return jobs.join(c, ["file_path", "image_index"], "left").withColumns({"status": F.coalesce("_s", "status"), "inner_corners": F.coalesce("_c", "inner_corners")}).drop("_s", "_c")


MANIFEST = "file_path string, image_index int, image_name string, mask_mode string, status string, inner_corners array<struct<x:double,y:double>>, device_width_um double"


def read_manifest(spark: SparkSession, path: str, width: float) -> DataFrame:
    """A JSON list of curated jobs; missing keys take their defaults."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return rows.withColumns({"image_index": F.coalesce("image_index", F.lit(0)), "status": F.coalesce("status", F.lit("pending")), "device_width_um": F.coalesce("device_width_um", F.lit(float(width)))})


def write_manifest(jobs: DataFrame, path: str) -> None:
    jobs.write.mode("overwrite").json(path)


def failure_notes(failed: DataFrame, path: str) -> None:
    """(image, category, body) as Parquet, by category."""
    failed.write.mode("append").partitionBy("category").parquet(path)
