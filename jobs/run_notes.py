"""Takes in run notes as they arrive: which images are to be processed, under which condition, and which can't be.

    python -m jobs.run_notes --documents DIR --labels DIR --out DIR --checkpoint DIR [--config FILE]

documents: a row is the note of an image (doc_id its number, source its container, lang its series, text the note), landing
as Parquet files. labels: what a curator said of some notes. Each call takes the files that have arrived since the last one,
by the stream's checkpoint, and ends when they are done. Written, as Parquet:

    out/catalogue/batch=N/status=S   name, doc_id, condition, words, lines, message of each image
    out/summary/batch=N              images and words of the batch by condition and status

status: failed (no number, no note, or too short a one: see message), skip (the curator turned it down), curated, or pending. condition:
of the first rule of the config whose keywords the note has. An image that is in an earlier batch isn't taken again; of
images of one name in one batch, the row with the least note stays. A batch that is repeated after a failure replaces its own
folders, so each image has one row whatever happens in between. Statuses are those of the labels when a note came in.
"""

from __future__ import annotations

import argparse
import json
import logging
import re
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from filigree.functions import labels as names
from filigree.sources import jobs
from filigree.streaming import landing

log = logging.getLogger("jobs.run_notes")
CONFIG = Path(__file__).with_suffix(".json")
CATALOGUE = "name string, doc_id long, condition string, words long, lines long, message string, batch long, status string"
SUMMARY = "condition string, status string, images long, words long, batch long"
WORD = r"[^\x20\x09-\x0D]+"


def ready(spark: SparkSession, out: str) -> None:
    """Both tables as empty ones, where there is none yet."""
    for name, schema, keys in (("catalogue", CATALOGUE, ["batch", "status"]), ("summary", SUMMARY, ["batch"])):
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*keys).parquet(f"{out}/{name}")


def parsed(notes: DataFrame, config: dict) -> DataFrame:
    """name, doc_id, condition, words, lines and message of each image, one row a name."""
    text = F.coalesce("text", F.lit(""))
    found = notes.select(
        F.concat(F.lit("/"), F.coalesce("source", F.lit("unnamed")), F.lit(".lif")).alias("file_path"), F.coalesce("lang", F.lit("none")).alias("image_name"), F.col("doc_id").cast("long").alias("image_index"),
        F.col("doc_id").cast("long").alias("doc_id"), names.by_keywords(text, [tuple(r) for r in config["conditions"]], config["otherwise"]).alias("condition"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.when(text != "", F.regexp_count(text, F.lit("\n")) + 1).otherwise(0).cast("long").alias("lines"), F.md5(text).alias("note"),
    )
    message = F.when(F.col("doc_id").isNull(), "no number").when(F.col("words") == 0, "no note").when(F.col("words") < config["min_words"], "short note")
    found = jobs.named(found).withColumns({"message": message, "name": F.coalesce("name", F.concat(F.lit("note_"), "note"))})
    first = F.row_number().over(Window.partitionBy("name").orderBy("words", "note"))  # rows of one image of one batch
    return found.withColumn("_first", first).filter("_first = 1").select("name", "doc_id", "condition", "words", "lines", "message")


def judged(found: DataFrame, labels: DataFrame) -> DataFrame:
    """With a status. Of several labels of a note, one that turns it down counts."""
    said = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or((F.coalesce("quality", F.lit(0)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("down"))
    status = F.when(F.col("message").isNotNull(), "failed").when(F.col("down"), "skip").when(~F.col("down"), "curated").otherwise("pending")
    return found.join(said, "doc_id", "left").withColumn("status", status).select("name", "doc_id", "condition", "words", "lines", "message", "status")


def take(batch: DataFrame, number: int, labels: str, out: str, config: dict) -> None:
    """One batch into its own folders."""
    spark, read, wrote = batch.sparkSession, Observation(), Observation()
    notes = batch.observe(read, F.count(F.lit(1)).alias("rows"))
    earlier = spark.read.schema(CATALOGUE).parquet(f"{out}/catalogue").filter(F.col("batch") != number)
    rows = judged(parsed(notes, config).join(earlier.select("name"), "name", "left_anti"), spark.read.parquet(labels))
    rows.observe(wrote, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "failed").alias("failed")).write.mode("overwrite").partitionBy("status").parquet(f"{out}/catalogue/batch={number}")
    # of what was written, so that both tables tell the same
    own = spark.read.schema(CATALOGUE).parquet(f"{out}/catalogue").filter(F.col("batch") == number)
    own.groupBy("condition", "status").agg(F.count(F.lit(1)).alias("images"), F.sum("words").alias("words")).coalesce(1).write.mode("overwrite").parquet(f"{out}/summary/batch={number}")
    log.info("batch %d: read %d notes, wrote %d images to %s/catalogue, %d of them failed", number, read.get["rows"], wrote.get["rows"], out, wrote.get["failed"])


def run(spark: SparkSession, documents: str, labels: str, out: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Takes in what is new and returns the whole catalogue, with the images of each row's condition and status in all batches."""
    config = config or json.loads(CONFIG.read_text())
    # a pattern may name a file as well as a folder, which a plain path of a stream can't
    notes = landing.arriving(spark, documents if re.search(r"[*?\[{]", documents) else re.sub(r"(.)/*$", r"[\1]", documents), spark.read.parquet(documents).schema, config["max_files_per_batch"])
    ready(spark, out)
    log.info("reading new files of %s, labels of %s", documents, labels)
    stream = notes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, number: take(batch, number, labels, out, config)).start()
    stream.awaitTermination()
    return result(spark, out)


def result(spark: SparkSession, out: str) -> DataFrame:
    totals = spark.read.schema(SUMMARY).parquet(f"{out}/summary").groupBy("condition", "status").agg(F.sum("images").alias("alike"))
    rows = spark.read.schema(CATALOGUE).parquet(f"{out}/catalogue")
    return rows.join(totals, ["condition", "status"]).select("name", "doc_id", "condition", "words", "lines", "message", "status", "alike")


def _sql(config: dict) -> str:
    tests = [" AND ".join(f"contains(lower(t), '{w}')" for w in words) + f" THEN '{label}'" for words, label in config["conditions"]]
    return (
        "WITH n AS (SELECT *, coalesce(text, '') AS t FROM documents), l AS (SELECT doc_id, bool_or(coalesce(quality, 0) = 0 OR coalesce(toxic, 0) = 1) AS down FROM labels GROUP BY 1), "
        f"p AS (SELECT coalesce(coalesce(source, 'unnamed') || '_' || coalesce(lang, 'none') || '_img' || doc_id, 'note_' || md5(t)) AS name, doc_id, CASE WHEN {' WHEN '.join(tests)} ELSE '{config['otherwise']}' END AS condition, len(regexp_extract_all(t, '{WORD}')) AS words, CASE WHEN t <> '' THEN len(t) - len(replace(t, chr(10), '')) + 1 ELSE 0 END AS lines FROM n), "
        f"m AS (SELECT *, CASE WHEN doc_id IS NULL THEN 'no number' WHEN words = 0 THEN 'no note' WHEN words < {config['min_words']} THEN 'short note' END AS message FROM p), "
        "s AS (SELECT name, m.doc_id, condition, words, lines, message, CASE WHEN message IS NOT NULL THEN 'failed' WHEN down THEN 'skip' WHEN NOT down THEN 'curated' ELSE 'pending' END AS status FROM m LEFT JOIN l ON l.doc_id = m.doc_id) "
        "SELECT *, count(*) OVER (PARTITION BY condition, status) AS alike FROM s"
    )


SQL = _sql(json.loads(CONFIG.read_text()))


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("documents", "labels", "out", "checkpoint"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config", default=str(CONFIG))
    given = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("run-notes").getOrCreate()
    try:
        run(spark, given.documents, given.labels, given.out, given.checkpoint, json.loads(Path(given.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
