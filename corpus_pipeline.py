"""A corpus pipeline: from raw documents to packed training sequences.

Each stage takes all documents that the one before kept, and all but the last return documents again: doc_id, text, lang,
source, n_chars. run() writes each stage's result to shared storage and reads it back, so a lost executor costs tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm import line_dedup, mixing, ngram_join, packing, toxicity
from filigree.llm._scratch import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of this stage's documents."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs.select(*COLUMNS), model)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in the last one only."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS)).withColumn("text", F.col("kept_text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of the n-gram join connect, one row stays: the least doc_id, null before others, then the least hash of the text."""
    docs = docs.select(*COLUMNS).withColumns({"_id": F.to_json(F.struct("doc_id")), "_hash": F.xxhash64("text")})
    # ids may be null or repeated: with the hash, each text of an id has a place of its own in its class
    found = ngram_join.classes(docs.select(F.struct("doc_id", "_hash").alias("row"), "text"), k=5, num=80, key="row")
    kept = found.filter(F.col("row") == F.col("component_id")).select(F.to_json(F.struct("row.doc_id")).alias("_id"), F.col("row._hash").alias("_hash")).distinct()
    # of repeated rows one stays: they are in one task already, after the join on the same columns
    return docs.join(kept.hint("merge"), ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"]).drop("_id", "_hash")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row for each time that a document, or a part of it, is taken."""
    out = mixing.mixed_documents(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens and their places in sequences of 4096."""
    import public_tokenizers

    return packing.best_fit(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("line dedup", shared_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", packed_sequences),
]

#: SQL can't express the classifier, the mix or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
