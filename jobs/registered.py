"""The jobs as queries: each runs twice into one new folder of the shared scratch space, which stays, and returns what is there then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from filigree.sources.scratch import root
from jobs import cohort_report, run_notes


def _place(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_run_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark, "run-notes")
    for _ in range(2):
        out = run_notes.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", f"{at}/out", f"{at}/checkpoint")
    return out


def job2_cohort_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _place(spark, "cohort-report")
    for _ in range(2):
        out = cohort_report.run(spark, *(f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders", "customer")), f"{at}/out")
    return out


QUERIES = {"job1_run_notes": job1_run_notes, "job2_cohort_report": job2_cohort_report}
ORACLE_SQL = {"job1_run_notes": run_notes.SQL, "job2_cohort_report": cohort_report.SQL}
