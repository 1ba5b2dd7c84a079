"""From traced centrelines to a cohort report: a panel of features for each image, and which of them tell experiments apart.

    python -m jobs.cohort_report --lineitem FILE --orders FILE --customer FILE --out DIR [--config FILE]

An order is a centreline of an image (its customer), its items the points and their prices the cross-sections; a customer's
segment is the experiment. Written, as Parquet:

    out/panel/experiment=E    image_id, feature and value; features are named as in the wide panel, and rounded to 6 digits,
                              so that ties between images don't depend on the order of summation
    out/report/experiment=E   feature; images, quartiles, mean and deviation of the experiment; Kruskal-Wallis H and p of the
                              feature over all experiments, whether p is below the level, and the feature's rank by p

Only images with at least min_lines centrelines count. A repeated call replaces the partitions that it writes (dynamic
overwrite), so the result is the same. Experiments that are no longer in the input keep their last panel, which the report
goes on to count. Images without an experiment are experiment NULL.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from filigree.functions.stats import box_statistics
from filigree.operators import cohort, metrics
from filigree.plans.fixtures import with_views
from filigree.schemas import EDGE_ALIASES

log = logging.getLogger("jobs.cohort_report")
CONFIG = Path(__file__).with_suffix(".json")
PANEL = "image_id string, feature string, value double, experiment string"
REPORT = "feature string, images long, q1 double, median double, q3 double, mean double, deviation double, groups long, h double, p double, significant boolean, rank int, experiment string"


def centrelines(lineitem: DataFrame, orders: DataFrame, customer: DataFrame) -> DataFrame:
    """experiment, image_id, u, v, edge_kind, pts and areas. Points meet by order before anything is joined to them."""
    point = F.struct(F.col("l_linenumber").alias("z"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_extendedprice").alias("area"))
    lines = lineitem.select(F.col("l_orderkey").alias("u"), point.alias("p")).groupBy("u").agg(F.array_sort(F.collect_list("p")).alias("p")).filter(F.size("p") >= 2)
    pts = F.transform("p", lambda q: F.struct(q["z"].alias("z"), (q["a"] % 200).cast("int").alias("y"), (q["b"] % 100).cast("int").alias("x")))
    kind = F.when(F.col("o_orderstatus") == "F", "branch").when(F.col("o_orderstatus") == "O", "attached_sprout").otherwise("floating_sprout")
    images = orders.select(F.col("o_orderkey").alias("u"), F.col("o_custkey").alias("c_custkey"), kind.alias("edge_kind")).join(customer.select("c_custkey", F.col("c_mktsegment").alias("experiment")), "c_custkey")
    return lines.join(images, "u").select("experiment", F.col("c_custkey").cast("string").alias("image_id"), "u", (F.col("u") + 1).alias("v"), "edge_kind", pts.alias("pts"), F.transform("p", lambda q: q["area"]).alias("areas"))


def panel(lines: DataFrame, features: list[str], min_lines: int) -> DataFrame:
    """experiment, image_id, feature and value of images with enough centrelines."""
    wanted = metrics.measured(features)
    edges = metrics.branch_metrics(lines).select("image_id", "edge_kind", *(EDGE_ALIASES[a] for a in wanted)).withColumnsRenamed({EDGE_ALIASES[a]: a for a in wanted})
    values = metrics.named(metrics.subset_statistics(edges, wanted, "edge_kind", "sprout_and_branch")).filter(F.col("name").isin(features) & F.col("value").isNotNull())
    images = lines.groupBy("image_id").agg(F.first("experiment").alias("experiment"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_lines)
    return values.join(images, "image_id").select("experiment", "image_id", F.col("name").alias("feature"), F.round("value", 6).alias("value"))


def report(values: DataFrame, level: float) -> DataFrame:
    """A row for each experiment and feature. Ranks, tests and quartiles each shuffle the panel once, by feature."""
    tests = cohort.kruskal(values, "experiment")
    tests = cohort.ranked(tests.select("feature", "groups", "h", "p"), "p", 1000, True).withColumn("significant", F.col("p") < level)  # one row a feature
    mean = F.sum(F.col("value").cast("decimal(28,6)")).cast("double") / F.count(F.lit(1))  # exact, in any order
    overall = values.groupBy("feature").agg(mean.alias("overall"))
    own = values.groupBy("feature", "experiment").agg(F.count(F.lit(1)).alias("images"), mean.alias("mean"), *box_statistics("value"))
    return own.join(overall, "feature").join(tests, "feature").select("experiment", "feature", "images", "q1", "median", "q3", "mean", (F.col("mean") - F.col("overall")).alias("deviation"), "groups", "h", "p", "significant", "rank")


def run(spark: SparkSession, lineitem: str, orders: str, customer: str, out: str, config: dict | None = None) -> DataFrame:
    """Writes both tables and returns the report, read back."""
    config = config or json.loads(CONFIG.read_text())
    unknown = [f for f in config["features"] if not any(f.endswith(f"_{a}") for a in EDGE_ALIASES)]
    if unknown or not config["features"]:
        raise ValueError(f"features must name a metric: {unknown}")
    wrote, told = Observation(), Observation()
    lines = centrelines(spark.read.parquet(lineitem), spark.read.parquet(orders), spark.read.parquet(customer))
    values = panel(lines, config["features"], config["min_lines"]).observe(wrote, F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("image_id").alias("images"))
    values.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment").parquet(f"{out}/panel")
    log.info("read %s, %s and %s; wrote %d values of about %d images to %s/panel", lineitem, orders, customer, wrote.get["rows"], wrote.get["images"], out)
    rows = report(spark.read.schema(PANEL).parquet(f"{out}/panel"), config["level"]).select(*(c.split()[0] for c in REPORT.split(", "))).observe(told, F.count(F.lit(1)).alias("rows"))
    rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment").parquet(f"{out}/report")
    log.info("read %s/panel; wrote %d rows to %s/report", out, told.get["rows"], out)
    return result(spark, out)


def result(spark: SparkSession, out: str) -> DataFrame:
    rows = spark.read.schema(REPORT).parquet(f"{out}/report")
    digits = {"q1": 5, "median": 5, "q3": 5, "mean": 5, "deviation": 5, "h": 4, "p": 6}
    return rows.select("experiment", "feature", "images", *(F.round(c, d).alias(c) for c, d in digits.items()), "groups", "significant", "rank")


_COLUMNS = {"length": "path_length", "tortuosity": "tortuosity", "median_cs_area": "median_cs_area", "orientation": "orientation_to_device_axis"}
_AGGREGATES = {"median": "median({})", "mean": "avg({})", "spread": "quantile_cont({0}, 0.9) - quantile_cont({0}, 0.1)"}


def _sql(config: dict) -> str:
    parts = []
    for f in config["features"]:
        agg, rest = f.split("_", 1)
        subset = "sprout_and_branch" if rest.startswith("sprout_and_branch") else "branch"
        where = "WHERE edge_kind = 'branch'" if subset == "branch" else ""
        value = _AGGREGATES[agg].format(_COLUMNS[rest.removeprefix(subset + "_")])
        parts.append(f"SELECT experiment, image_id, '{f}' AS feature, round({value}, 6) AS value FROM own {where} GROUP BY 1, 2")
    mean = "sum(value::DECIMAL(28, 6))::DOUBLE / count(*)"
    return with_views(
        "+e AS (SELECT met.image_id AS experiment, o_custkey AS image_id, met.* EXCLUDE (image_id) FROM met JOIN orders ON o_orderkey = line), "
        f"own AS (SELECT * FROM e WHERE image_id IN (SELECT image_id FROM e GROUP BY 1 HAVING count(*) >= {config['min_lines']})), "
        f"v AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE value IS NOT NULL), "
        "r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS r FROM v), "
        "s AS (SELECT feature, experiment, sum(r) AS s, count(*) AS n FROM r GROUP BY 1, 2), t AS (SELECT feature, sum(c * c * c - c) AS t FROM (SELECT feature, value, count(*)::DOUBLE AS c FROM v GROUP BY 1, 2) GROUP BY 1), "
        "g AS (SELECT feature, sum(n)::DOUBLE AS n, sum(s * s / n) AS q, count(*) AS groups FROM s GROUP BY 1), "
        "h AS (SELECT feature, groups, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n ** 3 - n)) AS h FROM g JOIN t USING (feature)), "
        # five experiments: chi-square of four degrees has a closed form
        f"p AS (SELECT *, exp(-h / 2) * (1 + h / 2) AS p FROM h), k AS (SELECT *, p < {config['level']} AS significant, row_number() OVER (ORDER BY round(p, 9), feature)::INTEGER AS rank FROM p), "
        f"o AS (SELECT feature, {mean} AS overall FROM v GROUP BY 1) "
        f"SELECT experiment, feature, count(*) AS images, round(quantile_cont(value, 0.25), 5) AS q1, round(median(value), 5) AS median, round(quantile_cont(value, 0.75), 5) AS q3, round({mean}, 5) AS mean, round({mean} - any_value(overall), 5) AS deviation, round(any_value(h), 4) AS h, round(any_value(p), 6) AS p, any_value(groups) AS groups, any_value(significant) AS significant, any_value(rank) AS rank FROM v JOIN o USING (feature) JOIN k USING (feature) GROUP BY 1, 2",
        "met",
    )


SQL = _sql(json.loads(CONFIG.read_text()))


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("lineitem", "orders", "customer", "out"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config", default=str(CONFIG))
    given = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("cohort-report").getOrCreate()
    try:
        run(spark, given.lineitem, given.orders, given.customer, given.out, json.loads(Path(given.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
