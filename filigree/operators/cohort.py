"""Cohort tables: reshaping, standardisation, rank tests, densities, comparison of runs."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType

from filigree.functions.labels import significance
from filigree.functions.stats import safe_divide
from filigree.sources.workers import importable


def union_all(tables: list[DataFrame]) -> DataFrame:
    """By name; columns that a table lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without columns that are all NULL, then without rows that have a NULL in the rest. One small aggregate is read."""
    counts = df.agg(*(F.count(c).alias(c) for c in columns)).first()
    kept = [c for c in columns if counts[c]]
    return df.drop(*(c for c in columns if not counts[c])).dropna("any", subset=kept or None)


#: Columns of a cohort table that aren't features.
NOT_FEATURES = ("experiment", "image_name", "source_file", "image_index", "chip_volume_um3", "convex_hull_volume_um3", "vessel_volume_um3", "source_folder")


def feature_matrix(df: DataFrame, by: str = "experiment") -> tuple[DataFrame, list[str]]:
    """Rows with all features, and their names: without ids and sizes, columns that are all NULL, and rows that lack a feature."""
    own = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in NOT_FEATURES and f.name != by]
    rows = complete(df.select(*(c for c in (by, "image_name") if c in df.columns), *own), own)
    return rows, [c for c in own if c in rows.columns]


def first_of(df: DataFrame, *names: str) -> str | None:
    """The first of several names that a table has as a column."""
    return next((n for n in names if n in df.columns), None)


def distinct_counts(df: DataFrame, image: str = "image_name", group: str = "experiment") -> DataFrame:
    """Images and rows of each experiment, and of all of them (experiment NULL, with `whole` true)."""
    out = df.groupBy(group, image).agg(F.count(F.lit(1)).alias("_n")).rollup(group).agg(F.count(image).alias("images"), F.sum("_n").alias("rows"), F.grouping(group).cast("boolean").alias("whole"))
    return out.select(group, "images", F.coalesce("rows", F.lit(0)).alias("rows"), "whole")


def long(df: DataFrame, ids: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def wide(df: DataFrame, ids: list[str], name: str, value: str, columns: list[str]) -> DataFrame:
    """With a fixed list of columns, so that the plan needs no look at the data."""
    return df.groupBy(*ids).pivot(name, columns).agg(F.first(value))


def standardised(values: DataFrame, name: str = "feature", value: str = "value") -> DataFrame:
    """Z-scores by feature (population deviation); 0 where all values are equal. Moments join back, so no feature's rows
    need to meet in one task."""
    m = values.groupBy(name).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = F.coalesce(safe_divide(F.col(value) - F.col("_m"), F.col("_s")), F.lit(0.0))
    return values.join(m, name).withColumn("z", F.when(F.col(value).isNotNull(), z)).drop("_m", "_s")


def deviations(values: DataFrame, group: str, name: str = "feature", value: str = "value") -> DataFrame:
    """For each feature the group whose mean deviates most from the overall mean, the least name on ties."""
    sums = values.groupBy(name, group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    whole = sums.groupBy(name).agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    means = sums.join(whole, name).select(name, group, F.abs(F.col("s") / F.col("n") - F.col("all_s") / F.col("all_n")).alias("deviation"))
    return means.groupBy(name).agg(F.min_by(group, F.struct(-F.col("deviation"), F.col(group))).alias(group), F.max("deviation").alias("deviation"))


def ranks(values: DataFrame, name: str = "feature", value: str = "value") -> DataFrame:
    """Ranks within each feature, ties averaged. Equal values count first: a window runs over distinct values only."""
    distinct = values.groupBy(name, value).agg(F.count(F.lit(1)).alias("_t"))
    w = Window.partitionBy(name).orderBy(value)
    before = F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, -1))
    ranked = distinct.select(name, value, F.col("_t").alias("ties"), (F.coalesce(before, F.lit(0)) + (F.col("_t") + 1) / 2).alias("rank"))
    return values.join(ranked, [name, value])


def _tie_terms(ranked: DataFrame, name: str) -> list:
    return [F.sum(F.col("ties").cast("double") * F.col("ties") - 1).alias("_ties")]


def mann_whitney(values: DataFrame, group: str, a, b, name: str = "feature", value: str = "value") -> DataFrame:
    """U of group a against b for each feature, and the two-sided p by the normal law with tie and continuity correction."""
    importable(values.sparkSession)
    two = values.filter(F.col(group).isin(a, b) & F.col(value).isNotNull()).select(name, group, value)
    s = ranks(two, name, value).groupBy(name).agg(
        F.count_if(F.col(group) == a).alias("n1"), F.count_if(F.col(group) == b).alias("n2"),
        F.sum(F.when(F.col(group) == a, F.col("rank"))).alias("_r"), *_tie_terms(two, name),
    )
    u = F.col("_r") - F.col("n1") * (F.col("n1") + 1) / 2
    n, product = F.col("n1") + F.col("n2"), F.col("n1") * F.col("n2")
    sd = F.sqrt(product / 12.0 * ((n + 1) - safe_divide("_ties", n * (n - 1))))
    z = safe_divide(F.greatest(F.abs(F.col("u") - product / 2) - 0.5, F.lit(0.0)), sd)
    return s.withColumn("u", u).withColumn("p", erfc(z / math.sqrt(2))).select(name, "n1", "n2", "u", "p")


@F.pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    """The complementary error function; on one value for each feature only."""
    return x.map(lambda v: None if v is None or np.isnan(v) else math.erfc(v))


def _upper_gamma(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b or tiny)
        c = b + k / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


@F.pandas_udf(DoubleType())
def chi_square_tail(x: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or np.isnan(v) else _upper_gamma(k / 2, v / 2) for v, k in zip(x, freedom, strict=True)], dtype=float)


def kruskal(values: DataFrame, group: str, name: str = "feature", value: str = "value") -> DataFrame:
    """H with tie correction for each feature, and its p by chi-square."""
    importable(values.sparkSession)
    known = values.filter(F.col(value).isNotNull()).select(name, group, value)
    sums = ranks(known, name, value).groupBy(name, group).agg(F.sum("rank").alias("_r"), F.count(F.lit(1)).alias("_n"), *_tie_terms(known, name))
    s = sums.groupBy(name).agg(F.sum(F.col("_r") * F.col("_r") / F.col("_n")).alias("_q"), F.sum("_n").alias("n"), F.sum("_ties").alias("_ties"), F.count(F.lit(1)).alias("groups"))
    n = F.col("n").cast("double")
    h = 12 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1)
    corrected = safe_divide(h, 1 - safe_divide("_ties", n * n * n - n))
    return s.withColumn("h", corrected).withColumn("p", chi_square_tail("h", (F.col("groups") - 1).cast("double"))).select(name, "n", "groups", "h", "p")


def density(rows: DataFrame, value: str, weight: str, image: str, group: str, grid: int = 500, low: float = 0.0, high: float = 90.0, factor: float = 0.3) -> DataFrame:
    """Mean over a group's images of weighted Gaussian densities on a grid, each normalised to a sum of 1.

    Weights are normalised by image; the bandwidth is factor times the weighted deviation, with Bessel's correction for
    weights. Images with fewer than two rows, or without weight, don't count.
    """
    known = rows.filter(F.col(value).isNotNull() & (F.col(weight) > 0)).select(image, group, F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w"))
    m = known.groupBy(image, group).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("v")).alias("moment"), F.sum(F.col("w") * F.col("w")).alias("squares")).filter("n >= 2")
    centred = known.join(m, [image, group]).withColumn("mean", F.col("moment") / F.col("weight"))
    var = centred.groupBy(image, group).agg((F.sum(F.col("w") / F.col("weight") * (F.col("v") - F.col("mean")) ** 2)).alias("s"), F.first("squares").alias("squares"), F.first("weight").alias("weight"))
    band = var.select(image, group, F.sqrt(safe_divide("s", 1 - F.col("squares") / (F.col("weight") * F.col("weight")))).alias("h")).filter("h > 0").withColumn("h", F.col("h") * factor)
    step = (high - low) / (grid - 1)
    points = centred.join(band, [image, group]).select(image, group, "v", (F.col("w") / F.col("weight")).alias("w"), "h", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"))
    bump = F.col("w") * F.exp(-0.5 * ((low + F.col("i") * step - F.col("v")) / F.col("h")) ** 2)
    curves = points.groupBy(image, group, "i").agg(F.sum(bump).alias("d"))
    total = curves.groupBy(image, group).agg(F.sum("d").alias("whole"))
    return curves.join(total, [image, group]).groupBy(group, "i").agg(F.avg(safe_divide("d", "whole")).alias("density"))


def compared(a: DataFrame, b: DataFrame, ids: list[str], columns: list[str], rtol: float = 1e-4, atol: float = 1e-6) -> DataFrame:
    """(ids, metric, a, b, ok): |a - b| <= atol + rtol * max(|a|, |b|, 1e-12), or both absent. Columns that b lacks have ok NULL."""
    shared = [c for c in columns if c in b.columns]
    left = long(a.select(*ids, *(F.col(c).cast("double").alias(c) for c in columns)), ids, columns, "metric", "a")
    right = long(b.select(*ids, *(F.col(c).cast("double").alias(c) for c in shared)), ids, shared, "metric", "b")
    x, y = F.col("a"), F.col("b")
    close = F.abs(x - y) <= atol + rtol * F.greatest(F.abs(x), F.abs(y), F.lit(1e-12))
    out = left.join(right, [*ids, "metric"], "left")
    return out.withColumn("ok", F.when(F.col("metric").isin(*shared), (x.isNull() & y.isNull()) | F.coalesce(close, F.lit(False))))


def pca(df: DataFrame, ids: list[str], columns: list[str], k: int = 2) -> tuple[DataFrame, list[list[float]], list[float]]:
    """Scores of standardised columns, loadings and explained shares. The sign makes each component's largest loading positive.

    The covariance matrix (columns x columns, whatever the rows) comes from one aggregate; the rest is a projection.
    """
    moments = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)),
                     *(F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns[: i + 1]))).first()
    n = len(columns)
    s = [moments[f"s{i}"] or 0.0 for i in range(n)]
    matrix = np.zeros((n, n))
    for i in range(n):
        for j in range(i + 1):
            matrix[i, j] = matrix[j, i] = moments[f"c{i}_{j}"] / (s[i] * s[j]) if s[i] and s[j] else 0.0
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[:k]
    loadings = vectors[:, order] * np.where(vectors[np.abs(vectors[:, order]).argmax(axis=0), order] < 0, -1, 1)
    z = [(F.col(c) - moments[f"m{i}"]) / s[i] if s[i] else F.lit(0.0) for i, c in enumerate(columns)]
    scores = df.select(*ids, *(sum((z[i] * float(loadings[i, j]) for i in range(n)), F.lit(0.0)).alias(f"pc{j + 1}") for j in range(len(order))))
    return scores, loadings.T.tolist(), (values[order] / max(values.sum(), 1e-300)).tolist()


def importance(loadings: list[list[float]], shares: list[float], classes: int) -> list[float]:
    """Of each column: for two classes the signed sum, for more the root of squares, of loadings weighted by shares."""
    pairs = list(zip(*loadings, strict=True))
    if classes == 2:
        return [sum(x * s for x, s in zip(p, shares, strict=True)) for p in pairs]
    return [math.sqrt(sum((x * s) ** 2 for x, s in zip(p, shares, strict=True))) for p in pairs]


def oriented(scores: DataFrame, group: str, component: str = "pc1") -> DataFrame:
    """One row (high, low): the groups with the greatest and the least mean of a component, the least name on ties."""
    m = scores.groupBy(group).agg(F.avg(component).alias("_m")).filter("_m IS NOT NULL")
    return m.agg(F.min_by(group, F.struct(-F.col("_m"), F.col(group))).alias("high"), F.min_by(group, F.struct(F.col("_m"), F.col(group))).alias("low"))


def scored(features: DataFrame, importance: str, p: str) -> DataFrame:
    """With score: the size of a feature's importance (a loading, say) times -log10 of its p."""
    return features.withColumn("score", F.abs(F.col(importance)) * significance(p))


def ranked(features: DataFrame, by: str, n: int, ascending: bool = False, name: str = "feature") -> DataFrame:
    """The first n features by a column, NULL last, with their rank from 1; equal ones (to 9 digits) by name."""
    key = F.round(by, 9)
    order = [key.asc_nulls_last() if ascending else key.desc_nulls_last(), F.col(name)]
    top = features.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # n rows


def significant(features: DataFrame, p: str = "p", below: float = 0.05, fallback: int = 5, name: str = "feature") -> DataFrame:
    """Features with p below the level, by p; if there are none, the first `fallback` by p. significant tells which it was."""
    hits = features.filter(F.col(p) < below).withColumn("significant", F.lit(True))
    some = features.agg(F.coalesce(F.bool_or(F.col(p) < below), F.lit(False)).alias("_some"))
    rest = ranked(features, p, fallback, True, name).drop("rank").withColumn("_k", F.lit(1)).join(some.withColumn("_k", F.lit(1)), "_k").filter("NOT _some")
    out = hits.unionByName(rest.drop("_k", "_some").withColumn("significant", F.lit(False)))
    return out.withColumn("score", significance(p)).withColumn("rank", F.row_number().over(Window.orderBy(p, name)))  # features, not rows
