"""Aggregates and quotients that skip absent values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_divide(n: Column | str, d: Column | str) -> Column:
    """NULL where the denominator isn't above 0."""
    return F.when(col(d) > 0, F.try_divide(col(n).cast("double"), col(d).cast("double")))


def number(x: Column | str) -> Column:
    """As a double; NULL for what isn't one, and for NaN."""
    value = F.expr("1") if x is None else col(x).try_cast("double")
    return F.when(~F.isnan(value), value)


def deciles(x: Column | str) -> Column:
    """P10, P50 and P90, exact and linearly interpolated. Aggregates of one column that take them from here share one table of counts."""
    return F.percentile(number(x), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))


def safe_median(x: Column | str) -> Column:
    return deciles(x)[1]


def spread(x: Column | str) -> Column:
    """P90 less P10."""
    return deciles(x)[2] - deciles(x)[0]


def population_std(x: Column | str) -> Column:
    return F.stddev_pop(number(x))


def mean(x: Column | str) -> Column:
    return F.avg(number(x))


#: Aggregates by their names in result columns; a caller may pass others.
AGGREGATORS = {"mean": mean, "std": population_std, "median": safe_median, "spread": spread}


def box_statistics(x: Column | str) -> list[Column]:
    """Quartiles, and whiskers 1.5 interquartile ranges beyond them."""
    q = F.percentile(number(x), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), (q[0] - 1.5 * (q[2] - q[0])).alias("low"), (q[2] + 1.5 * (q[2] - q[0])).alias("high")]


def array_median(values: Column) -> Column:
    """The median of an array's non-null values."""
    s = F.sort_array(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(s)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + F.coalesce(v.cast("double"), F.lit(0.0)))


def array_mean(values: Column) -> Column:
    return F.try_divide(array_sum(values), F.size(F.filter(values, lambda v: v.isNotNull())))


def array_std(values: Column) -> Column:
    """Population standard deviation."""
    m = array_mean(values)
    return F.sqrt(F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + F.coalesce((v - m) * (v - m), F.lit(0.0))), F.size(F.filter(values, lambda v: v.isNotNull()))))
