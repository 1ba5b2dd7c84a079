"""Runs of consecutive numbers, by gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IMAGE = "image_id"


def runs(df: DataFrame, at: str = "z", by: list[str] | None = None) -> DataFrame:
    """(by, first, last, length) of each run of consecutive values; a missing value ends a run."""
    by = by or [IMAGE]
    w = Window.partitionBy(*by).orderBy(at)
    return (
        df.select(*by, at).distinct().withColumn("_g", F.col(at) - F.row_number().over(w)).groupBy(*by, "_g")
        .agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("length")).drop("_g")
    )


def longest(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The longest run, the first of equally long ones."""
    by = by or [IMAGE]
    best = F.min_by(F.struct("first", "last", "length"), F.struct(-F.col("length"), F.col("first"))).alias("r")
    return found.groupBy(*by).agg(best).select(*by, "r.first", "r.last", "r.length")


def longest_votes(votes: DataFrame, more_than: int = 0) -> DataFrame:
    """The longest run of slices with more votes than that."""
    return longest(runs(votes.filter(F.col("votes") > more_than)))


def extended(run: DataFrame, slices: int | Column, low: int | Column = 0, high: int | Column = 0) -> DataFrame:
    """Runs extended to at least so many slices, downwards first, then upwards, within low to high."""
    need = F.greatest(F.lit(slices) - F.col("length") if isinstance(slices, int) else slices - F.col("length"), F.lit(0))
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    down = F.least(need, F.col("first") - low)
    up = F.least(need - down, high - F.col("last"))
    return run.select(IMAGE, (F.col("first") - down).alias("first"), (F.col("last") + up).alias("last"), (F.col("length") + down + up).alias("length"))


def to_microns(first: Column, last: Column, origin: Column, z_um: float, planes: Column | int) -> tuple[Column, Column]:
    """Start (included) and stop (excluded) on a grid of 2 micrometres of a run of slices, counted from the origin."""
    n = F.lit(planes) if isinstance(planes, int) else planes
    start = F.greatest(F.floor((first - origin) * z_um / 2), F.lit(0))
    stop = F.least(F.ceil((last - origin + 1) * z_um / 2), n)
    return start.cast("long"), stop.cast("long")


def moving_average(profile: DataFrame, value: str, at: str, by: list[str], width: int = 5) -> DataFrame:
    """Means over an odd width, the ends' values repeated beyond the ends."""
    half = width // 2
    w = Window.partitionBy(*by).orderBy(at)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    terms = [F.coalesce(F.lag(value, -k).over(w) if k > 0 else F.lag(value, -k).over(w), F.last(value).over(whole) if k > 0 else F.first(value).over(whole)) for k in range(-half, half + 1) if k]
    return profile.withColumn("smooth", (sum(terms, F.col(value).cast("double"))) / (2 * half + 1))


def wide_run(profile: DataFrame, value: str, at: str, by: list[str], share: float = 0.82, least: float = 0.25) -> DataFrame:
    """The longest run of bins at least `share` of the median wide; all bins if it spans less than `least` of them."""
    whole = profile.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("_m"), F.min(at).alias("_a"), F.max(at).alias("_b"))
    wide = profile.join(whole, by).filter(F.col(value) >= share * F.col("_m"))
    best = longest(runs(wide, at, by), by)
    joined = whole.join(best, by, "left")
    enough = F.coalesce(F.col("length") >= least * (F.col("_b") - F.col("_a") + 1), F.lit(False))
    return joined.select(*by, F.when(enough, F.col("first")).otherwise(F.col("_a")).alias("first"), F.when(enough, F.col("last")).otherwise(F.col("_b")).alias("last"))


def resampled(values: Column, n: int = 100) -> Column:
    """An array linearly resampled to n points."""
    last = F.size(values) - 1

    def at(i: Column) -> Column:
        x = i * last / (n - 1)
        a = F.floor(x).cast("int")
        b = F.least(a + 1, last)
        return F.get(values, a) + (x - a) * (F.get(values, b) - F.get(values, a))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: at(i.cast("double")))
