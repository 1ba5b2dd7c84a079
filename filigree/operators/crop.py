"""The rectangle around a device's chamber without its necks and flares, from the pixels of a plane mask."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.functions import geometry
from filigree.operators import runs
from filigree.sources.scratch import stored

IMAGE = "image_id"


def without_necks(mask: DataFrame, solid: DataFrame | None = None, bin_size: int = 4, window: int = 5, percentile: float = 0.5, low: float = 0.82, least: float = 0.25) -> DataFrame:
    """(image_id, corners, angle, y, x): four corners (x, y) in the order of the axes, the mask's direction, and its centroid.

    mask: (image_id, y, x), each pixel once; solid: the same with holes filled (tiles.filled of a plane), which gives the
    direction; without it the mask does. Across the longer extent pixels fall into bins, whose widths are smoothed over
    `window` bins; the longest run of neighbouring bins that are at least `low` of the given percentile wide is the
    chamber, and its pixels give the extent across. A run of less than `least` of all bins gives the whole mask. An empty
    bin ends a run, but not the smoothing. Only sums, extremes and bins are shuffled. An image without pixels has no row.
    """
    turn = (mask if solid is None else solid).groupBy(IMAGE).agg(geometry.principal_angle("x", "y").alias("angle"))
    middle = mask.groupBy(IMAGE).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")).join(turn, IMAGE)
    u, v = geometry.rotated(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), F.col("angle"))
    placed = mask.join(middle, IMAGE).select(IMAGE, u.alias("u"), v.alias("v"))
    ends = placed.groupBy(IMAGE).agg(*(f(c).alias(f"{c}_{n}") for c in "uv" for f, n in ((F.min, "min"), (F.max, "max"))))
    ends = middle.join(ends, IMAGE).withColumn("upright", F.col("v_max") - F.col("v_min") >= F.col("u_max") - F.col("u_min"))
    along = stored(placed.join(ends.select(IMAGE, "upright"), IMAGE).select(IMAGE, F.when(F.col("upright"), F.col("v")).otherwise(F.col("u")).alias("long"), F.when(F.col("upright"), F.col("u")).otherwise(F.col("v")).alias("short")), "along")
    bins = along.groupBy(IMAGE, F.floor(F.col("long") / bin_size).cast("int").alias("bin")).agg((F.max("short") - F.min("short")).alias("width"))
    bins = runs.moving_average(bins, "width", "bin", [IMAGE], window + 1 - window % 2) if window > 1 else bins.withColumn("smooth", F.col("width"))
    whole = bins.groupBy(IMAGE).agg(F.percentile("smooth", F.lit(percentile)).alias("typical"), (F.max("bin") - F.min("bin") + 1).alias("n"))
    best = runs.longest(runs.runs(bins.join(whole, IMAGE).filter(F.col("smooth") >= low * F.col("typical")), "bin"))
    band = whole.join(best, IMAGE, "left").join(ends, IMAGE).withColumn("found", F.coalesce(F.col("length") >= F.ceil(least * F.col("n")), F.lit(False)))
    side = lambda n: F.when(F.col("upright"), F.col(f"v_{n}")).otherwise(F.col(f"u_{n}"))
    band = band.withColumns({"a": F.when(F.col("found"), (F.col("first") * bin_size).cast("double")).otherwise(side("min")), "b": F.when(F.col("found"), ((F.col("last") + 1) * bin_size).cast("double")).otherwise(side("max"))})
    inside = along.join(band.select(IMAGE, "a", "b"), IMAGE).filter(F.col("long").between(F.col("a"), F.col("b")))
    band = band.join(inside.groupBy(IMAGE).agg(F.min("short").alias("c"), F.max("short").alias("d")), IMAGE)
    pick = lambda n, m: (F.when(F.col("upright"), F.col(m)).otherwise(F.col(n)), F.when(F.col("upright"), F.col(n)).otherwise(F.col(m)))  # noqa: E731, (u, v)
    (u0, v0), (u1, v1) = pick("a", "c"), pick("b", "d")
    cos, sin = F.cos("angle"), F.sin("angle")
    corners = F.array(*(F.struct((F.col("cx") + cos * p - sin * q).alias("x"), (F.col("cy") + sin * p + cos * q).alias("y")) for p, q in ((u0, v0), (u1, v0), (u1, v1), (u0, v1))))
    return band.select(IMAGE, corners.alias("corners"), "angle", F.col("cy").alias("y"), F.col("cx").alias("x"))
