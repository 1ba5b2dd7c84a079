"""Sparse voxel tables: one row (image_id, z, y, x) for each positive voxel, and scalar fields with a value."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.functions.stats import safe_divide

IMAGE = "image_id"


def box_scales(least_side: int, most: int = 12) -> list[int]:
    """Box sides: whole parts of 2 to evenly spaced exponents, from that of the least side down to 1."""
    top = math.floor(math.log2(least_side)) if least_side > 1 else 1
    exponents = [top + (1 - top) * i / (most - 1) for i in range(most)]
    return sorted({math.floor(2**e) for e in exponents})


def box_counts(voxels: DataFrame, scales: list[int]) -> DataFrame:
    """(image, scale, mass) for each occupied box: voxels are exploded by scale and counted map-side first."""
    scaled = voxels.select(IMAGE, F.explode(F.array(*map(F.lit, scales))).alias("scale"), "z", "y", "x")
    keys = [F.floor(F.col(c) / F.col("scale")).alias(f"b{c}") for c in "zyx"]
    return scaled.groupBy(IMAGE, "scale", *keys).agg(F.count(F.lit(1)).alias("mass")).select(IMAGE, "scale", "mass")


def fractal(voxels: DataFrame, scales: list[int]) -> DataFrame:
    """Fractal dimension (slope of ln boxes on ln 1/scale) and lacunarity (mean of var/mean^2 of masses) by image.

    Scales with fewer than two occupied boxes don't count; with fewer than two scales the dimension is NULL.
    """
    by = box_counts(voxels, scales).groupBy(IMAGE, "scale").agg(
        F.count(F.lit(1)).alias("n"), safe_divide(F.var_pop("mass"), F.avg("mass") * F.avg("mass")).alias("l")
    )
    used = by.filter("n >= 2")
    return used.groupBy(IMAGE).agg(
        F.when(F.count(F.lit(1)) >= 2, F.regr_slope(F.log(F.col("n").cast("double")), -F.log(F.col("scale").cast("double")))).alias("fractal_dimension"),
        F.avg("l").alias("lacunarity"),
    )


def slice_fill(voxels: DataFrame, rows: int, columns: int) -> DataFrame:
    return voxels.groupBy(IMAGE, "z").agg((F.count(F.lit(1)) / F.lit(rows * columns)).alias("fill"))


def trimmed_range(fill: DataFrame, most: float = 0.75) -> DataFrame:
    """First and last slice that isn't overfull: trims both ends, keeps the interior. No row if all are overfull."""
    return fill.filter(F.col("fill") <= most).groupBy(IMAGE).agg(F.min("z").alias("z_first"), F.max("z").alias("z_last"))


def volumes(voxels: DataFrame, shape: tuple[int, int, int], voxel: tuple = (2.0, 2.0, 2.0), masked: DataFrame | None = None) -> DataFrame:
    """Chip volume, less the columns of a plane mask (image_id, y, x) if there is one, and vessel volume, by image."""
    v = float(voxel[0] * voxel[1] * voxel[2])
    out = voxels.groupBy(IMAGE).agg((F.count(F.lit(1)) * v).alias("vessel_volume"))
    chip = F.lit(float(shape[0] * shape[1] * shape[2] * v))
    if masked is None:
        return out.select(IMAGE, chip.alias("chip_volume"), "vessel_volume")
    pixels = masked.select(IMAGE, "y", "x").distinct().groupBy(IMAGE).agg(F.count(F.lit(1)).alias("_n"))
    return out.join(pixels, IMAGE, "left").select(IMAGE, (chip - F.coalesce("_n", F.lit(0)) * (shape[0] * v)).alias("chip_volume"), "vessel_volume")


def projection(field: DataFrame, how: str = "max", value: str = "value") -> DataFrame:
    return field.groupBy(IMAGE, "y", "x").agg(getattr(F, {"mean": "avg"}.get(how, how))(value).alias("value"))


def shifted(df: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each (y, x) at all offsets."""
    at = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in offsets)))
    return df.withColumn("_o", at).withColumn("y", F.col("y") + F.col("_o.dy")).withColumn("x", F.col("x") + F.col("_o.dx")).drop("_o")


def thickened(flat: DataFrame, rows: int, columns: int) -> DataFrame:
    """Dilation of a plane by one in all eight directions, within its shape."""
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return shifted(flat.select(IMAGE, "y", "x").distinct(), near).filter(f"y BETWEEN 0 AND {rows - 1} AND x BETWEEN 0 AND {columns - 1}").distinct()


def eroded(flat: DataFrame) -> DataFrame:
    """Pixels all of whose eight neighbours are set too."""
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    counts = shifted(flat.select(IMAGE, "y", "x").distinct(), near).groupBy(IMAGE, "y", "x").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter("n = 9").select(IMAGE, "y", "x")


def without_mask(voxels: DataFrame, mask: DataFrame) -> DataFrame:
    """Voxels outside a plane mask that goes through all slices; a mask without image_id holds for every image."""
    keys = [c for c in (IMAGE, "y", "x") if c in mask.columns]
    return voxels.join(mask.select(*keys).distinct(), keys, "left_anti")


def coverage_guard(mask: DataFrame, pixels: int, most: float = 0.40) -> DataFrame:
    """How much of the plane a mask covers, and whether that is too much."""
    out = mask.groupBy(*([IMAGE] if IMAGE in mask.columns else [])).agg((F.count(F.lit(1)) / F.lit(pixels)).alias("fraction"))
    return out.withColumn("too_large", F.col("fraction") > most)


def mean_filled(field: DataFrame, mask: DataFrame) -> DataFrame:
    """Values under the mask become the mean of their slice outside it."""
    keys = [c for c in (IMAGE, "y", "x") if c in mask.columns]
    flagged = field.join(mask.select(*keys).distinct().withColumn("_in", F.lit(True)), keys, "left")
    outside = flagged.filter("_in IS NULL").groupBy(IMAGE, "z").agg(F.avg("value").alias("_mean"))
    return flagged.join(outside, [IMAGE, "z"], "left").select(IMAGE, "z", "y", "x", F.when(F.col("_in"), F.col("_mean")).otherwise(F.col("value")).alias("value"))


def min_max_scaled(field: DataFrame, value: str = "value") -> DataFrame:
    """To 0 to 1 by image; NULL where all values are equal. And to bytes, 0 where all are equal."""
    ends = field.groupBy(IMAGE).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = safe_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return field.join(ends, IMAGE).withColumn("scaled", scaled).withColumn("byte", F.floor(F.coalesce(scaled, F.lit(0.0)) * 255).cast("int")).drop("_lo", "_hi")


def rasterised(lines: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """The voxels of polylines (image_id, pts), clipped to the shape."""
    p = lines.select(IMAGE, F.explode("pts").alias("p"))
    clip = lambda c, n: F.least(F.greatest(F.col(f"p.{c}"), F.lit(0)), F.lit(n - 1)).cast("int").alias(c)
    return p.select(IMAGE, *(clip(c, n) for c, n in zip("zyx", shape, strict=True))).distinct()


def vertex_lookup(lines: DataFrame, field: DataFrame, key: str, name: str = "value") -> DataFrame:
    """(key, pos, z, y, x, name): the field's value at each vertex of polylines; NULL where it has none."""
    v = lines.select(IMAGE, key, F.posexplode("pts").alias("pos", "p")).select(IMAGE, key, "pos", "p.z", "p.y", "p.x")
    return v.join(field.withColumnRenamed("value", name), [IMAGE, "z", "y", "x"], "left")


def edge_diameters(lines: DataFrame, field: DataFrame, key: str) -> DataFrame:
    """Twice the median of a distance field along each polyline."""
    return vertex_lookup(lines, field, key).groupBy(IMAGE, key).agg((2 * F.percentile("value", F.lit(0.5))).alias("diameter"))


def colour_bounds(values: DataFrame, value: str) -> DataFrame:
    """Half of P5 and P95 of positive values."""
    return values.filter(F.col(value) > 0).groupBy(IMAGE).agg((F.percentile(value, F.lit(0.05)) * 0.5).alias("low"), F.percentile(value, F.lit(0.95)).alias("high"))


def nearest_plane(field: DataFrame, zmap: DataFrame, offset: int, planes: int) -> DataFrame:
    """Values at zmap + offset, clipped to the stack: the plane that a z-map selects."""
    wanted = zmap.select(IMAGE, "y", "x", F.least(F.greatest(F.col("z") + offset, F.lit(0)), F.lit(planes - 1)).alias("z"))
    return field.join(wanted, [IMAGE, "z", "y", "x"]).select(IMAGE, "y", "x", "value")


def downsampled(field: DataFrame, step: int) -> DataFrame:
    return field.filter((F.pmod("y", F.lit(step)) == 0) & (F.pmod("x", F.lit(step)) == 0)).withColumn("y", (F.col("y") / step).cast("int")).withColumn("x", (F.col("x") / step).cast("int"))


def cropped(voxels: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """Voxels from low to high (excluded), moved to the origin."""
    test = F.lit(True)
    for c, a, b in zip("zyx", low, high, strict=True):
        test = test & (F.col(c) >= a) & (F.col(c) < b)
    out = voxels.filter(test)
    for c, a in zip("zyx", low, strict=True):
        out = out.withColumn(c, F.col(c) - a)
    return out


def union_masks(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def common_mask(a: DataFrame, b: DataFrame) -> DataFrame:
    """The cells that both masks (of the same columns) have."""
    return a.join(b.select(*a.columns).distinct(), a.columns, "left_semi").distinct()


def mask_less(a: DataFrame, b: DataFrame) -> DataFrame:
    """The cells of a mask that another hasn't."""
    return a.join(b.select(*a.columns).distinct(), a.columns, "left_anti").distinct()


def complement(mask: DataFrame, images: DataFrame, height: int, width: int) -> DataFrame:
    """The cells (image_id, y, x) of each image's plane that a mask hasn't."""
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    every = images.select(IMAGE).distinct().withColumn("y", axis(height)).withColumn("x", axis(width))
    return every.join(mask.select(IMAGE, "y", "x").distinct(), [IMAGE, "y", "x"], "left_anti")


def largest_component(labelled: DataFrame, label: str = "label") -> DataFrame:
    """Of each image the label with most rows; of equally large ones the least."""
    sizes = labelled.groupBy(IMAGE, label).agg(F.count(F.lit(1)).alias("area"))
    return sizes.groupBy(IMAGE).agg(F.min_by(label, F.struct(-F.col("area"), F.col(label))).alias(label), F.max("area").alias("area"))


def regions(labelled: DataFrame, label: str = "label") -> DataFrame:
    """Area, bounding box, centroid and eccentricity of each labelled region of a plane."""
    m = labelled.groupBy(IMAGE, label).agg(
        F.count(F.lit(1)).alias("area"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"),
        F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.var_pop("y").alias("_a"), F.var_pop("x").alias("_b"), F.covar_pop("y", "x").alias("_c"),
    )
    half, root = (F.col("_a") + F.col("_b")) / 2 + 1 / 12, F.sqrt(((F.col("_a") - F.col("_b")) / 2) ** 2 + F.col("_c") ** 2)
    return m.withColumn("eccentricity", F.sqrt(F.greatest(F.lit(0.0), 1 - (half - root) / (half + root)))).drop("_a", "_b", "_c")


def focus_votes(focus: DataFrame) -> DataFrame:
    """(image, z, votes) from (image, patch, z, focus): each patch votes for its sharpest slice, the first on ties."""
    best = focus.groupBy(IMAGE, "patch").agg(F.min_by("z", F.struct(-F.col("focus"), F.col("z"))).alias("z"))
    return best.groupBy(IMAGE, "z").agg(F.count(F.lit(1)).alias("votes"))


def dense_votes(votes: DataFrame) -> DataFrame:
    """Votes for every slice from 0 to the last one voted for, 0 where there are none."""
    ends = votes.groupBy(IMAGE).agg(F.max("z").alias("last"))
    grid = ends.select(IMAGE, F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))).alias("z"))
    return grid.join(votes, [IMAGE, "z"], "left").select(IMAGE, "z", F.coalesce("votes", F.lit(0)).alias("votes"))


def argmax(df: DataFrame, by: list[str], value: str, at: str) -> DataFrame:
    """The `at` of the greatest value, the least on ties."""
    return df.groupBy(*by).agg(F.min_by(at, F.struct(-F.col(value), F.col(at))).alias(at), F.max(value).alias(value))
