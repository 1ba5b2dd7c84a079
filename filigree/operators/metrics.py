"""Metric tables of edges, nodes and images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.functions import geometry as g
from filigree.functions.stats import AGGREGATORS, array_mean, array_median, array_std, safe_divide
from filigree.operators.cohort import long
from filigree.schemas import AGGREGATES, BRANCH_METRICS, CURATED_PANEL, EDGE_ALIASES, NODE_METRICS, panel_columns

IMAGE = "image_id"


def branch_metrics(lines: DataFrame, voxel: tuple = g.VOXEL, axis: str = "x") -> DataFrame:
    """The 25 metrics of each edge (image_id, u, v, edge_kind, pts, areas), within the row: no explode, no shuffle.

    areas: a cross-section for each point, NULL or NaN where unknown. Edges with fewer than two points have no row.
    """
    a, z = F.get("pts", F.lit(0)), F.get("pts", F.size("pts") - 1)
    known = F.filter("areas", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    out = lines.filter(F.size("pts") >= 2).withColumn("_areas", known)
    out = out.withColumn("_widths", F.transform(F.filter("_areas", lambda v: v > 0), g.width))
    out = out.withColumns({"path_length": g.path_length("pts", voxel), "endpoint_distance": g.chord("pts", voxel)})
    columns = {
        "node_start": F.col("u"), "node_end": F.col("v"), "edge_kind": F.col("edge_kind"),
        **{f"start_{c}_idx": a[c] for c in "zyx"}, **{f"end_{c}_idx": z[c] for c in "zyx"},
        **{f"start_{c}": a[c] * s for c, s in zip("zyx", voxel, strict=True)}, **{f"end_{c}": z[c] * s for c, s in zip("zyx", voxel, strict=True)},
        "path_length": F.col("path_length"), "endpoint_distance": F.col("endpoint_distance"),
        "tortuosity": g.tortuosity(F.col("path_length"), F.col("endpoint_distance")),
        "mean_cs_area": array_mean(F.col("_areas")), "median_cs_area": array_median(F.col("_areas")), "std_cs_area": array_std(F.col("_areas")),
        "mean_width": array_mean(F.col("_widths")), "median_width": array_median(F.col("_widths")),
        "branch_volume": array_mean(F.col("_areas")) * F.col("path_length"),
        "orientation_to_device_axis": g.orientation((z["x"] - a["x"]) * voxel[2], (z["y"] - a["y"]) * voxel[1], axis),
    }
    return out.select(IMAGE, *(columns[c].alias(c) for c in BRANCH_METRICS))


def junction_table(found: DataFrame) -> DataFrame:
    """graph.neighbours() under the names of the node table."""
    return found.withColumn("is_sprout_tip", F.col("sprout")).withColumn("is_junction", ~F.col("sprout")).drop("sprout")


def subset_statistics(metrics: DataFrame, columns: list[str], subset: str, everything: str | None = None) -> DataFrame:
    """Long (image_id, subset, metric, value of each aggregate): a row explodes into its subset and, if named, that of all.

    One shuffle by (image, subset), of all columns' aggregates; they become long when they are few.
    """
    tags = F.array(F.col(subset), F.lit(everything)) if everything else F.array(F.col(subset))
    tagged = metrics.select(IMAGE, F.explode(tags).alias("subset"), *(F.col(c).cast("double").alias(c) for c in columns))
    wide = tagged.groupBy(IMAGE, "subset").agg(*(AGGREGATORS[a](c).alias(f"{a} {c}") for c in columns for a in AGGREGATES))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), *(F.col(f"{a} {c}").alias(a) for a in AGGREGATES)) for c in columns)))
    return wide.select(IMAGE, "subset", each.alias("_of")).select(IMAGE, "subset", "_of.*")


def named(stats: DataFrame) -> DataFrame:
    """(image_id, name, value) with names such as median_branch_length."""
    return long(stats, [IMAGE, "subset", "metric"], list(AGGREGATES), "agg", "value").select(IMAGE, F.concat_ws("_", "agg", "subset", "metric").alias("name"), "value")


def edge_statistics(metrics: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Of all metrics of edges, or of some by their short names."""
    names = list(EDGE_ALIASES) if names is None else names
    renamed = metrics.select(IMAGE, "edge_kind", *(F.col(EDGE_ALIASES[a]).alias(a) for a in names))
    return subset_statistics(renamed, names, "edge_kind", "sprout_and_branch")


def measured(columns: list[str]) -> list[str]:
    """The short names of the edge metrics that columns of a panel may come from."""
    return [a for a in EDGE_ALIASES if any(c.endswith(f"_{a}") for c in columns)]


def node_statistics(nodes: DataFrame, kind: str | None = None) -> DataFrame:
    """Of junctions, tips and all nodes; with a kind, of all nodes under that name."""
    if kind:
        return subset_statistics(nodes.withColumn("_kind", F.lit(kind)), list(NODE_METRICS), "_kind")
    tagged = nodes.withColumn("_kind", F.when(F.col("is_sprout_tip"), "sprout_tip").otherwise("junction"))
    return subset_statistics(tagged, list(NODE_METRICS), "_kind", "all_nodes")


def panel(values: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One wide row for each image with a fixed list of columns, NULL where a value is absent."""
    columns = columns or panel_columns()
    return values.filter(F.col("name").isin(columns)).groupBy(IMAGE).pivot("name", columns).agg(F.first("value"))


def curated_panel(values: DataFrame) -> DataFrame:
    return panel(values, list(CURATED_PANEL))


def densities(volumes: DataFrame, edges: DataFrame, branches: DataFrame, junctions: DataFrame) -> DataFrame:
    """Volumes, counts, total length and their quotients, a row for each image of `volumes`.

    volumes: (image_id, chip_volume, vessel_volume, convex_hull_volume). Sprouts are counted in `edges` (edge_kind) of the
    clean graph and junctions in its nodes (image_id, junctions); length and number of branches are those of `branches`
    (path_length), the edges of the graph without sprouts. Shares and densities are per volume of the hull. Images without
    edges count 0; a quotient by 0 is NULL.
    """
    sprouts = edges.groupBy(IMAGE).agg(*(F.count_if(F.col("edge_kind") == k).alias(n) for k, n in (("attached_sprout", "attached_sprouts"), ("floating_sprout", "floating_sprouts"))))
    b = branches.groupBy(IMAGE).agg(F.sum("path_length").alias("total_vessel_length"), F.count(F.lit(1)).alias("branches"))
    t = volumes.join(sprouts, IMAGE, "left").join(b, IMAGE, "left").join(junctions, IMAGE, "left")
    t = t.fillna(0, ["attached_sprouts", "floating_sprouts", "branches", "junctions"]).fillna(0.0, ["total_vessel_length"])
    per = {
        "vessel_volume_fraction": ("vessel_volume", "convex_hull_volume"), "branch_length_per_volume": ("total_vessel_length", "convex_hull_volume"),
        "attached_sprouts_per_vessel_length": ("attached_sprouts", "total_vessel_length"), "junctions_per_vessel_length": ("junctions", "total_vessel_length"),
        "attached_sprouts_per_volume": ("attached_sprouts", "convex_hull_volume"), "junctions_per_volume": ("junctions", "convex_hull_volume"),
        "branches_per_volume": ("branches", "convex_hull_volume"), "floating_sprouts_per_volume": ("floating_sprouts", "convex_hull_volume"),
    }
    return t.select(IMAGE, "chip_volume", "convex_hull_volume", "vessel_volume", "total_vessel_length", *(safe_divide(n, d).alias(c) for c, (n, d) in per.items()))


def headline(distances: DataFrame, value: str, kind: str) -> DataFrame:
    """(image_id, name, value): median and spread of nearest distances of junctions and of tips."""
    whom = F.when(F.col("sprout"), F.lit(f"sprout_{kind}_dist_nearest_endpoint")).otherwise(F.lit(f"junction_{kind}_dist_nearest_junction"))
    s = distances.groupBy(IMAGE, whom.alias("whom")).agg(AGGREGATORS["median"](value).alias("median"), AGGREGATORS["spread"](value).alias("spread"))
    return long(s, [IMAGE, "whom"], ["median", "spread"], "agg", "value").select(IMAGE, F.concat_ws("_", "agg", "whom").alias("name"), "value")


def junction_points(metrics: DataFrame, digits: int = 3) -> DataFrame:
    """Places, rounded, where at least two branch ends meet."""
    ends = metrics.filter("edge_kind = 'branch'").select(IMAGE, F.explode(F.array(*(F.struct(*(F.round(f"{e}_{c}", digits).alias(c) for c in "zyx")) for e in ("start", "end")))).alias("p"))
    return ends.groupBy(IMAGE, "p.z", "p.y", "p.x").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
