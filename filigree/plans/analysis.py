"""The whole analysis of binary volumes: from masks to metric tables of edges, nodes and images."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.functions import geometry
from filigree.operators import cohort, graph, metrics, tiles, volume, voxels
from filigree.operators.runs import resampled
from filigree.sources.scratch import stored
from filigree.sources.workers import importable

IMAGE = "image_id"


def skeletons(volumes: DataFrame, mask: DataFrame | None = None, voxel: tuple = geometry.VOXEL, sigma: float = 3.0) -> DataFrame:
    """(image_id, z, y, x, in_skeleton, area) of the voxels of smoothed, filled masks, one volume in memory at a time.

    Columns under a plane mask (image_id, y, x) are emptied before all else. area: pi times the distance to the edge in the
    projection of the raw volume, times that in the cleaned one, both in micrometres; on the centreline only.
    """
    importable(volumes.sparkSession)
    rows = volumes.select(IMAGE, "shape", "dtype", "data")
    if mask is not None:  # at most a plane for each image
        cut = mask.groupBy(IMAGE).agg(F.collect_list("y").alias("cut_y"), F.collect_list("x").alias("cut_x"))
        rows = rows.join(cut, IMAGE, "left")

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                raw = volume.unpack(row).astype(bool)
                if row.get("cut_y") is not None:
                    y, x = (np.asarray(row[c], np.int64) for c in ("cut_y", "cut_x"))
                    inside = (y >= 0) & (y < raw.shape[1]) & (x >= 0) & (x < raw.shape[2])
                    raw[:, y[inside], x[inside]] = False
                solid = volume.filled(volume.smoothed(raw, sigma))
                thin = volume.thinned(solid)
                flat, deep = volume.distance(raw.any(axis=0), tuple(voxel[1:])), volume.distance(solid, tuple(voxel))
                z, y, x = np.nonzero(solid)
                on = thin[z, y, x]
                area = np.where(on, np.pi * flat[y, x] * deep[z, y, x], np.nan)
                out = pd.DataFrame({IMAGE: row[IMAGE], "z": z.astype(np.int32), "y": y.astype(np.int32), "x": x.astype(np.int32), "in_skeleton": on, "area": area})
                yield out.replace({"area": {np.inf: np.nan}})

    found = rows.mapInPandas(run, f"{IMAGE} string, z int, y int, x int, in_skeleton boolean, area double")
    return found.withColumn("area", F.when(~F.isnan("area"), F.col("area")))


def tiled_skeletons(cells: DataFrame, shape: tuple[int, int, int], mask: DataFrame | None = None, voxel: tuple = geometry.VOXEL, sigma: float = 3.0, tile: tuple = tiles.TILE) -> DataFrame:
    """As skeletons(), of voxels (image_id, z, y, x) and over tiles: for volumes that no task could hold."""
    cells = cells.select(IMAGE, "z", "y", "x")
    raw = stored(tiles.from_voxels(cells if mask is None else cells.join(mask.select(IMAGE, "y", "x"), [IMAGE, "y", "x"], "left_anti"), shape, tile), "raw")
    solid = stored(tiles.filled(tiles.smoothed(raw, sigma, tile), tile), "solid")
    thin, deep = tiles.thinned(solid, tile), tiles.distance(solid, tuple(voxel), tile)
    flat = tiles.voxels(tiles.distance(stored(tiles.projected(raw), "projected"), tuple(voxel), (1, *tile[1:])))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = {r["kind"]: tiles.unpacked(r) for r in pdf.to_dict("records")}
        z, y, x = np.nonzero(a["solid"])
        low = pdf["low"].iloc[0]
        return pd.DataFrame({IMAGE: pdf[IMAGE].iloc[0], **{c: (i + k).astype(np.int32) for c, i, k in zip("zyx", (z, y, x), low, strict=True)}, "in_skeleton": a["thin"][z, y, x], "deep": a["deep"][z, y, x]})

    kinds = {"solid": solid, "thin": thin, "deep": deep}
    both = functools.reduce(DataFrame.unionByName, (t.select(IMAGE, "low", "size", "dtype", "data", F.lit(k).alias("kind")) for k, t in kinds.items()))
    found = both.groupBy(IMAGE, "low").applyInPandas(run, f"{IMAGE} string, z int, y int, x int, in_skeleton boolean, deep double")
    found = found.join(flat.select(IMAGE, "y", "x", F.col("value").alias("flat")), [IMAGE, "y", "x"], "left")
    area = F.lit(float(np.pi)) * F.coalesce("flat", F.lit(0.0)) * F.col("deep")
    return found.select(IMAGE, "z", "y", "x", "in_skeleton", F.when(F.col("in_skeleton") & ~F.isnan(area) & (area < float("inf")), area).alias("area"))


def with_areas(edges: DataFrame, field: DataFrame) -> DataFrame:
    """Edges with the field's values along their points, in order; 0 off the centreline."""
    v = edges.select(IMAGE, "u", "v", F.posexplode("pts").alias("pos", "p")).select(IMAGE, "u", "v", "pos", "p.z", "p.y", "p.x")
    found = v.join(field.select(IMAGE, "z", "y", "x", F.col("area").alias("a"), F.lit(True).alias("on")), [IMAGE, "z", "y", "x"], "left")
    found = found.withColumn("a", F.when(F.col("on"), F.col("a")).otherwise(0.0))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "a"))), lambda s: s["a"])
    return edges.join(found.groupBy(IMAGE, "u", "v").agg(ordered.alias("areas")), [IMAGE, "u", "v"])


def pruned(edges: DataFrame, shortest: float = 25.0, ratio: float = 0.20, samples: int = 20) -> DataFrame:
    """Tips that are short (in voxels) or blunt go, to the end.

    Of an edge's areas, brought to 100 samples, the thinner half is the tip's. Blunt: the mean of the tip's `samples` over
    the area at the other end is above the ratio.
    """
    profile = resampled(F.transform("areas", lambda a: F.coalesce(a, F.lit(0.0))))
    mean = lambda first, n: F.aggregate(F.slice("_p", first, n), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / n
    e = edges.withColumn("_p", profile).withColumn("_first", mean(1, 50) < mean(51, 50))
    e = e.withColumn("_tip", F.when(F.col("_first"), mean(1, samples)).otherwise(mean(101 - samples, samples)))
    e = e.withColumn("_far", F.when(F.col("_first"), F.element_at("_p", -1)).otherwise(F.get("_p", F.lit(0))))
    marked = e.withColumn("_removable", graph.removable("weight", "_tip", "_far", shortest, ratio))
    return graph.peeled(marked.drop("_p", "_first", "_tip", "_far"), "_removable").drop("_removable")


def off_mask(edges: DataFrame, mask: DataFrame) -> DataFrame:
    """Edges none of whose points lies under a plane mask (image_id, y, x)."""
    hit = edges.select(IMAGE, "u", "v", F.explode("pts").alias("p")).select(IMAGE, "u", "v", "p.y", "p.x").join(mask.select(IMAGE, "y", "x"), [IMAGE, "y", "x"], "left_semi")
    return edges.join(hit.select(IMAGE, "u", "v").distinct(), [IMAGE, "u", "v"], "left_anti")


def of_each(mask: DataFrame, images: DataFrame) -> DataFrame:
    """A plane mask with a row for each image: one without image_id holds for all."""
    if IMAGE in mask.columns:
        return mask.select(mask[IMAGE].cast("string").alias(IMAGE), "y", "x").distinct()
    return images.withColumn("_all", F.lit(1)).join(mask.select("y", "x").distinct().withColumn("_all", F.lit(1)), "_all").drop("_all")


def analyse(volumes: DataFrame, shape: tuple[int, int, int], mask: DataFrame | None = None, voxel: tuple = geometry.VOXEL, axis: str | None = None, margin: int = geometry.BORDER, shortest: float = 25.0, ratio: float = 0.20, sigma: float = 3.0, tile: tuple = tiles.TILE) -> dict[str, DataFrame]:
    """From volumes (a row each), or from voxels (image_id, z, y, x), which are cut into tiles of any number.

    Tables by name: voxels, field (areas on the centreline), raw_edges, nodes, edges, skeleton (the clean graph's voxels),
    branch_metrics, junction_metrics, those of the graph without sprouts (branch_only_...), global_metrics, panel, curated.

    Columns under a plane mask ([image_id,] y, x) are emptied first; they count in neither the chip's nor the hull's volume,
    and edges that pass under it go, as do those that come within the margin of the border. axis: the device's long one, by
    the shape if not given. An image without voxels, or without edges, has its row of global metrics, with counts of 0.
    """
    axis = axis or ("x" if shape[2] >= shape[1] else "y")
    images = volumes.select(F.col(IMAGE).cast("string").alias(IMAGE)).distinct()
    cut = None if mask is None else stored(of_each(mask, images), "mask")
    found = skeletons(volumes, cut, voxel, sigma) if "data" in volumes.columns else tiled_skeletons(volumes, shape, cut, voxel, sigma, tile)
    cells = stored(found, "cells")
    solid, field = cells.select(IMAGE, "z", "y", "x"), cells.filter("in_skeleton").select(IMAGE, "z", "y", "x", "area")
    nodes, raw = graph.from_skeleton(field.select(IMAGE, "z", "y", "x"))
    inner = graph.contracted(pruned(with_areas(raw, field), shortest, ratio)).filter(~geometry.near_border("pts", shape[1] - 1, shape[2] - 1, margin))
    clean = stored(inner if cut is None else off_mask(inner, cut), "clean")
    branches = stored(graph.branch_only(clean), "branch_only")

    edges = stored(with_areas(graph.kinds(clean), field), "edges")
    table = stored(metrics.branch_metrics(edges, voxel, axis), "branches")
    branch_table = stored(metrics.branch_metrics(with_areas(graph.kinds(branches), field), voxel, axis), "branches")
    placed = stored(graph.sprouts(nodes, clean), "nodes")
    near = stored(metrics.junction_table(graph.neighbours(placed, voxel)), "junctions")
    # without sprouts, all nodes count as junctions, those of degree 1 too
    inner_nodes = graph.sprouts(nodes, branches).withColumn("sprout", F.lit(False))
    branch_near = stored(metrics.junction_table(graph.neighbours(inner_nodes, voxel)), "junctions")

    chip = voxels.volumes(solid.unionByName(images.select(IMAGE, *(F.lit(None).cast("int").alias(c) for c in "zyx"))), shape, voxel, cut)
    unit = float(voxel[0] * voxel[1] * voxel[2])
    hull = volume.hulls(solid, voxel) if cut is None else volume.hulls_without_mask(solid, cut, shape, voxel)
    size = chip.withColumn("vessel_volume", F.col("vessel_volume") - unit).join(hull, IMAGE, "left")  # less the row of each image
    none = F.col("convex_hull_volume").isNull() | (F.lit(cut is None) & (F.col("convex_hull_volume") <= 0))
    size = size.withColumn("convex_hull_volume", F.when(none, F.col("chip_volume")).otherwise(F.col("convex_hull_volume")))
    junctions = placed.groupBy(IMAGE).agg(F.count_if(~F.col("sprout")).alias("junctions"))
    drawn = stored(voxels.rasterised(clean, shape), "drawn")
    box = voxels.fractal(drawn, voxels.box_scales(min(shape))).select(IMAGE, F.col("fractal_dimension").alias("skeleton_fractal_dimension"), F.col("lacunarity").alias("skeleton_lacunarity"))
    average = table.groupBy(IMAGE).agg(F.avg("branch_volume").alias("average_vessel_volume"))
    totals = stored(metrics.densities(size, table, branch_table, junctions).join(box, IMAGE, "left").join(average, IMAGE, "left"), "totals")

    weighted = clean.withColumn("weight", geometry.path_length("pts", voxel))
    along = metrics.headline(graph.along_skeleton(weighted, placed), "distance", "skeleton")
    flat = near.withColumn("_d", F.when(F.col("is_sprout_tip"), F.col("dist_nearest_endpoint")).otherwise(F.col("dist_nearest_junction"))).withColumn("sprout", F.col("is_sprout_tip"))
    headlines = along.unionByName(metrics.headline(flat, "_d", "euclidean"))
    names = [c for c in totals.columns if c != IMAGE]
    edge_stats = metrics.edge_statistics(table).filter("subset <> 'branch'").unionByName(metrics.edge_statistics(branch_table.withColumn("edge_kind", F.lit("branch"))).filter("subset = 'branch'"))
    node_stats = metrics.node_statistics(near).unionByName(metrics.node_statistics(branch_near, "branch_only_junction"))
    values = cohort.union_all([cohort.long(totals, [IMAGE], names, "name", "value"), headlines, metrics.named(edge_stats), metrics.named(node_stats)])
    values = stored(values, "values")
    return {
        "voxels": solid, "field": field, "raw_edges": raw, "nodes": placed, "edges": edges, "skeleton": drawn, "branch_only_edges": branches,
        "branch_metrics": table, "branch_only_metrics": branch_table, "junction_metrics": near, "branch_only_junction_metrics": branch_near,
        "global_metrics": totals, "panel": metrics.panel(values), "curated": metrics.curated_panel(values),
    }


def stopped(images: DataFrame, mask: DataFrame, pixels: int, votes: DataFrame, cells: DataFrame | None = None, shape: tuple | None = None, strong: int = 2, most: float = 0.75) -> DataFrame:
    """(image_id, category, body) of images that the pipeline stops for, each with the first of four reasons, in the order of its stages.

    organoid_too_large: over 40 % of the plane's pixels are masked. no_valid_z_range: no plane has a vote. no_strong_vote_planes: none has
    more than `strong` votes. all_slices_trimmed (where voxels `cells` and their shape are given): each slice is filled to more than
    `most`; body lists the slices. images: (image_id) of all jobs.
    """
    large = voxels.coverage_guard(mask, pixels, 0.4).filter("too_large").select(IMAGE, F.lit(1).alias("n"), F.lit("organoid_too_large").alias("category"), F.format_string("Masked: %.1f%% of the image.", F.col("fraction") * 100).alias("body"))
    any_vote = votes.filter(F.col("votes") > 0).select(IMAGE).distinct()
    none = images.select(IMAGE).join(any_vote, IMAGE, "left_anti").select(IMAGE, F.lit(2).alias("n"), F.lit("no_valid_z_range").alias("category"), F.lit("No plane has a vote.").alias("body"))
    weak = any_vote.join(votes.filter(F.col("votes") > strong).select(IMAGE).distinct(), IMAGE, "left_anti").select(IMAGE, F.lit(3).alias("n"), F.lit("no_strong_vote_planes").alias("category"), F.format_string("No plane has more than %d votes.", F.lit(strong)).alias("body"))
    parts = [large, none, weak]
    if cells is not None:
        fill = cells.groupBy(IMAGE, "z").agg((F.count(F.lit(1)) / (shape[1] * shape[2])).alias("fill"))
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("z", "fill"))), lambda s: F.format_string("slice %4d: %.4f", s["z"], s["fill"])), "\n")
        over = fill.groupBy(IMAGE).agg(F.count_if(F.col("fill") > most).alias("over"), lines.alias("body")).filter(F.col("over") == shape[0])  # slices of an image
        parts.append(over.select(IMAGE, F.lit(4).alias("n"), F.lit("all_slices_trimmed").alias("category"), "body"))
    every = cohort.union_all(parts).join(images.select(IMAGE).distinct(), IMAGE, "left_semi")
    return every.groupBy(IMAGE).agg(F.min_by(F.struct("category", "body"), "n").alias("r")).select(IMAGE, "r.category", "r.body")


def guarded(cells: DataFrame, votes: DataFrame, mask: DataFrame, pixels: int) -> DataFrame:
    """(image_id, category) of images that the analysis stops for: the mask is too large, or no run of strong votes."""
    from filigree.operators import runs

    large = voxels.coverage_guard(mask, pixels).filter("too_large").select(IMAGE, F.lit("organoid_too_large").alias("category"))
    images = cells.select(IMAGE).distinct()
    weak = images.join(runs.longest_votes(votes, 2), IMAGE, "left_anti").select(IMAGE, F.lit("no_strong_vote_planes").alias("category"))
    return large.unionByName(weak.join(large, IMAGE, "left_anti"))
