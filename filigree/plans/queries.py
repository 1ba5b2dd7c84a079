"""The engine's operators on the test tables, each with SQL for what it should return where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.functions import geometry, labels, stats
from filigree.operators import cohort, crop, focus, graph, metrics, runs, tiles, volume, voxels
from filigree.plans import analysis
from filigree.plans.fixtures import SHAPE, SOLID, STACK, Fixtures, with_views
from filigree.schemas import CURATED_PANEL
from filigree.sources import jobs
from filigree.sources.scratch import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    def add(f: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Fixtures(spark, folder))
        if sql:
            ORACLE_SQL[name] = with_views(sql, *views) if views else sql
        return f

    return add


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


@query("q01_edge_kind_counts", "SELECT image_id, edge_kind, count(*) AS n FROM knd GROUP BY 1, 2", "knd")
def _(fx):
    return graph.kinds(fx.edges()).groupBy("image_id", "edge_kind").agg(F.count(F.lit(1)).alias("n"))


@query("q02_node_degree_stats", "SELECT image_id, round(avg(degree), 5) AS mean, round(stddev_pop(degree), 5) AS std, median(degree) AS median, max(degree) AS most FROM deg GROUP BY 1", "deg")
def _(fx):
    d = graph.degrees(fx.edges()).groupBy("image_id").agg(stats.mean("degree").alias("mean"), stats.population_std("degree").alias("std"), stats.safe_median("degree").alias("median"), F.max("degree").alias("most"))
    return rounded(d, 5, "mean", "std")


@query("q03_polyline_length", "SELECT line, round(sum(step), 5) AS path_length FROM seg GROUP BY line", "seg")
def _(fx):
    return rounded(fx.lines().select("line", geometry.path_length("pts").alias("path_length")), 5, "path_length")


_MET = {"path_length": 5, "endpoint_distance": 5, "tortuosity": 6, "mean_cs_area": 5, "median_cs_area": 5, "std_cs_area": 4, "mean_width": 5, "median_width": 5, "branch_volume": 1, "orientation_to_device_axis": 5}


@query("q04_branch_metrics", "SELECT line, edge_kind, " + ", ".join(f"round({c}, {d}) AS {c}" for c, d in _MET.items()) + " FROM met", "met")
def _(fx):
    out = metrics.branch_metrics(fx.lines()).withColumnRenamed("node_start", "line").select("line", "edge_kind", *_MET)
    return out.withColumns({c: F.round(c, d) for c, d in _MET.items()})


@query("q05_tortuosity_orientation", "SELECT edge_kind, round(avg(tortuosity), 5) AS tortuosity, round(max(tortuosity), 5) AS most, count(orientation_to_device_axis) AS oriented FROM met GROUP BY 1", "met")
def _(fx):
    m = metrics.branch_metrics(fx.lines())
    return m.groupBy("edge_kind").agg(F.round(F.avg("tortuosity"), 5).alias("tortuosity"), F.round(F.max("tortuosity"), 5).alias("most"), F.count("orientation_to_device_axis").alias("oriented"))


@query("q06_equivalent_width", "SELECT line, round(mean_width, 5) AS mean_width, round(median_width, 5) AS median_width FROM met", "met")
def _(fx):
    w = F.transform("areas", geometry.width)
    return rounded(fx.lines().select("line", stats.array_mean(w).alias("mean_width"), stats.array_median(w).alias("median_width")), 5, "mean_width", "median_width")


_ALIAS = {"length": "path_length", "tortuosity": "tortuosity", "median_cs_area": "median_cs_area", "orientation": "orientation_to_device_axis"}
_SUBSETS = " UNION ALL ".join(f"SELECT image_id, {s} AS subset, '{a}' AS metric, {c} AS value FROM met" for a, c in _ALIAS.items() for s in ("edge_kind", "'sprout_and_branch'"))
_STATS = "round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(median(value), 4) AS median, round(quantile_cont(value, 0.9) - quantile_cont(value, 0.1), 4) AS spread"


def _edge_stats(fx, names) -> DataFrame:
    return metrics.edge_statistics(metrics.branch_metrics(fx.lines()), list(names))


@query("q07_subset_stats_long", f"SELECT image_id, subset, metric, {_STATS} FROM ({_SUBSETS}) GROUP BY 1, 2, 3", "met")
def _(fx):
    return rounded(_edge_stats(fx, _ALIAS), 4, "mean", "std", "median", "spread")


_WIDE = ["median_branch_length", "spread_branch_length", "mean_sprout_and_branch_tortuosity", "std_floating_sprout_median_cs_area", "mean_attached_sprout_orientation"]


@query(
    "q08_subset_stats_wide",
    f"+s AS (SELECT image_id, subset, metric, {_STATS} FROM ({_SUBSETS}) GROUP BY 1, 2, 3) SELECT image_id, max(median) FILTER (subset = 'branch' AND metric = 'length') AS median_branch_length, max(spread) FILTER (subset = 'branch' AND metric = 'length') AS spread_branch_length, max(mean) FILTER (subset = 'sprout_and_branch' AND metric = 'tortuosity') AS mean_sprout_and_branch_tortuosity, max(std) FILTER (subset = 'floating_sprout' AND metric = 'median_cs_area') AS std_floating_sprout_median_cs_area, max(mean) FILTER (subset = 'attached_sprout' AND metric = 'orientation') AS mean_attached_sprout_orientation FROM s GROUP BY 1",
    "met",
)
def _(fx):
    return rounded(metrics.panel(metrics.named(_edge_stats(fx, metrics.measured(_WIDE))), _WIDE), 4, *_WIDE)


@query("q09_node_stats_grouping_sets", "SELECT image_id, CASE WHEN grouping(sprout) = 1 THEN 'all_nodes' WHEN sprout THEN 'sprout_tip' ELSE 'junction' END AS subset, round(avg(degree), 5) AS mean, round(stddev_pop(degree), 5) AS std, median(degree) AS median FROM nod GROUP BY GROUPING SETS ((image_id, sprout), (image_id))", "nod")
def _(fx):
    n = fx.nodes().select("image_id", F.when(F.col("sprout"), "sprout_tip").otherwise("junction").alias("kind"), "degree")
    return rounded(metrics.subset_statistics(n, ["degree"], "kind", "all_nodes").select("image_id", "subset", "mean", "std", "median"), 5, "mean", "std")


_BOXES = voxels.box_scales(min(SHAPE))
_SHAPES = f"b AS (SELECT s AS scale, count(*) AS mass FROM (SELECT DISTINCT z, y, x FROM vox), (SELECT unnest({_BOXES}) AS s) GROUP BY s, floor(z / s), floor(y / s), floor(x / s)), c AS (SELECT scale, count(*) AS n, var_pop(mass) / (avg(mass) * avg(mass)) AS l FROM b GROUP BY 1 HAVING count(*) >= 2), f AS (SELECT 'MACHINERY' AS image_id, regr_slope(ln(n), -ln(scale)) AS skeleton_fractal_dimension, avg(l) AS skeleton_lacunarity FROM c)"
_CURATED_STATS = {c: c.split("_", 1) for c in CURATED_PANEL if c.split("_")[0] in ("median", "spread") and "_only_" not in c}
_CURATED_METRICS = {"length": "path_length", "median_cs_area": "median_cs_area", "tortuosity": "tortuosity", "orientation": "orientation_to_device_axis"}


def _curated_sql() -> str:
    """Each curated column: an aggregate of a metric over branches or all edges, the shape of MACHINERY's voxels, or NULL."""
    out = []
    for name in CURATED_PANEL:
        if name in _CURATED_STATS:
            agg, rest = _CURATED_STATS[name]
            subset = "sprout_and_branch" if rest.startswith("sprout_and_branch") else "branch"
            column, test = _CURATED_METRICS[rest.removeprefix(subset + "_")], "true" if subset == "sprout_and_branch" else "edge_kind = 'branch'"
            value = f"median({column}) FILTER ({test})" if agg == "median" else f"quantile_cont({column}, 0.9) FILTER ({test}) - quantile_cont({column}, 0.1) FILTER ({test})"
        elif name.startswith("skeleton_"):
            value = f"max(f.{name})"
        else:
            value = "NULL::DOUBLE"
        out.append(f"round({value}, 4) AS {name}")
    return "+" + _SHAPES + " SELECT met.image_id, " + ", ".join(out) + " FROM met LEFT JOIN f ON f.image_id = met.image_id GROUP BY 1"


@query("q10_curated_panel", _curated_sql(), "met", "vox")
def _(fx):
    edges = metrics.named(_edge_stats(fx, metrics.measured(_CURATED_STATS)))
    f = voxels.fractal(fx.voxels().select(F.lit("MACHINERY").alias("image_id"), "z", "y", "x").distinct(), _BOXES)
    more = cohort.long(f, ["image_id"], ["fractal_dimension", "lacunarity"], "name", "value").withColumn("name", F.concat(F.lit("skeleton_"), "name"))
    return rounded(metrics.curated_panel(edges.unionByName(more)).select("image_id", *CURATED_PANEL), 4, *CURATED_PANEL)


_SCALES = [2, 4, 8, 16, 32]
_BOX = "+b AS (SELECT image_id, s AS scale, count(*) AS mass FROM vox, (SELECT unnest([2, 4, 8, 16, 32]) AS s) GROUP BY image_id, s, floor(z / s), floor(y / s), floor(x / s)), c AS (SELECT image_id, scale, count(*) AS n, var_pop(mass) / (avg(mass) * avg(mass)) AS l FROM b GROUP BY 1, 2 HAVING count(*) >= 2) "


@query("q11_box_counts", _BOX + "SELECT image_id, scale, count(*) AS boxes, sum(mass)::BIGINT AS mass FROM b GROUP BY 1, 2", "vox")
def _(fx):
    return voxels.box_counts(fx.voxels(), _SCALES).groupBy("image_id", "scale").agg(F.count(F.lit(1)).alias("boxes"), F.sum("mass").alias("mass"))


@query("q12_fractal_dimension", _BOX + "SELECT image_id, round(regr_slope(ln(n), -ln(scale)), 6) AS fractal_dimension FROM c GROUP BY 1", "vox")
def _(fx):
    return rounded(voxels.fractal(fx.voxels(), _SCALES).select("image_id", "fractal_dimension"), 6, "fractal_dimension")


@query("q13_lacunarity", _BOX + "SELECT image_id, round(avg(l), 5) AS lacunarity FROM c GROUP BY 1", "vox")
def _(fx):
    return rounded(voxels.fractal(fx.voxels(), _SCALES).select("image_id", "lacunarity"), 5, "lacunarity")


@query("q14_slice_fill_trim", "SELECT image_id, min(z) AS z_first, max(z) AS z_last FROM (SELECT image_id, z, count(*) / 65536 AS fill FROM vox GROUP BY 1, 2) WHERE fill <= 0.0088 GROUP BY 1", "vox")
def _(fx):
    return voxels.trimmed_range(voxels.slice_fill(fx.voxels(), SHAPE[1], SHAPE[2]), 0.0088)


@query("q15_volumes", "SELECT image_id, (8 * 256 * 256 - 8 * (SELECT count(*) FROM msk)) * 8.0::DOUBLE AS chip_volume, count(*) * 8.0::DOUBLE AS vessel_volume FROM vox GROUP BY 1", "vox", "msk")
def _(fx):
    return voxels.volumes(fx.voxels(), SHAPE, masked=analysis.of_each(fx.mask(), fx.voxels().select("image_id").distinct()))


_RATIOS = {"vessel_volume_fraction": ("vessel_volume", "hull"), "branch_length_per_volume": ("len", "hull"), "attached_sprouts_per_vessel_length": ("att", "len"), "junctions_per_vessel_length": ("j", "len"), "attached_sprouts_per_volume": ("att", "hull"), "junctions_per_volume": ("j", "hull"), "branches_per_volume": ("b", "hull"), "floating_sprouts_per_volume": ("flo", "hull")}


@query(
    "q62_densities",
    "+v AS (SELECT c_mktsegment AS image_id, count(*) * 8.0::DOUBLE AS vessel_volume, CASE WHEN c_mktsegment = 'MACHINERY' THEN 0 ELSE sum(c_nationkey) * 100.0::DOUBLE END AS hull, count(DISTINCT c_nationkey) AS j FROM customer GROUP BY 1), e AS (SELECT image_id, count(*) FILTER (edge_kind = 'attached_sprout') AS att, count(*) FILTER (edge_kind = 'floating_sprout') AS flo, count(*) FILTER (edge_kind = 'branch') AS b, sum(path_length) FILTER (edge_kind = 'branch') AS len FROM met GROUP BY 1) SELECT image_id, hull AS convex_hull_volume, round(len, 4) AS total_vessel_length, "
    + ", ".join(f"round(CASE WHEN {d} > 0 THEN {n} / {d} END, 8) AS {c}" for c, (n, d) in _RATIOS.items()) + " FROM v JOIN e USING (image_id)",
    "met",
)
def _(fx):
    c = fx.table("customer").groupBy(F.col("c_mktsegment").alias("image_id"))
    hull = F.when(F.col("image_id") == "MACHINERY", 0.0).otherwise(F.col("s") * 100.0)
    v = c.agg((F.count(F.lit(1)) * 8.0).alias("vessel_volume"), F.sum("c_nationkey").alias("s"), F.count_distinct("c_nationkey").alias("junctions"))
    size, junctions = v.select("image_id", F.lit(1e6).alias("chip_volume"), "vessel_volume", hull.alias("convex_hull_volume")), v.select("image_id", "junctions")
    m = metrics.branch_metrics(fx.lines())
    out = metrics.densities(size, m, m.filter("edge_kind = 'branch'"), junctions)
    return rounded(rounded(out.select("image_id", "convex_hull_volume", "total_vessel_length", *_RATIOS), 8, *_RATIOS), 4, "total_vessel_length")


@query("q16_z_projection", "SELECT image_id, y, x, max(value) AS top, round(avg(value), 6) AS mean FROM fld GROUP BY 1, 2, 3", "fld")
def _(fx):
    f = fx.field()
    return voxels.projection(f).withColumnRenamed("value", "top").join(rounded(voxels.projection(f, "mean"), 6, "value").withColumnRenamed("value", "mean"), ["image_id", "y", "x"])


@query("q17_projection_thicken", "SELECT DISTINCT image_id, y + a AS y, x + b AS x FROM (SELECT DISTINCT image_id, y, x FROM vox), (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b) WHERE y + a BETWEEN 0 AND 255 AND x + b BETWEEN 0 AND 255", "vox")
def _(fx):
    return voxels.thickened(fx.voxels(), SHAPE[1], SHAPE[2]).select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))


@query("q18_mask_zero_extruded", "SELECT image_id, z, count(*) AS n FROM vox ANTI JOIN msk USING (y, x) GROUP BY 1, 2", "vox", "msk")
def _(fx):
    return voxels.without_mask(fx.voxels(), fx.mask()).groupBy("image_id", "z").agg(F.count(F.lit(1)).alias("n"))


@query("q19_mask_fraction_guard", "SELECT count(*) / 1000 AS fraction, count(*) / 1000 > 0.4 AS too_large FROM msk", "msk")
def _(fx):
    return voxels.coverage_guard(fx.mask(), 1000)


@query("q20_masked_mean_fill", "+o AS (SELECT z, avg(value) AS m FROM fld ANTI JOIN msk USING (y, x) GROUP BY z) SELECT f.z, f.y, f.x, round(CASE WHEN k.y IS NOT NULL THEN m ELSE value END, 3) AS value FROM fld f LEFT JOIN msk k ON f.y = k.y AND f.x = k.x LEFT JOIN o USING (z)", "fld", "msk")
def _(fx):
    return rounded(voxels.mean_filled(fx.field(), fx.mask()).select("z", "y", "x", "value"), 3, "value")


@query("q21_border_prune", "SELECT line FROM pt GROUP BY line HAVING NOT bool_or(y < 10 OR y > 189 OR x < 10)", "pt")
def _(fx):
    return fx.lines().filter(~geometry.near_border("pts", 199, 199, 10)).select("line")


@query("q22_mask_prune", "SELECT DISTINCT line FROM pt WHERE line NOT IN (SELECT line FROM pt SEMI JOIN msk USING (y, x))", "pt", "msk")
def _(fx):
    lines = fx.lines().select("line", "pts")
    hit = lines.select("line", F.explode("pts").alias("p")).select("line", "p.y", "p.x").join(fx.mask(), ["y", "x"], "left_semi").select("line").distinct()
    return lines.join(hit, "line", "left_anti").select("line")


@query("q23_rasterise_clip", "SELECT DISTINCT least(z, 5)::INTEGER AS z, least(y, 149)::INTEGER AS y, least(x, 79)::INTEGER AS x FROM pt", "pt")
def _(fx):
    return voxels.rasterised(fx.lines().withColumn("image_id", F.lit("f")), (6, 150, 80)).select("z", "y", "x")


@query("q24_vertex_field_lookup", "SELECT line, round(2 * median(value), 4) AS diameter FROM pt JOIN fld USING (z, y, x) GROUP BY line", "pt", "fld")
def _(fx):
    return rounded(voxels.edge_diameters(fx.lines().withColumn("image_id", F.lit("f")), fx.field(), "line").select("line", "diameter"), 4, "diameter")


@query("q25_z_vote_histogram", "SELECT v.image_id, r.z::INTEGER AS z, coalesce(n.votes, 0)::BIGINT AS votes FROM (SELECT image_id, max(z) AS last FROM vot GROUP BY 1) v, LATERAL (SELECT unnest(range(0, v.last + 1)) AS z) r LEFT JOIN vot n ON n.image_id = v.image_id AND n.z = r.z", "vot")
def _(fx):
    return voxels.dense_votes(fx.votes())


_RUN = "+g AS (SELECT image_id, z, z - row_number() OVER (PARTITION BY image_id ORDER BY z) AS g FROM vot WHERE votes > {0}), r AS (SELECT image_id, min(z) AS first, max(z) AS last, count(*) AS length FROM g GROUP BY image_id, g), l AS (SELECT image_id, first, last, length FROM r QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY length DESC, first) = 1) "


@query("q26_longest_vote_run", _RUN.format(0) + "SELECT image_id, first::BIGINT AS first, last::BIGINT AS last, length FROM l", "vot")
def _(fx):
    return runs.longest_votes(fx.votes()).select("image_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "length")


@query("q27_run_extension", _RUN.format(2) + "SELECT image_id, first - least(greatest(9 - length, 0), first) AS first, last + least(greatest(9 - length, 0) - least(greatest(9 - length, 0), first), 31 - last) AS last FROM l", "vot")
def _(fx):
    return runs.extended(runs.longest_votes(fx.votes(), 2), 9, 0, 31).select("image_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query("q28_strong_run_to_um", _RUN.format(2) + "SELECT image_id, greatest(floor(first * 5.0 / 2), 0)::BIGINT AS start, least(ceil((last + 1) * 5.0 / 2), 80)::BIGINT AS stop FROM l", "vot")
def _(fx):
    start, stop = runs.to_microns(F.col("first"), F.col("last"), F.lit(0), 5.0, 80)
    return runs.longest_votes(fx.votes(), 2).select("image_id", start.alias("start"), stop.alias("stop"))


@query("q29_principal_angle", "SELECT round(0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)), 6) AS angle FROM msk", "msk")
def _(fx):
    return fx.mask().agg(F.round(geometry.principal_angle("x", "y"), 6).alias("angle"))


_PROFILE = "+p AS (SELECT floor(y / 2)::INTEGER AS bin, (max(x) - min(x) + 1)::DOUBLE AS width FROM msk GROUP BY 1), "


@query(
    "q30_width_profile_smooth_run",
    _PROFILE + "s AS (SELECT bin, width, (coalesce(lag(width, 2) OVER w, first(width) OVER f) + coalesce(lag(width) OVER w, first(width) OVER f) + width + coalesce(lead(width) OVER w, last(width) OVER f) + coalesce(lead(width, 2) OVER w, last(width) OVER f)) / 5 AS smooth FROM p WINDOW w AS (ORDER BY bin), f AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), m AS (SELECT quantile_cont(smooth, 0.5) AS m, min(bin) AS a, max(bin) AS b FROM s), g AS (SELECT bin, bin - row_number() OVER (ORDER BY bin) AS g FROM s, m WHERE smooth >= 0.82 * m), r AS (SELECT min(bin) AS first, max(bin) AS last, count(*) AS n FROM g GROUP BY g ORDER BY n DESC, first LIMIT 1) SELECT CASE WHEN n >= 0.25 * (b - a + 1) THEN first ELSE a END AS first, CASE WHEN n >= 0.25 * (b - a + 1) THEN last ELSE b END AS last FROM r, m",
    "msk",
)
def _(fx):
    p = fx.mask().groupBy(F.lit("m").alias("image_id"), F.floor(F.col("y") / 2).cast("int").alias("bin")).agg((F.max("x") - F.min("x") + 1).cast("double").alias("width"))
    return runs.wide_run(runs.moving_average(p, "width", "bin", ["image_id"]), "smooth", "bin", ["image_id"]).select("first", "last")


@query("q31_focus_plane_lsq")
def _(fx):
    t = fx.table("events").selectExpr("event_type AS image_id", "user_id % 10 AS x", "cast(user_id / 10 AS int) % 10 AS y", "cast(day(ts) AS double) AS z")
    return volume.focus_surface(t)


@query("q32_leaf_peel_fixpoint")
def _(fx):
    e = fx.edges().withColumn("removable", F.col("weight") <= 1.5)
    return graph.peeled(e, "removable").select("image_id", "u", "v", "weight")


@query("q33_contract_degree2")
def _(fx):
    return graph.contracted(fx.edges())


@query("q34_branch_only_graph")
def _(fx):
    return graph.branch_only(fx.edges())


@query("q34a_sprouts_removed", "SELECT e.image_id, e.u, e.v FROM edg e JOIN deg a ON a.image_id = e.image_id AND a.node_id = e.u JOIN deg b ON b.image_id = e.image_id AND b.node_id = e.v WHERE a.degree > 1 AND b.degree > 1", "deg")
def _(fx):
    return graph.without_sprouts(fx.edges()).select("image_id", "u", "v")


@query("q35_connected_components", "+both_ways AS (SELECT u AS a, v AS b FROM edg UNION SELECT v, u FROM edg), reach AS (SELECT a AS node, a AS root FROM both_ways UNION SELECT w.b, r.root FROM reach r JOIN both_ways w ON w.a = r.node) SELECT n.image_id, n.node_id, min(r.root) AS component FROM deg n JOIN reach r ON r.node = n.node_id GROUP BY 1, 2", "deg")
def _(fx):
    return graph.labelled(fx.edges())


_NN = "+d AS (SELECT a.image_id, a.node_id, a.degree, a.sprout, b.sprout AS other, 2 * sqrt((a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS dist FROM nod a JOIN nod b ON a.image_id = b.image_id AND a.node_id <> b.node_id), j AS (SELECT image_id, node_id, degree, sprout, min(dist) FILTER (NOT other) AS dj, min(dist) FILTER (other) AS de, count(*) FILTER (NOT other AND dist <= 500) AS nj, count(*) FILTER (other AND dist <= 500) AS ne FROM d GROUP BY ALL) "


@query("q36_junction_nn_euclid", _NN + "SELECT image_id, node_id, round(dj, 5) AS dist_nearest_junction, round(de, 5) AS dist_nearest_endpoint FROM j", "nod")
def _(fx):
    return rounded(graph.neighbours(fx.nodes()).select("image_id", "node_id", "dist_nearest_junction", "dist_nearest_endpoint"), 5, "dist_nearest_junction", "dist_nearest_endpoint")


@query("q37_neighbour_counts_500", _NN + "SELECT image_id, node_id, sprout AS is_sprout_tip, NOT sprout AS is_junction, degree, nj AS num_junction_neighbors, ne AS num_endpoint_neighbors FROM j", "nod")
def _(fx):
    return metrics.junction_table(graph.neighbours(fx.nodes())).select("image_id", "node_id", "is_sprout_tip", "is_junction", "degree", "num_junction_neighbors", "num_endpoint_neighbors")


@query("q38_skeleton_nn")
def _(fx):
    return graph.along_skeleton(fx.edges(), fx.nodes())


@query("q39_headline_summary", _NN + "SELECT image_id, round(median(dj) FILTER (NOT sprout), 5) AS junctions, round(median(de) FILTER (sprout), 5) AS tips, round(quantile_cont(de, 0.9) FILTER (sprout) - quantile_cont(de, 0.1) FILTER (sprout), 5) AS tip_spread FROM j GROUP BY 1", "nod")
def _(fx):
    n = graph.neighbours(fx.nodes()).withColumn("own", F.when(F.col("sprout"), F.col("dist_nearest_endpoint")).otherwise(F.col("dist_nearest_junction")))
    p = metrics.panel(metrics.headline(n, "own", "euclidean"), ["median_junction_euclidean_dist_nearest_junction", "median_sprout_euclidean_dist_nearest_endpoint", "spread_sprout_euclidean_dist_nearest_endpoint"])
    return rounded(p.toDF("image_id", "junctions", "tips", "tip_spread"), 5, "junctions", "tips", "tip_spread")


@query("q40_average_vessel_volume", "SELECT image_id, round(avg(branch_volume), 1) AS average_vessel_volume FROM met GROUP BY 1", "met")
def _(fx):
    return metrics.branch_metrics(fx.lines()).groupBy("image_id").agg(F.round(F.avg("branch_volume"), 1).alias("average_vessel_volume"))


@query("q41_condition_label", "SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%small%' THEN 'small' WHEN lower(p_name) LIKE '%large%' THEN 'large' ELSE 'NA' END AS condition FROM part")
def _(fx):
    return fx.table("part").select("p_partkey", labels.by_keywords("p_name", [(("small",), "small"), (("large",), "large")]).alias("condition"))


@query("q42_mask_mode", "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'dark' WHEN lower(p_name) LIKE '%small%' AND lower(p_name) LIKE '%red%' THEN 'light' WHEN lower(p_name) LIKE '%small%' THEN 'dark' END AS mode FROM part")
def _(fx):
    p = fx.table("part")
    as_named = F.regexp_replace(F.regexp_replace(F.lower("p_name"), "small", "marina"), "red", "bead")
    return p.select("p_partkey", labels.mask_mode(as_named, F.lit(""), F.lit("dark"), F.col("p_size") % 7 == 0).alias("mode"))


@query("q43_output_name_skip_antijoin", "SELECT 'run' || doc_id || '_' || source || '_img' || (doc_id % 3) AS name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(fx):
    d = fx.table("documents").select(F.format_string("/in/run%d.lif", "doc_id").alias("file_path"), F.col("source").alias("image_name"), (F.col("doc_id") % 3).cast("int").alias("image_index"))
    done = jobs.named(fx.table("labels").join(fx.table("documents").select("doc_id", "source"), "doc_id").select(F.format_string("/in/run%d.lif", "doc_id").alias("file_path"), F.col("source").alias("image_name"), (F.col("doc_id") % 3).cast("int").alias("image_index")))
    return jobs.pending(d, done).select("name")


@query("q44_union_missing_cols", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def _(fx):
    a = fx.table("customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment")
    return cohort.union_all([a, fx.table("supplier").selectExpr("s_suppkey AS id", "s_name AS name")])


@query("q45_drop_allnull_dropna", "SELECT image_name, f1, f2 FROM fea WHERE image_name % 5 <> 0", "fea")
def _(fx):
    f = fx.features(2).withColumn("f1", F.when(F.col("image_name") % 5 != 0, F.col("f1"))).withColumn("none", F.lit(None).cast("double"))
    return cohort.complete(f, ["f1", "f2", "none"]).select("image_name", "f1", "f2")


_FEATURES = [f"f{i}" for i in range(1, 9)]


def _long(fx) -> DataFrame:
    return cohort.long(fx.features(), ["image_name", "experiment"], _FEATURES)


@query("q46_zscore", "SELECT image_name, feature, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 5) AS z FROM flong WINDOW w AS (PARTITION BY feature)", "flong")
def _(fx):
    return rounded(cohort.standardised(_long(fx)).select("image_name", "feature", "z"), 5, "z")


@query("q47_pca_scores")
def _(fx):
    return cohort.pca(fx.features(), ["image_name", "experiment"], _FEATURES)[0]


@query("q47a_pca_importance")
def _(fx):
    _, loadings, shares = cohort.pca(fx.features(), ["image_name"], _FEATURES)
    rows = [(f, float(a), float(loadings[0][i]), float(loadings[1][i])) for i, (f, a) in enumerate(zip(_FEATURES, cohort.importance(loadings, shares, 10), strict=True))]
    return fx.spark.createDataFrame(rows, "feature string, importance double, pc1 double, pc2 double")


@query("q48_group_deviation_argmax", "+m AS (SELECT feature, experiment, avg(value) AS g FROM flong GROUP BY 1, 2), o AS (SELECT feature, avg(value) AS a FROM flong GROUP BY 1) SELECT feature, experiment, round(abs(g - a), 5) AS deviation FROM m JOIN o USING (feature) QUALIFY row_number() OVER (PARTITION BY feature ORDER BY abs(g - a) DESC, experiment) = 1", "flong")
def _(fx):
    return rounded(cohort.deviations(_long(fx), "experiment"), 5, "deviation")


@query("q49_mann_whitney_u", "+r AS (SELECT feature, experiment, rank() OVER w + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS r FROM flong WHERE experiment IN (0, 1) WINDOW w AS (PARTITION BY feature ORDER BY value)) SELECT feature, count(*) FILTER (experiment = 0) AS n1, count(*) FILTER (experiment = 1) AS n2, sum(r) FILTER (experiment = 0) - count(*) FILTER (experiment = 0) * (count(*) FILTER (experiment = 0) + 1) / 2 AS u FROM r GROUP BY 1", "flong")
def _(fx):
    return cohort.mann_whitney(_long(fx), "experiment", 0, 1).select("feature", "n1", "n2", F.col("u").cast("double").alias("u"))


@query("q50_kruskal_h", "+r AS (SELECT feature, experiment, rank() OVER w + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS r FROM flong WINDOW w AS (PARTITION BY feature ORDER BY value)), s AS (SELECT feature, experiment, sum(r) AS s, count(*) AS n FROM r GROUP BY 1, 2), t AS (SELECT feature, sum(c * c * c - c) AS t FROM (SELECT feature, value, count(*)::DOUBLE AS c FROM flong GROUP BY 1, 2) GROUP BY 1), h AS (SELECT feature, sum(n)::DOUBLE AS n, sum(s * s / n) AS q FROM s GROUP BY 1) SELECT feature, n::BIGINT AS n, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n ** 3 - n)), 4) AS h FROM h JOIN t USING (feature)", "flong")
def _(fx):
    return rounded(cohort.kruskal(_long(fx), "experiment").select("feature", "n", "h"), 4, "h")


@query("q51_top_discriminating")
def _(fx):
    return cohort.significant(cohort.kruskal(_long(fx), "experiment"), "p")


@query("q63_class_orientation", "+m AS (SELECT experiment, avg(f1) AS m FROM fea GROUP BY 1) SELECT arg_max(experiment, struct_pack(a := m, b := -experiment)) AS high, arg_min(experiment, struct_pack(a := m, b := experiment)) AS low FROM m", "fea")
def _(fx):
    return cohort.oriented(fx.features(1).withColumnRenamed("f1", "pc1"), "experiment")


@query("q64_top_by_score", "+r AS (SELECT feature, abs(avg(value)) AS importance, 1 / (1 + sum(value * value)) AS p FROM flong GROUP BY 1) SELECT feature, round(importance, 6) AS importance, round(p, 9) AS p, round(importance * -log10(p), 5) AS score, row_number() OVER (ORDER BY round(importance * -log10(p), 9) DESC, feature) AS rank FROM r QUALIFY rank <= 5", "flong")
def _(fx):
    t = _long(fx).groupBy("feature").agg(F.abs(F.avg("value")).alias("importance"), (1 / (1 + F.sum(F.col("value") * F.col("value")))).alias("p"))
    return rounded(rounded(rounded(cohort.ranked(cohort.scored(t, "importance", "p"), "score", 5), 6, "importance"), 9, "p"), 5, "score")


@query("q65_named_conditions", "SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%small%' AND lower(p_name) LIKE '%red%' THEN 'a' WHEN lower(p_name) LIKE '%small%' OR lower(p_name) LIKE '%tiny%' THEN 'b' ELSE 'NA' END AS condition FROM part")
def _(fx):
    return fx.table("part").select("p_partkey", labels.by_keywords("p_name", [(("small", "red"), "a"), (("small",), "b"), (("tiny",), "b")]).alias("condition"))


@query(
    "q52_kde_by_length",
    "+k AS (SELECT image_id AS i, edge_kind AS g, orientation_to_device_axis AS v, path_length AS w FROM met WHERE orientation_to_device_axis IS NOT NULL AND path_length > 0), m AS (SELECT i, g, sum(w) AS tw, sum(w * v) / sum(w) AS mean, sum(w * w) AS w2 FROM k GROUP BY 1, 2 HAVING count(*) >= 2), h AS (SELECT i, g, 0.3 * sqrt(sum(w / tw * (v - mean) ** 2) / (1 - any_value(w2) / any_value(tw) ** 2)) AS h FROM k JOIN m USING (i, g) GROUP BY 1, 2), c AS (SELECT i, g, s, sum(w / tw * exp(-0.5 * ((s * 90.0 / 39 - v) / h) ** 2)) AS d FROM k JOIN m USING (i, g) JOIN h USING (i, g), (SELECT unnest(range(0, 40)) AS s) GROUP BY 1, 2, 3) SELECT g AS edge_kind, s::INTEGER AS i, round(avg(d / t), 6) AS density FROM c JOIN (SELECT i, g, sum(d) AS t FROM c GROUP BY 1, 2) USING (i, g) GROUP BY 1, 2",
    "met",
)
def _(fx):
    return rounded(cohort.density(metrics.branch_metrics(fx.lines()), "orientation_to_device_axis", "path_length", "image_id", "edge_kind", 40), 6, "density")


@query("q53_compare_outputs", "SELECT line, path_length * CASE WHEN line % 10 = 0 THEN 1.001 ELSE 1 END - path_length <= 1e-6 + 1e-4 * path_length * CASE WHEN line % 10 = 0 THEN 1.001 ELSE 1 END AS ok FROM met", "met")
def _(fx):
    a = metrics.branch_metrics(fx.lines()).select(F.col("node_start").alias("line"), "path_length")
    b = a.withColumn("path_length", F.col("path_length") * F.when(F.col("line") % 10 == 0, 1.001).otherwise(1.0))
    return cohort.compared(a, b, ["line"], ["path_length"]).select("line", "ok")


@query("q54_boxplot_stats", "+c AS (SELECT r_name AS experiment, path_length AS v FROM met JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey) SELECT experiment, round(quantile_cont(v, 0.25), 5) AS q1, round(median(v), 5) AS median, round(quantile_cont(v, 0.75), 5) AS q3 FROM c GROUP BY 1", "met")
def _(fx):
    place = fx.table("nation").join(fx.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("experiment"))
    m = fx.lines().select("c_nationkey", geometry.path_length("pts").alias("v")).join(F.broadcast(place), "c_nationkey")  # 25 nations
    return rounded(m.groupBy("experiment").agg(*stats.box_statistics("v")).select("experiment", "q1", "median", "q3"), 5, "q1", "median", "q3")


@query("q55_minmax_scale", "SELECT z, y, x, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS scaled FROM fld", "fld")
def _(fx):
    return rounded(voxels.min_max_scaled(fx.field()).select("z", "y", "x", "scaled"), 6, "scaled")


@query("q56_junction_points_rounded", "+e AS (SELECT image_id, 2.0 * unnest([min_by(z, pos), max_by(z, pos)]) AS z, 2.0 * unnest([min_by(y, pos), max_by(y, pos)]) AS y, 2.0 * unnest([min_by(x, pos), max_by(x, pos)]) AS x FROM pt JOIN att USING (line) WHERE edge_kind = 'branch' GROUP BY image_id, line) SELECT image_id, z::DOUBLE AS z, y::DOUBLE AS y, x::DOUBLE AS x, count(*) AS n FROM e GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2", "pt", "att")
def _(fx):
    return metrics.junction_points(metrics.branch_metrics(fx.lines()))


@query("q57_corner_order", "SELECT n_nationkey, (n_nationkey)::DOUBLE AS x0, (2 * n_nationkey)::DOUBLE AS y0, (n_nationkey + 10)::DOUBLE AS x2, (2 * n_nationkey + 5)::DOUBLE AS y2, (n_nationkey - 1)::DOUBLE AS ex, (2 * n_nationkey - 2)::DOUBLE AS ey FROM nation")
def _(fx):
    k = F.col("n_nationkey").cast("double")
    point = lambda dx, dy: F.struct((k + dx).alias("x"), (2 * k + dy).alias("y"))
    t = fx.table("nation").select("n_nationkey", geometry.ordered_corners(F.array(point(10, 5), point(0, 0), point(0, 5), point(10, 0))).alias("c"))
    t = t.withColumn("e", geometry.expanded("c", 1.0, 2.0))
    return t.select("n_nationkey", F.expr("c[0].x AS x0"), F.expr("c[0].y AS y0"), F.expr("c[2].x AS x2"), F.expr("c[2].y AS y2"), F.expr("e[0].x AS ex"), F.expr("e[0].y AS ey"))


@query("q58_hysteresis_keep", "+p AS (SELECT y, x, max(value) AS value FROM fld GROUP BY 1, 2), w AS (SELECT * FROM p WHERE value > 60000), k AS (SELECT y, x FROM w WHERE value > 90000 UNION SELECT w.y, w.x FROM k JOIN w ON abs(w.y - k.y) <= 1 AND abs(w.x - k.x) <= 1) SELECT 0 AS image_no, y, x FROM k", "fld")
def _(fx):
    f = voxels.projection(fx.field()).select(F.lit(0).alias("image_no"), "y", "x", "value")
    return graph.hysteresis(f, 60_000, 90_000, 100, 200 * 100)


@query("q59_ledger_counts", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'OK' END AS status, count(*) AS n FROM orders GROUP BY 1")
def _(fx):
    return jobs.ledger_counts(fx.table("orders").select(F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("OK").alias("status")))


@query("q60_hull_volume")
def _(fx):
    return volume.hulls(fx.voxels())


@query("q61_windowed_events", "SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(fx):
    e = fx.table("events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select("event_type", F.col("w.start").alias("day"), "n", "total")


#: Several tiles and windows to a test volume.
TILE, WINDOW, SHARE = (4, 48, 48), (4, 32, 32), (0.5, 0.25, 0.25)


@query("q66_tiled_smooth_fill")
def _(fx):
    t = tiles.filled(tiles.smoothed(tiles.from_voxels(fx.solid(), SOLID, TILE), 0.7, TILE), TILE)
    return tiles.voxels(t).groupBy("image_id", "z", "y").agg(F.count(F.lit(1)).alias("n"))


@query("q67_tiled_components")
def _(fx):
    t = tiles.labelled(tiles.from_voxels(fx.solid(), SOLID, TILE), False, TILE)
    return tiles.voxels(t).groupBy("image_id", F.col("value").cast("long").alias("component")).agg(F.count(F.lit(1)).alias("voxels"))


def contrast():
    """A stand-in for a trained model: what is brighter than the window's mean, and the more so the nearer to its end."""
    import numpy as np

    return lambda a: np.clip((a - a.mean()) / 1e5 + 0.5 * np.arange(a.size).reshape(a.shape) / a.size, 0, 1)


@query("q68_blended_windows")
def _(fx):
    t = tiles.from_voxels(fx.stack(), STACK, (3, 24, 24), "value")
    t = tiles.blended(t, "contrast", contrast, WINDOW, SHARE, "gaussian", 2, 0.0, (3, 24, 24))
    return tiles.voxels(t).select("image_id", "z", "y", "x", F.round("value", 9).alias("value"))


@query("q69_refocused_stack")
def _(fx):
    planes = stored(tiles.from_voxels(fx.stack(), STACK, (1, *STACK[1:]), "value"), "planes")
    return tiles.voxels(focus.refocused(planes, focus.surfaces(planes, 5, 12)))


@query("q70_tiled_skeletons")
def _(fx):
    return analysis.tiled_skeletons(fx.solid(), SOLID, None, sigma=0.7, tile=TILE).select("image_id", "z", "y", "x", "in_skeleton", F.round("area", 6).alias("area"))


@query("q71_hull_cells")
def _(fx):
    return volume.hull_cells(fx.solid()).groupBy("image_id", "z", "y").agg(F.count(F.lit(1)).alias("n"))


@query("q72_crop_without_necks")
def _(fx):
    p = fx.table("part").selectExpr("cast(p_partkey % 3 AS string) AS image_id", "cast(p_partkey % 97 AS int) AS y", "p_size + cast(p_partkey % 97 / 3 AS int) AS x").distinct()
    found = crop.without_necks(p).select("image_id", "angle", F.posexplode("corners").alias("corner", "p"))
    return rounded(found.select("image_id", "angle", "corner", "p.x", "p.y"), 6, "angle", "x", "y")
