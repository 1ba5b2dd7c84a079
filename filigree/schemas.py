"""Tables of the engine: names and types of their columns. Absent values are NULL inside, NaN only at CSV sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

#: Schemas are DDL strings: parsing them takes a session.
POINTS = "array<struct<z:int,y:int,x:int>>"
JOBS = "file_path string, image_index int, mask_mode string, image_name string"
CURATED_JOBS = "file_path string, image_index int, mask_mode string, image_name string, status string, inner_corners array<struct<x:double,y:double>>"
CHUNKS = "image_id string, cz int, cy int, cx int, origin array<int>, shape array<int>, dtype string, data binary"
VOXELS = "image_id string, z int, y int, x int"
FIELD = "image_id string, z int, y int, x int, value double"
MASK_2D = "image_id string, y int, x int"
Z_VOTES = "image_id string, z int, votes int"
VOXEL_SIZE = "z_um double, y_um double, x_um double, xy_um double"
NODES = "image_id string, node_id long, z int, y int, x int, sprout boolean"
EDGES = f"image_id string, u long, v long, weight double, pts {POINTS}"
LEDGER = "name string, status string, message string"
FAILURES = "image string, category string, body string"

#: Column and metric names of the result tables, in their order.
BRANCH_METRICS = (
    "node_start node_end edge_kind start_z_idx start_y_idx start_x_idx end_z_idx end_y_idx end_x_idx "
    "start_z start_y start_x end_z end_y end_x path_length endpoint_distance tortuosity "
    "mean_cs_area median_cs_area std_cs_area mean_width median_width branch_volume orientation_to_device_axis"
).split()
JUNCTION_METRICS = (
    "node_id z y x degree is_sprout_tip is_junction dist_nearest_junction dist_nearest_endpoint num_junction_neighbors num_endpoint_neighbors"
).split()
EDGE_ALIASES = {
    "volume": "branch_volume", "length": "path_length", "endpoint_distance": "endpoint_distance", "tortuosity": "tortuosity",
    "mean_cs_area": "mean_cs_area", "median_cs_area": "median_cs_area", "std_cs_area": "std_cs_area",
    "mean_width": "mean_width", "median_width": "median_width", "orientation": "orientation_to_device_axis",
}
NODE_METRICS = ("degree", "dist_nearest_junction", "dist_nearest_endpoint", "num_junction_neighbors", "num_endpoint_neighbors")
GLOBAL_METRICS = (
    "chip_volume convex_hull_volume vessel_volume vessel_volume_fraction total_vessel_length branch_length_per_volume "
    "attached_sprouts_per_vessel_length junctions_per_vessel_length skeleton_fractal_dimension skeleton_lacunarity "
    "average_vessel_volume attached_sprouts_per_volume junctions_per_volume branches_per_volume floating_sprouts_per_volume "
    "median_junction_skeleton_dist_nearest_junction spread_junction_skeleton_dist_nearest_junction "
    "median_sprout_skeleton_dist_nearest_endpoint spread_sprout_skeleton_dist_nearest_endpoint "
    "median_junction_euclidean_dist_nearest_junction spread_junction_euclidean_dist_nearest_junction "
    "median_sprout_euclidean_dist_nearest_endpoint spread_sprout_euclidean_dist_nearest_endpoint"
).split()
CURATED_PANEL = (
    "vessel_volume_fraction branch_length_per_volume attached_sprouts_per_volume junctions_per_volume branches_per_volume "
    "skeleton_fractal_dimension skeleton_lacunarity median_branch_length spread_branch_length median_branch_median_cs_area "
    "spread_branch_median_cs_area median_branch_tortuosity spread_branch_tortuosity median_branch_only_junction_degree "
    "spread_branch_only_junction_degree median_sprout_and_branch_orientation spread_sprout_and_branch_orientation floating_sprouts_per_volume"
).split()
AGGREGATES = ("mean", "std", "median", "spread")
EDGE_SUBSETS = ("branch", "attached_sprout", "floating_sprout", "sprout_and_branch")
NODE_SUBSETS = ("junction", "sprout_tip", "all_nodes")


def panel_columns() -> list[str]:
    """The wide panel: globals, then aggregates of edge and node metrics by subset."""
    edges = [f"{a}_{s}_{m}" for s in EDGE_SUBSETS for m in EDGE_ALIASES for a in AGGREGATES]
    nodes = [f"{a}_{s}_{m}" for s in (*NODE_SUBSETS, "branch_only_junction") for m in NODE_METRICS for a in AGGREGATES]
    return [*GLOBAL_METRICS, *edges, *nodes]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN values of top-level columns become NULL, so that aggregates skip them."""
    kinds = (DoubleType, FloatType)
    return df.select(*(F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema))


def null_to_nan(df: DataFrame) -> DataFrame:
    kinds = (DoubleType, FloatType)
    return df.select(*(F.coalesce(f.name, F.lit(float("nan")).cast(f.dataType)).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema))
