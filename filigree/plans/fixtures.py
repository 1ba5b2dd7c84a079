"""Views over the test tables that imitate the engine's inputs: as DataFrames, and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHAPE = (8, 256, 256)
SOLID = (8, 128, 128)
STACK = (7, 48, 40)


class Fixtures:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def voxels(self) -> DataFrame:
        t = self.table("lineitem").filter("l_quantity <= 10")
        return t.selectExpr("l_returnflag AS image_id", "l_linenumber AS z", "cast(l_partkey % 256 AS int) AS y", "cast(l_orderkey % 256 AS int) AS x").distinct()

    def solid(self) -> DataFrame:
        """Voxels of all items, in volumes of SOLID."""
        return self.table("lineitem").selectExpr("l_returnflag AS image_id", "l_linenumber AS z", "cast(l_partkey % 128 AS int) AS y", "cast(l_orderkey % 128 AS int) AS x")

    def stack(self) -> DataFrame:
        """Intensities of all items, in stacks of STACK."""
        t = self.table("lineitem").selectExpr("l_returnflag AS image_id", "l_linenumber - 1 AS z", "cast(l_partkey % 48 AS int) AS y", "cast(l_orderkey % 40 AS int) AS x", "l_extendedprice AS v")
        return t.groupBy("image_id", "z", "y", "x").agg(F.round(F.avg("v"), 3).alias("value"))

    def edges(self) -> DataFrame:
        t = self.table("lineitem").filter("l_quantity <= 2")
        return t.groupBy(F.expr("cast(l_partkey % 2 AS string)").alias("image_id"), F.col("l_partkey").alias("u"), (F.col("l_orderkey") + 1000000).alias("v")).agg((F.min("l_extendedprice") / 1000).alias("weight"))

    def nodes(self) -> DataFrame:
        from filigree.operators.graph import degrees

        return degrees(self.edges()).selectExpr("image_id", "node_id", "cast(node_id % 41 AS int) AS z", "cast(7 * node_id % 211 AS int) AS y", "cast(13 * node_id % 307 AS int) AS x", "degree", "degree = 1 AS sprout")

    def lines(self) -> DataFrame:
        """Polylines: an order's items by line number, with their kind and image."""
        t = self.table("lineitem").selectExpr("l_orderkey AS line", "struct(l_linenumber AS z, l_partkey AS a, l_suppkey AS b, l_extendedprice AS area) AS p")
        t = t.groupBy("line").agg(F.array_sort(F.collect_list("p")).alias("p")).filter(F.size("p") >= 2)
        t = t.select(
            "line", F.transform("p", lambda q: F.struct(q["z"].alias("z"), (q["a"] % 200).cast("int").alias("y"), (q["b"] % 100).cast("int").alias("x"))).alias("pts"),
            F.transform("p", lambda q: q["area"]).alias("areas"),
        )
        o = self.table("orders").selectExpr("o_orderkey AS line", "o_custkey AS c_custkey", "CASE o_orderstatus WHEN 'F' THEN 'branch' WHEN 'O' THEN 'attached_sprout' ELSE 'floating_sprout' END AS edge_kind")
        c = self.table("customer").selectExpr("c_custkey", "c_mktsegment AS image_id", "c_nationkey")
        return t.join(o, "line").join(c, "c_custkey").selectExpr("image_id", "line", "line AS u", "line + 1 AS v", "edge_kind", "pts", "areas", "c_custkey", "c_nationkey")

    def field(self) -> DataFrame:
        t = self.table("lineitem").selectExpr("'f' AS image_id", "l_linenumber AS z", "cast(l_partkey % 200 AS int) AS y", "cast(l_suppkey % 100 AS int) AS x", "l_extendedprice AS v")
        return t.groupBy("image_id", "z", "y", "x").agg(F.round(F.avg("v"), 4).alias("value"))

    def mask(self) -> DataFrame:
        return self.table("part").filter("p_size <= 5").selectExpr("cast(p_partkey % 200 AS int) AS y", "p_size AS x").distinct()

    def votes(self) -> DataFrame:
        from filigree.operators.voxels import focus_votes

        t = self.table("events").selectExpr("event_type AS image_id", "user_id % 100 AS patch", "day(ts) AS z", "value")
        return focus_votes(t.groupBy("image_id", "patch", "z").agg(F.max("value").alias("focus")))

    def features(self, n: int = 8) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("image_name"), F.col("label").alias("experiment"), *(F.get("embedding", F.lit(i)).cast("double").alias(f"f{i + 1}") for i in range(n)))


#: The same views as SQL, by name, with what each needs before it.
SQL = {
    "vox": ("", "SELECT DISTINCT l_returnflag AS image_id, l_linenumber AS z, l_partkey % 256 AS y, l_orderkey % 256 AS x FROM lineitem WHERE l_quantity <= 10"),
    "edg": ("", "SELECT (l_partkey % 2)::VARCHAR AS image_id, l_partkey AS u, 1000000 + l_orderkey AS v, min(l_extendedprice) / 1000 AS weight FROM lineitem WHERE l_quantity <= 2 GROUP BY 1, 2, 3"),
    "deg": ("edg", "SELECT image_id, n AS node_id, count(*) AS degree FROM (SELECT image_id, unnest([u, v]) AS n FROM edg) GROUP BY 1, 2"),
    "nod": ("deg", "SELECT image_id, node_id, node_id % 41 AS z, (7 * node_id) % 211 AS y, (13 * node_id) % 307 AS x, degree, degree = 1 AS sprout FROM deg"),
    "knd": ("deg", "SELECT e.*, CASE WHEN a.degree = 1 AND b.degree = 1 THEN 'floating_sprout' WHEN a.degree = 1 OR b.degree = 1 THEN 'attached_sprout' ELSE 'branch' END AS edge_kind FROM edg e JOIN deg a ON a.image_id = e.image_id AND a.node_id = e.u JOIN deg b ON b.image_id = e.image_id AND b.node_id = e.v"),
    "pt": ("", "SELECT * FROM (SELECT l_orderkey AS line, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n, l_linenumber AS z, l_partkey % 200 AS y, l_suppkey % 100 AS x, l_extendedprice AS area FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)) WHERE n >= 2"),
    "att": ("", "SELECT o_orderkey AS line, c_custkey, c_nationkey, c_mktsegment AS image_id, CASE o_orderstatus WHEN 'F' THEN 'branch' WHEN 'O' THEN 'attached_sprout' ELSE 'floating_sprout' END AS edge_kind FROM orders JOIN customer ON o_custkey = c_custkey"),
    "seg": ("pt", "SELECT *, 2 * sqrt((lead(z) OVER w - z) ** 2 + (lead(y) OVER w - y) ** 2 + (lead(x) OVER w - x) ** 2) AS step FROM pt WINDOW w AS (PARTITION BY line ORDER BY pos)"),
    "met": ("seg,att", """SELECT image_id, line, edge_kind, path_length, chord AS endpoint_distance, greatest(1.0, least(50.0, path_length / (chord + 1e-8))) AS tortuosity,
        mean_cs_area, median_cs_area, std_cs_area, mean_width, median_width, mean_cs_area * path_length AS branch_volume,
        CASE WHEN 2 * sqrt(dx * dx + dy * dy) > 1e-8 THEN degrees(acos(least(1.0, abs(dx) / sqrt(dx * dx + dy * dy)))) END AS orientation_to_device_axis, c_nationkey
        FROM (SELECT line, sum(step) AS path_length, 2 * sqrt((max_by(z, pos) - min_by(z, pos)) ** 2 + (max_by(y, pos) - min_by(y, pos)) ** 2 + (max_by(x, pos) - min_by(x, pos)) ** 2) AS chord,
        avg(area) AS mean_cs_area, median(area) AS median_cs_area, stddev_pop(area) AS std_cs_area, avg(sqrt(4 * area / pi())) AS mean_width, median(sqrt(4 * area / pi())) AS median_width,
        (max_by(x, pos) - min_by(x, pos))::DOUBLE AS dx, (max_by(y, pos) - min_by(y, pos))::DOUBLE AS dy FROM seg GROUP BY line) JOIN att USING (line)"""),
    "fld": ("", "SELECT 'f' AS image_id, l_linenumber AS z, (l_partkey % 200)::INTEGER AS y, (l_suppkey % 100)::INTEGER AS x, round(avg(l_extendedprice), 4) AS value FROM lineitem GROUP BY 1, 2, 3, 4"),
    "msk": ("", "SELECT DISTINCT p_partkey % 200 AS y, p_size AS x FROM part WHERE p_size <= 5"),
    "vot": ("", "SELECT image_id, z, count(*) AS votes FROM (SELECT image_id, patch, arg_min(z, struct_pack(a := -focus, b := z)) AS z FROM (SELECT event_type AS image_id, user_id % 100 AS patch, day(ts) AS z, max(value) AS focus FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1, 2"),
    "fea": ("", "SELECT vec_id AS image_name, label AS experiment, " + ", ".join(f"embedding[{i}]::DOUBLE AS f{i}" for i in range(1, 9)) + " FROM embeddings"),
    "flong": ("fea", "SELECT image_name, experiment, feature, value FROM fea UNPIVOT (value FOR feature IN (f1, f2, f3, f4, f5, f6, f7, f8))"),
}


def with_views(query: str, *names: str) -> str:
    """The query after the views that it names, each once and after those that it needs."""
    done: list[str] = []

    def need(name: str) -> None:
        for x in filter(None, SQL[name][0].split(",")):
            need(x)
        if name not in done:
            done.append(name)

    for name in names:
        need(name)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n][1]})" for n in done) + ("," if query.lstrip().startswith("+") else " ") + query.lstrip().lstrip("+")
