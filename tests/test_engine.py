"""The engine's operators on hand-made inputs with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from filigree import schemas
from filigree.functions import geometry, labels, stats
from filigree.operators import cohort, device, graph, metrics, runs, volume, voxels
from filigree.sources import images, jobs, tables

EDGES = "image_id string, u long, v long, weight double"
PATH = [("p", 1, 2, 1.0), ("p", 2, 3, 1.0), ("p", 3, 4, 1.0)]
STAR = [("s", 10, 11 + i, 2.0) for i in range(5)]
TRIANGLE = [("t", 20, 21, 1.0), ("t", 21, 22, 1.0), ("t", 20, 22, 1.0)]
CHAINS = [("c", 30, 31, 1.0), ("c", 31, 33, 1.0), ("c", 30, 32, 1.0), ("c", 32, 33, 1.0), ("c", 30, 40, 1.0), ("c", 33, 41, 1.0)]
PAIR = [("f", 50, 51, 3.0)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([*PATH, *STAR, *TRIANGLE, *CHAINS, *PAIR], EDGES)


def test_kinds_and_degrees(edges):
    found = {(r["u"], r["v"]): r["edge_kind"] for r in graph.kinds(edges).collect()}
    assert found[50, 51] == "floating_sprout" and found[1, 2] == "attached_sprout" and found[2, 3] == "branch"
    degree = {r["node_id"]: r["degree"] for r in graph.degrees(edges).collect()}
    assert degree[10] == 5 and sum(degree.values()) == 2 * edges.count()


def test_contraction(edges):
    found = {(r["image_id"], r["u"], r["v"]): (r["weight"], r["merged"]) for r in graph.contracted(edges).collect()}
    assert found["p", 1, 4] == (3.0, 3)
    assert sum(k[0] == "t" for k in found) == 3  # a triangle stays: its ends are neighbours already
    assert found["c", 30, 33] == (2.0, 2) and sum(k[0] == "c" for k in found) == 5  # the second chain keeps its middle
    assert sum(k[0] == "s" for k in found) == 5


def test_peeling_runs_to_its_end(edges):
    left = {(r["u"], r["v"]) for r in graph.peeled(edges.withColumn("go", F.col("weight") < 2), "go").select("u", "v").collect()}
    assert left == {(u, v) for _, u, v, _ in [*STAR, *TRIANGLE, *PAIR]} | {(30, 31), (31, 33), (30, 32), (32, 33)}


def test_components_and_branch_only(edges):
    found = {r["node_id"]: r["component"] for r in graph.labelled(edges).collect()}
    assert found[4] == 1 and found[41] == 30 and found[51] == 50
    assert {r["image_id"] for r in graph.branch_only(edges).collect()} == {"p", "t", "c"}


def test_distances(spark, edges):
    nodes = spark.createDataFrame([("p", i, 0, 0, 3 * i, 1 if i in (1, 4) else 2, i in (1, 4)) for i in range(1, 5)], "image_id string, node_id long, z int, y int, x int, degree long, sprout boolean")
    near = {r["node_id"]: r for r in graph.neighbours(nodes, radius=7.0).collect()}
    assert near[1]["dist_nearest_junction"] == 6 and near[1]["dist_nearest_endpoint"] == 18 and near[1]["num_junction_neighbors"] == 1
    along = {r["node_id"]: r["distance"] for r in graph.along_skeleton(edges, nodes).filter("image_id = 'p'").collect()}
    assert along == {1: 3.0, 4: 3.0, 2: 1.0, 3: 1.0}
    one = graph.neighbours(nodes.filter("node_id = 1")).collect()[0]
    assert one["dist_nearest_junction"] is None and one["num_endpoint_neighbors"] == 0


def test_polylines(spark):
    straight = [{"z": 0, "y": 0, "x": i} for i in range(4)]
    closed = [{"z": 0, "y": 0, "x": 0}, {"z": 0, "y": 9, "x": 0}, {"z": 0, "y": 0, "x": 0}]
    rows = [("a", 1, 2, "branch", straight, [1.0, None, 3.0, float("nan")]), ("a", 3, 4, "branch", closed, [1.0, 1.0, 1.0]), ("a", 5, 6, "branch", straight[:1], [1.0])]
    out = metrics.branch_metrics(spark.createDataFrame(rows, f"image_id string, u long, v long, edge_kind string, pts {schemas.POINTS}, areas array<double>"))
    assert out.columns == ["image_id", *schemas.BRANCH_METRICS]
    a, b = out.orderBy("node_start").collect()
    assert (a["path_length"], a["endpoint_distance"], a["mean_cs_area"], a["branch_volume"], a["orientation_to_device_axis"]) == (6.0, 6.0, 2.0, 12.0, 0.0)
    assert a["tortuosity"] == 1.0 and b["tortuosity"] == 50.0 and b["orientation_to_device_axis"] is None


def test_panels(spark):
    assert len(schemas.panel_columns()) == 263 and len(set(schemas.panel_columns())) == 263
    assert len(schemas.CURATED_PANEL) == 18 and len(schemas.BRANCH_METRICS) == 25 and len(schemas.GLOBAL_METRICS) == 23
    values = spark.createDataFrame([("i", "median_branch_length", 4.0), ("i", "other", 1.0)], "image_id string, name string, value double")
    row = metrics.curated_panel(values).collect()[0]
    assert row["median_branch_length"] == 4.0 and row["skeleton_lacunarity"] is None


def test_statistics_skip_nan(spark):
    df = schemas.nan_to_null(spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "v double"))
    row = df.agg(*(f("v").alias(n) for n, f in stats.AGGREGATORS.items()), stats.safe_divide(F.lit(1), F.lit(0)).alias("none")).first()
    assert (row["mean"], row["std"], row["median"], row["spread"], row["none"]) == (2.0, 1.0, 2.0, pytest.approx(1.6), None)


def test_runs(spark):
    votes = spark.createDataFrame([("a", z, v) for z, v in enumerate([1, 1, 0, 3, 3, 0, 1, 1])], "image_id string, z int, votes int")
    best = runs.longest_votes(votes).first()
    assert (best["first"], best["last"]) == (0, 1)
    wide = runs.extended(runs.longest_votes(votes, 2), 5, 0, 4).first()
    assert (wide["first"], wide["last"], wide["length"]) == (0, 4, 5)
    assert runs.longest_votes(votes, 9).count() == 0
    p = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([0, 0, 10, 0, 0])], "image_id string, bin int, v double")
    assert [r["smooth"] for r in runs.moving_average(p, "v", "bin", ["image_id"]).orderBy("bin").collect()] == [2.0, 2.0, 2.0, 2.0, 2.0]


def test_voxels(spark):
    cube = spark.createDataFrame([("c", z, y, x) for z in range(8) for y in range(8) for x in range(8)], schemas.VOXELS)
    row = voxels.fractal(cube, [1, 2, 4]).first()
    assert row["fractal_dimension"] == pytest.approx(3.0) and row["lacunarity"] == 0
    assert voxels.box_scales(8)[-1] == 8
    assert voxels.trimmed_range(voxels.slice_fill(cube, 8, 8)).count() == 0
    assert voxels.thickened(cube.filter("y = 0 AND x = 0 AND z = 0"), 8, 8).count() == 4
    assert voxels.eroded(cube).count() == 36
    labelled = graph.linked_pixels(spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 5, 5), (1, 0, 0)], "image_no int, y int, x int"), 10, 100)
    assert sorted(r["label"] for r in labelled.collect()) == [0, 0, 55, 100]


def test_kernels():
    rng = np.random.default_rng(0)
    m = rng.random((6, 7, 8)) < 0.6
    off = np.argwhere(~m)
    want = np.array([[[np.sqrt((((off - (z, y, x)) * (1, 2, 0.5)) ** 2).sum(1).min()) for x in range(8)] for y in range(7)] for z in range(6)])
    assert np.allclose(volume.distance(m, (1, 2, 0.5)), want)
    shell = np.ones((5, 5, 5), bool)
    shell[2, 2, 2] = False
    assert volume.filled(shell).all() and volume.hysteresis(np.array([[0.3, 0.3, 0.6, 0.0, 0.3]])).tolist() == [[True, True, True, False, False]]
    assert volume.hull_volume(np.argwhere(np.ones((3, 4, 5)))) == pytest.approx(2 * 3 * 4)
    assert volume.hull_volume(np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]])) == pytest.approx(1 / 6)
    assert volume.hull_volume(np.array([[0, 0, 0], [1, 1, 1], [2, 2, 2], [3, 3, 3]])) == 0
    bar = np.zeros((5, 5, 20), bool)
    bar[1:4, 1:4, 1:19] = True
    thin = volume.thinned(bar)
    assert 10 <= thin.sum() <= 20 and (thin & ~bar).sum() == 0
    one = np.zeros((9, 9, 30), bool)
    one[2:7, 2:7, 2:28] = True
    line = volume.thinned(one)
    assert np.ptp(np.argwhere(line)[:, 2]) >= 18 and (np.argwhere(line)[4:-4, :2] == 4).all()  # the middle line
    ring = np.zeros((7, 30, 30), bool)
    ring[2:5, 5:25, 5:25] = True
    ring[:, 10:20, 10:20] = False
    assert volume.thinned(ring).sum() > 40 and not volume.thinned(np.zeros((3, 3, 3), bool)).any()
    assert volume.filled(volume.thinned(ring).any(axis=0))[15, 15]  # still closed
    assert np.isinf(volume.distance(np.ones((3, 4), bool))).all()
    tiles = volume.tiled(m.astype(float), lambda a: a * 2, (4, 4, 4), (1, 1, 1))
    assert (tiles == m * 2).all()
    assert volume.resized(np.ones((4, 4)), (0.5, 2)).shape == (2, 8) and volume.gaussian(np.ones((9, 9)), 1).round(9).min() == 1
    assert (volume.sliding(np.full((4, 4, 4), 0.5), lambda a: a, (2, 2, 2), (0.5, 0.5, 0.5)) == 0.5).all()


def test_skeleton_graph(spark):
    y = [("y", 0, 5, x) for x in range(6)] + [("y", 0, 5 + k, 5 + k) for k in range(1, 5)] + [("y", 0, 5 - k, 5 + k) for k in range(1, 5)]
    nodes, edges = graph.from_skeleton(spark.createDataFrame(y, schemas.VOXELS))
    assert sorted(r["edge_kind"] for r in graph.kinds(edges).collect()) == ["attached_sprout"] * 3
    assert nodes.count() == 4


def test_rank_tests(spark):
    rows = [("f", g, float(v)) for g, values in ((0, [1, 2, 3, 3]), (1, [3, 5, 6]), (2, [9, 9])) for v in values]
    values = spark.createDataFrame(rows, "feature string, experiment int, value double")
    u, v = (cohort.mann_whitney(values, "experiment", a, b).first() for a, b in ((0, 1), (1, 0)))
    assert u["u"] + v["u"] == u["n1"] * u["n2"] and u["p"] == pytest.approx(v["p"]) and 0 < u["p"] < 1
    assert 0 < cohort.kruskal(values, "experiment").first()["p"] < 0.1
    assert cohort._upper_gamma(0.5, 3.841458820694124 / 2) == pytest.approx(0.05)
    assert cohort._upper_gamma(2.5, 11.070497693516351 / 2) == pytest.approx(0.05)


def test_pca(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(60, 3)) @ np.array([[3, 1, 0], [0, 1, 0], [0, 0, 0.2]])
    scores, loadings, shares = cohort.pca(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], "id int, a double, b double, c double"), ["id"], ["a", "b", "c"])
    z = (a - a.mean(0)) / a.std(0)
    got = np.array([[r["pc1"], r["pc2"]] for r in scores.orderBy("id").collect()])
    assert np.allclose(got, z @ np.array(loadings).T) and shares[0] >= shares[1] and sum(shares) <= 1 + 1e-9


def test_density_sums_to_one(spark):
    rows = [("i", "g", float(v), float(w)) for v, w in ((10, 1), (40, 2), (80, 1))] + [("j", "g", 5.0, 1.0)]
    d = cohort.density(spark.createDataFrame(rows, "image string, grp string, v double, w double"), "v", "w", "image", "grp", 50).agg(F.sum("density")).first()[0]
    assert d == pytest.approx(1)


def test_comparison(spark):
    a, b = spark.createDataFrame([(1, 1.0, None, 5.0)], "id int, x double, y double, z double"), spark.createDataFrame([(1, 1.00001, None)], "id int, x double, y double")
    assert {r["metric"]: r["ok"] for r in cohort.compared(a, b, ["id"], ["x", "y", "z"]).collect()} == {"x": True, "y": True, "z": None}


def test_corners(spark):
    square = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((4, 2), (0, 0), (0, 2), (4, 0))))
    row = spark.range(1).select(geometry.ordered_corners(square).alias("c")).withColumn("e", geometry.expanded("c", 1, 1)).first()
    assert [tuple(p) for p in row["c"]] == [(0, 0), (4, 0), (4, 2), (0, 2)] and tuple(row["e"][2]) == (5, 3)


def test_jobs(spark, tmp_path):
    for name in ("b_merged.Tif", "a.LIF", "c.txt", "Marina bead.tiff"):
        (tmp_path / name).write_bytes(b"x")  # Spark passes over empty files
    found = jobs.discovered(spark, str(tmp_path)).collect()
    assert [r["image_name"] for r in found] == ["Marina bead.tiff", "a.LIF", "b_merged.Tif"] and found[0]["mask_mode"] == "light"
    assert jobs.discovered(spark, str(tmp_path), merged_only=True).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        jobs.discovered(spark, str(tmp_path / "none")).collect()
    names = spark.createDataFrame([("/d/run.lif", "a/b", 2), ("/d/x.tif", "x", 0)], "file_path string, image_name string, image_index int")
    assert [r["name"] for r in jobs.named(names).collect()] == ["run_a_b_img2", "x"]
    assert jobs.pending(names, spark.createDataFrame([("x",)], "name string")).count() == 1
    keys = spark.createDataFrame([("z12",), (" 7 ",), ("no",)], "k string").select(labels.z_key("k").alias("k"))
    assert [r["k"] for r in keys.collect()] == [12, 7, None]


def test_batch_goes_on_after_failures(spark):
    images = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 2.0)], "image_id string, v double")
    schema = StructType.fromDDL("image_id string, inverse double")

    def analyse(pdf):
        if (pdf.v == 0).any():
            raise ValueError("zero")
        return pdf.assign(inverse=1 / pdf.v)

    out, ledger = jobs.run_batch(images, analyse, schema)
    assert {r["image_id"]: r["inverse"] for r in out.collect()} == {"a": 1.0, "c": 0.5}
    assert {(r["status"], r["n"]) for r in jobs.ledger_counts(ledger).collect()} == {("OK", 2), ("FAILED", 1)}


def test_tables(spark, tmp_path):
    t = spark.createDataFrame([("i1", 1.5), ("i2", None)], "image_id string, v double")
    tables.write_image_tables(t, str(tmp_path / "in/branch"), F.lit("f.tif"), F.lit(0))
    back = tables.cohort(spark, str(tmp_path / "in"), "branch")
    assert back.count() == 2 and {"image_name", "source_file", "image_index", "v", "source_path", "source_folder"} <= set(back.columns)
    with pytest.raises(ValueError):
        tables.write_cohort(back, str(tmp_path / "in/all"), str(tmp_path / "in"))
    np.save(tmp_path / "a.npy", np.arange(6).reshape(1, 2, 3))
    assert volume.unpack(tables.read_arrays(spark, str(tmp_path)).first()).tolist() == [[[0, 1, 2], [3, 4, 5]]]


def test_focus_surface(spark):
    points = [("i", float(x), float(y), 1 + 2.0 * x - y + 0.5 * x * y) for x in range(4) for y in range(4)]
    row = volume.focus_surface(spark.createDataFrame(points, "image_id string, x double, y double, z double")).first()
    assert [round(row[f"c{i}"], 6) for i in range(6)] == [1, 2, -1, 0, 0.5, 0]


def test_orientation_bounds(spark):
    rows = [(math.cos(a), math.sin(a)) for a in np.linspace(0, 6.28, 40)]
    out = spark.createDataFrame([tuple(map(float, r)) for r in rows], "x double, y double").select(geometry.orientation(F.col("x"), F.col("y")).alias("o")).agg(F.min("o"), F.max("o")).first()
    assert 0 <= out[0] and out[1] <= 90


def test_device_planes():
    rng = np.random.default_rng(2)
    image = rng.normal(0, 0.05, (60, 80))
    image[25:40, 30:50] += 1.0
    for t in (device.otsu(image), device.yen(image)):
        assert 0.1 < t < 0.95
    assert 0 < device.triangle(np.abs(image)) < 0.95
    mask = device.central_object(image, "light", 0.02, 0.2)
    assert abs(int(mask.sum()) - 300) < 60
    with pytest.raises(ValueError):
        device.central_object(np.zeros((40, 40)) + rng.normal(0, 1e-3, (40, 40)), "light", 0.9, 1.0)
    two = np.zeros((10, 10), bool)
    two[0:2, 0:2] = two[2, 2] = two[7, 7] = True
    assert device.labelled(two).max() == 2 and [r["area"] for r in device.regions(device.labelled(two))] == [5, 1]
    assert (device.eroded(device.dilated(two, 1), 1) >= two).all()
    corners = np.array([[10.0, 5.0], [29.0, 5.0], [29.0, 14.0], [10.0, 14.0]])
    ramp = np.mgrid[:40, :50][1].astype(float)
    assert np.allclose(device.rectified(ramp, corners), np.tile(np.arange(10, 30), (10, 1)))
    box = np.zeros((40, 40), bool)
    box[10:20, 5:35] = True
    assert np.allclose(device.oriented_box(box), [[5, 10], [34, 10], [34, 19], [5, 19]])
    assert np.allclose(device.device_rectangle(np.ones((20, 30)) + rng.normal(0, 1e-6, (20, 30)))[2], [29, 19])


def test_focus_and_axes():
    rng = np.random.default_rng(3)
    stack = np.zeros((5, 100, 100))
    stack[3] = rng.random((100, 100))
    assert device.votes(stack) == {0: 0, 1: 0, 2: 0, 3: 4, 4: 0}
    moved = device.refocused(np.arange(5)[:, None, None] * np.ones((5, 2, 2)), np.array([[1, 2], [2, 3]]))
    assert moved[2].tolist() == [[1, 2], [2, 3]]
    assert device.as_stack(np.zeros((4, 5))).shape == (1, 4, 5) and device.as_stack(np.zeros((9, 2, 5, 6)), 7).shape == (9, 5, 6)


def test_image_files(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(np.arange(12, dtype=np.uint8).tobytes())
    (tmp_path / "b.tif").write_bytes(b"xx")
    found = jobs.discovered(spark, str(tmp_path))
    good, failed = images.stacks(found, lambda content, index: np.frombuffer(content, np.uint8).reshape(3, 4))
    assert volume.unpack(good.first()).shape == (1, 3, 4) and failed.first()["status"] == "FAILED"


def grid_volume():
    """Two bars along x cross two along y; each is 7 by 7 voxels."""
    a = np.zeros((24, 160, 220), np.uint8)
    for y in (50, 110):
        a[8:15, y - 3 : y + 4, 10:210] = 1
    for x in (70, 150):
        a[8:15, 10:150, x - 3 : x + 4] = 1
    return a


def packed(spark, *named):
    rows = [(v["image_id"], v["shape"], v["dtype"], bytearray(v["data"])) for v in (volume.pack(n, a) for n, a in named)]
    return spark.createDataFrame(rows, volume.SCHEMA)


def test_statistics_count_each_value_once(spark):
    """One table of counts a metric and subset, whatever the aggregates; only the metrics asked for."""
    from filigree.schemas import AGGREGATES, EDGE_ALIASES

    rows = [("a", k, *(float(i * (j + 1)) if i % 4 else None for j in range(len(EDGE_ALIASES)))) for i, k in enumerate(["branch", "attached_sprout"] * 9)]
    df = spark.createDataFrame(rows, "image_id string, edge_kind string, " + ", ".join(f"{c} double" for c in EDGE_ALIASES.values()))
    found = metrics.edge_statistics(df, ["length", "orientation"])
    assert found.columns == ["image_id", "subset", "metric", *AGGREGATES]
    every = {(r["subset"], r["metric"]): r for r in metrics.edge_statistics(df).collect()}
    some = {(r["subset"], r["metric"]): r for r in found.collect()}
    assert len(every) == 3 * len(EDGE_ALIASES) and len(some) == 6 and all(every[k] == r for k, r in some.items())
    for k, test in (("branch", lambda i: i % 2 == 0), ("attached_sprout", lambda i: i % 2), ("sprout_and_branch", lambda i: True)):
        v = np.array([i * 2.0 for i in range(18) if i % 4 and test(i)])
        want = {"mean": v.mean(), "std": v.std(), "median": np.median(v), "spread": np.percentile(v, 90) - np.percentile(v, 10)}
        assert all(some[k, "length"][a] == pytest.approx(x) for a, x in want.items())
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("partial_percentile(") == 2
    assert metrics.measured(["median_branch_length", "skeleton_lacunarity"]) == ["length"]


def test_contraction_by_chains(spark, monkeypatch):
    """Bundles of chains, rings, chains from a node to itself and loops, dealt over many groups, as one graph at a time gives them."""
    rng = np.random.default_rng(6)
    links = {}
    for image, n, m in (("a", 60, 62), ("b", 40, 36), ("c", 9, 9)):
        for i, (u, v) in enumerate(rng.integers(0, n, (m, 2)).tolist()):
            links[image, min(u, v), max(u, v)] = float(i + 1)
        names = iter(rng.permutation(np.arange(100, 200)).tolist())
        for a, b in ((0, 1), (0, 1), (0, 1), (2, 2), (3, 4)):  # chains of three between two nodes, and a ring
            x, y, z = next(names), next(names), next(names)
            links |= {(image, min(p, q), max(p, q)): 0.5 + p for p, q in ((a, x), (x, y), (y, z), (z, b))}
        ring = [next(names) for _ in range(5)]
        links |= {(image, min(p, q), max(p, q)): 1.0 for p, q in zip(ring, ring[1:] + ring[:1])}
    want = {}
    for image in "abc":
        near = {}
        for (i, u, v), w in links.items():
            if i == image:
                near.setdefault(u, {})[v] = near.setdefault(v, {})[u] = (w, 1)
        again = True
        while again:
            again = False
            for n in sorted(near):
                if len(near[n]) == 2:
                    (a, (wa, ca)), (b, (wb, cb)) = near[n].items()
                    if a != b and b not in near[a]:
                        del near[n], near[a][n], near[b][n]
                        near[a][b] = near[b][a] = (wa + wb, ca + cb)
                        again = True
        want |= {(image, u, v): x for u in near for v, x in near[u].items() if u < v}
    monkeypatch.setattr(graph, "GROUP", 10)
    sizes = []
    inner = graph._buckets
    monkeypatch.setattr(graph, "_buckets", lambda n: sizes.append(inner(n)) or sizes[-1])
    e = spark.createDataFrame([(*k, w) for k, w in links.items()], "image_id string, u long, v long, weight double")
    got = {(r["image_id"], r["u"], r["v"]): (pytest.approx(r["weight"]), r["merged"]) for r in graph.contracted(e).collect()}
    assert got == want and len(sizes) == 1 and sizes[0] > 5


def test_distances_along_components_in_groups(spark, monkeypatch):
    """Components are dealt over groups: the same distances as with an image in one group; nodes without edges have none."""
    rng = np.random.default_rng(7)
    links = {(i, min(u, v), max(u, v)): float(w) for i in "ab" for (u, v), w in zip(rng.integers(0, 90, (70, 2)).tolist(), rng.integers(1, 9, 70), strict=True) if u != v}
    e = spark.createDataFrame([(*k, w) for k, w in links.items()], "image_id string, u long, v long, weight double")
    alone = spark.createDataFrame([("a", 500, True), ("c", 1, False)], "image_id string, node_id long, sprout boolean")
    nodes = graph.degrees(e).select("image_id", "node_id", (F.col("degree") == 1).alias("sprout")).unionByName(alone)
    seen = lambda: {(r["image_id"], r["node_id"], r["sprout"], r["distance"]) for r in graph.along_skeleton(e, nodes).collect()}
    whole, sizes, inner = seen(), [], graph._buckets
    monkeypatch.setattr(graph, "GROUP", 5)
    monkeypatch.setattr(graph, "_buckets", lambda n: sizes.append(inner(n)) or sizes[-1])
    assert seen() == whole and len(sizes) == 1 and sizes[0] > 20
    kinds, d = {(i, n): s for i, n, s, _ in whole}, {}
    for start in kinds:  # by hand
        left, far = {start: 0.0}, {}
        while left:
            at = min(left, key=left.get)
            far[at] = left.pop(at)
            for (i, u, v), w in links.items():
                for p, q in ((u, v), (v, u)):
                    if i == at[0] and p == at[1] and (i, q) not in far:
                        left[i, q] = min(left.get((i, q), 1e9), far[at] + w)
        d[start] = min((x for n, x in far.items() if n != start and kinds[n] == kinds[start]), default=None)
    assert {(i, n): x for i, n, _, x in whole} == d and None in d.values()


def test_neighbours_by_cells(spark):
    """Large images by cells: clusters, a node far from all, an image of one kind; against all distances."""
    rng = np.random.default_rng(4)
    rows = []
    for image, n in (("big", 400), ("tips", 120), ("small", 20)):
        centre = rng.integers(0, 400, (6, 3))
        at = centre[rng.integers(0, 6, n)] + rng.integers(-9, 10, (n, 3))
        at[0] = (3000, 10, 10)  # on its own
        rows += [(image, 1000 + i, *map(int, p), 1, bool(image == "tips" or rng.random() < 0.3)) for i, p in enumerate(at)]
    df = spark.createDataFrame(rows, "image_id string, node_id long, z int, y int, x int, degree long, sprout boolean")
    got = {(r["image_id"], r["node_id"]): r for r in graph.neighbours(df, radius=25.0, share=4).collect()}
    assert len(got) == len(rows)
    for image in ("big", "tips", "small"):
        own = [r for r in rows if r[0] == image]
        p, tip = np.array([r[2:5] for r in own]) * 2.0, np.array([r[6] for r in own])
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
        np.fill_diagonal(d, np.inf)
        for i, r in enumerate(own):
            for name, kind in (("junction", ~tip), ("endpoint", tip)):
                x = d[i][kind]
                best = x.min() if len(x) and np.isfinite(x.min()) else None
                assert got[image, r[1]][f"dist_nearest_{name}"] == (None if best is None else pytest.approx(best)), (image, r[1], name)
                assert got[image, r[1]][f"num_{name}_neighbors"] == (x <= 25.0).sum()


def test_neighbours_of_crowded_images_are_counted_over_tiles(spark, monkeypatch):
    """Places with several nodes, sparse corners, a kind that is rare; pairs, whole tiles and convolutions count alike."""
    rng = np.random.default_rng(5)
    rows = []
    for image, n, rare in (("dense", 1500, 0.5), ("lonely", 800, 0.0)):
        at = np.concatenate([rng.integers(0, (9, 30, 41), (n, 3)), rng.integers(0, 60, (20, 3))]) - 7
        rows += [(image, i, *map(int, p), 1, bool(rng.random() < rare or (image == "lonely" and i == 3))) for i, p in enumerate(at)]
    df = spark.createDataFrame(rows, "image_id string, node_id long, z int, y int, x int, degree long, sprout boolean")
    monkeypatch.setattr(graph, "PLACES", (8, 16, 16))
    asked = []
    inner = graph._dense_neighbours
    monkeypatch.setattr(graph, "_dense_neighbours", lambda nodes, *a: asked.append(nodes) or inner(nodes, *a))
    got = {(r["image_id"], r["node_id"]): r for r in graph.neighbours(df, radius=50.0, share=4).collect()}
    assert len(got) == len(rows) and len(asked) == 1 and asked[0].count() == len(rows)
    for image in ("dense", "lonely"):
        own = [r for r in rows if r[0] == image]
        p, tip = np.array([r[2:5] for r in own]) * 2.0, np.array([r[6] for r in own])
        d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
        np.fill_diagonal(d, np.inf)
        for i, r in enumerate(own):
            for name, kind in (("junction", ~tip), ("endpoint", tip)):
                x = d[i][kind]
                best = x.min() if len(x) and np.isfinite(x.min()) else None
                assert got[image, r[1]][f"dist_nearest_{name}"] == (None if best is None else pytest.approx(best)), (image, r[1], name)
                assert got[image, r[1]][f"num_{name}_neighbors"] == (x <= 50.0).sum()
    p, q = np.unique(rng.integers(-5, 20, (900, 3)), axis=0), np.unique(rng.integers(11, 30, (800, 3)), axis=0)
    w = rng.integers(0, 9, (len(q), 2))
    plain = graph._within(p, q, w, (2.0, 1.5, 0.5), 15.0)
    monkeypatch.setattr(graph, "PAIRS", 0)
    assert plain.any() and np.array_equal(plain, graph._within(p, q, w, (2.0, 1.5, 0.5), 15.0))


def test_whole_analysis(spark):
    """By hand: 4 junctions, 8 sprouts, and without sprouts a ring of 280 voxels in 3 edges (the last node can't go)."""
    from filigree.plans.analysis import analyse

    a = grid_volume()
    unit = 3 * 2 * 2.0
    out = analyse(packed(spark, ("i", a), ("empty", a * 0)), a.shape, voxel=(3.0, 2.0, 2.0), margin=2, ratio=10.0, sigma=0.1)  # the bars' ends are blunt
    top = {r["image_id"]: r for r in out["global_metrics"].collect()}
    one, none = top["i"], top["empty"]
    hull = 6 * 3 * 199 * 2 * 139 * 2  # the bars' ends lie on this box, whose corners are cut
    assert one["chip_volume"] == none["chip_volume"] == a.size * unit and one["vessel_volume"] == a.sum() * unit and none["vessel_volume"] == 0
    assert one["convex_hull_volume"] == pytest.approx(volume.hull_volume(np.argwhere(a) * (3.0, 2.0, 2.0))) and one["vessel_volume"] < one["convex_hull_volume"] < hull
    assert none["convex_hull_volume"] == none["chip_volume"] and none["vessel_volume_fraction"] == 0 and none["total_vessel_length"] == 0 and none["skeleton_fractal_dimension"] is None
    assert one["vessel_volume_fraction"] == pytest.approx(one["vessel_volume"] / one["convex_hull_volume"])
    assert one["total_vessel_length"] == pytest.approx(560, rel=0.03)
    for name, count in (("attached_sprouts", 8), ("junctions", 4), ("branches", 3), ("floating_sprouts", 0)):
        assert one[f"{name}_per_volume"] == pytest.approx(count / one["convex_hull_volume"])
    assert one["junctions_per_vessel_length"] == pytest.approx(4 / one["total_vessel_length"])
    edges = out["branch_metrics"].collect()
    assert sorted(e["edge_kind"] for e in edges) == ["attached_sprout"] * 8 + ["branch"] * 4
    # four voxels from the middle to the outside, of 2 um each, in the projection and in the volume
    assert all(e["median_cs_area"] == pytest.approx(64 * math.pi) for e in edges) and all(e["median_width"] == pytest.approx(16) for e in edges)
    assert {round(e["path_length"] / 8) for e in edges if e["edge_kind"] == "branch"} <= {14, 15, 16, 19, 20, 21}
    assert [r["degree"] for r in out["branch_only_junction_metrics"].collect()] == [2, 2, 2] and out["branch_only_metrics"].count() == 3
    panel = {r["image_id"]: r.asDict() for r in out["panel"].collect()}
    assert out["panel"].columns == ["image_id", *schemas.panel_columns()] and out["curated"].columns == ["image_id", *schemas.CURATED_PANEL]
    # of all columns only those of floating sprouts, of tips seen from junctions alone, are absent
    absent = {k for k, v in panel["i"].items() if v is None}
    assert all("floating_sprout_" in k or "branch_only_junction_dist_nearest_endpoint" in k for k in absent)
    assert panel["i"]["mean_branch_only_junction_degree"] == 2 and panel["i"]["mean_branch_only_junction_num_junction_neighbors"] == 2
    assert panel["i"]["skeleton_fractal_dimension"] == one["skeleton_fractal_dimension"] and 0.8 < one["skeleton_fractal_dimension"] < 2
    assert out["skeleton"].count() <= out["field"].count() + 12


def test_whole_analysis_under_a_mask(spark):
    """Masked columns go first: from the vessel, the chip and the hull; one sprout gets shorter, and edges under it go."""
    from filigree.plans.analysis import analyse, off_mask

    a = grid_volume()
    mask = spark.createDataFrame([(y, x) for y in range(40, 61) for x in range(10, 31)], "y int, x int")
    out = analyse(packed(spark, ("i", a)), a.shape, mask, voxel=(3.0, 2.0, 2.0), margin=2, ratio=10.0, sigma=0.1)
    one = out["global_metrics"].first()
    assert one["chip_volume"] == (a.size - 21 * 21 * 24) * 12.0 and one["vessel_volume"] == (int(a.sum()) - 7 * 7 * 21) * 12.0
    kept = a.copy()
    kept[:, 40:61, 10:31] = 0
    points, planes = np.argwhere(kept), volume.hull_planes(np.argwhere(kept))
    columns = np.argwhere(np.ones((24, 21, 21))) + (0, 40, 10)
    inside = int((columns @ planes[:, :3].T <= planes[:, 3] + 1e-9).all(1).sum())
    assert inside > 0 and one["convex_hull_volume"] == pytest.approx(volume.hull_volume(points * (3.0, 2.0, 2.0)) - inside * 12)
    lengths = sorted(e["path_length"] for e in out["branch_metrics"].collect() if e["edge_kind"] == "attached_sprout")
    assert len(lengths) == 8 and one["total_vessel_length"] == pytest.approx(560, rel=0.03)
    line = spark.createDataFrame([("i", 1, 2, [(0, 1, 1), (0, 50, 20)]), ("i", 3, 4, [(0, 1, 1), (0, 61, 20)]), ("j", 1, 2, [(0, 50, 20)])], f"image_id string, u long, v long, pts {schemas.POINTS}")
    assert [(r["image_id"], r["u"]) for r in off_mask(line, mask.withColumn("image_id", F.lit("i"))).orderBy("image_id").collect()] == [("i", 3), ("j", 1)]


def test_pruning_by_halves(spark):
    """The thinner half is the tip's, whatever its outermost samples are; removable edges at tips go one after another."""
    from filigree.plans.analysis import pruned

    pts = [{"z": 0, "y": 0, "x": i} for i in range(100)]
    thin = [1.0] * 30 + [0.0] * 20 + [2.0] * 50  # the left half is thinner; its end is half as wide as the other end
    chain = [("i", k, k + 1, 10.0, pts, [1.0] * 100) for k in range(300, 520)]
    rows = [("a", 1, 2, 99.0, pts, thin), ("b", 1, 2, 99.0, pts, [0.1] * 50 + [2.0] * 50), *chain]
    e = spark.createDataFrame(rows, f"image_id string, u long, v long, weight double, pts {schemas.POINTS}, areas array<double>")
    assert {r["image_id"] for r in pruned(e.filter("image_id <> 'i'")).collect()} == {"b"}


def test_hull_without_mask(spark):
    cube = spark.createDataFrame([("c", z, y, x) for z in (0, 2) for y in (0, 4) for x in (0, 4)], schemas.VOXELS)
    mask = spark.createDataFrame([("c", 1, 1), ("c", 9, 9)], schemas.MASK_2D)
    assert volume.hulls_without_mask(cube, mask, (3, 10, 10), (1, 1, 1)).first()["convex_hull_volume"] == pytest.approx(2 * 4 * 4 - 3)
    assert volume.hulls_without_mask(cube.limit(2), mask, (3, 10, 10), (1, 1, 1)).first()["convex_hull_volume"] == 300 - 6
    assert volume.hulls_without_mask(cube.limit(0), mask, (3, 10, 10), (1, 1, 1)).first()["convex_hull_volume"] == 300 - 6


def test_chains_keep_their_points(spark):
    rows = [("i", 1, 2, 1.0, [(0, 0, 0), (0, 0, 1)]), ("i", 2, 3, 1.0, [(0, 0, 2), (0, 0, 1)])]
    e = spark.createDataFrame(rows, f"image_id string, u long, v long, weight double, pts {schemas.POINTS}")
    row = graph.contracted(e).first()
    assert [tuple(p) for p in row["pts"]] in ([(0, 0, 0), (0, 0, 1), (0, 0, 2)], [(0, 0, 2), (0, 0, 1), (0, 0, 0)]) and row["weight"] == 2


def test_feature_rankings(spark):
    t = spark.createDataFrame([("a", 0.01, 2.0), ("b", 0.2, -9.0), ("c", 0.001, 1.0), ("d", None, 5.0), ("e", 0.01, -2.0)], "feature string, p double, importance double")
    assert [(r["feature"], r["rank"], r["significant"]) for r in cohort.significant(t).collect()] == [("c", 1, True), ("a", 2, True), ("e", 3, True)]
    assert [(r["feature"], r["significant"]) for r in cohort.significant(t, below=1e-9, fallback=2).collect()] == [("c", False), ("a", False)]
    assert cohort.significant(t.limit(0)).collect() == []
    assert [r["feature"] for r in cohort.ranked(cohort.scored(t, "importance", "p"), "score", 3).orderBy("rank").collect()] == ["b", "a", "e"]
    assert tuple(cohort.oriented(spark.createDataFrame([("x", 1.0), ("y", 3.0), ("x", 2.0), ("z", 3.0)], "g string, pc1 double"), "g").first()) == ("y", "x")
