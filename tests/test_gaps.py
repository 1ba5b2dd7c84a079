"""Resampling, masks of other sizes, conditions, settings, and why images stop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree.functions import labels
from filigree.operators import cohort, tiles, volume, voxels
from filigree.plans import analysis
from filigree.sources import jobs
from tests.test_tiles import arrays_of, cut


def test_splines_go_through_values_and_are_cubic():
    rng = np.random.default_rng(1)
    a = rng.random((5, 9, 4))
    for axis in range(3):
        c, n = volume.spline(a, axis), a.shape[axis]
        near = [np.take(c, volume._mirrored(np.arange(n) + d, n), axis) for d in (-1, 0, 1)]
        assert np.allclose((near[0] + 4 * near[1] + near[2]) / 6, a)
    x = np.arange(60.0)
    poly = lambda t: 2 + t - 0.05 * t**2 + 0.001 * t**3
    got = volume.recut(poly(x), 90, 0)
    at = (np.arange(90) + 0.5) * 60 / 90 - 0.5
    assert np.allclose(got[30:60], poly(at)[30:60], atol=1e-8)  # the mirrored ends don't reach the middle
    assert volume.cubic(np.full((3, 4), 7, np.int16), (6, 2)).tolist() == [[7, 7]] * 6
    step = np.repeat([0.0, 1.0], 10)
    out = volume.cubic(step, (55,))
    assert out.min() == 0 and out.max() == 1  # no overshoot beyond the range
    assert volume.cubic(np.arange(100.0), (25,)).shape == (25,) and abs(volume.cubic(np.arange(100.0), (25,))[12] - 49.5) < 0.1


def test_resized_over_tiles(spark):
    rng = np.random.default_rng(2)
    arrays = {"a": rng.random((13, 17, 20)), "b": rng.integers(0, 200, (4, 30, 9)).astype(np.uint8)}
    factors = (2.5, 0.5, 1.0)
    got = arrays_of(tiles.resized(cut(spark, arrays, (5, 8, 7)), factors, (5, 8, 7)))
    for k, a in arrays.items():
        want = volume.cubic(a, volume.resized_shape(a.shape, factors))
        assert got[k].dtype == a.dtype and got[k].shape == want.shape
        assert np.allclose(got[k].astype(float), want.astype(float), atol=0 if k == "b" else 1e-12) or k == "b" and abs(got[k].astype(int) - want).max() <= 1


def test_margins(spark):
    a = np.random.default_rng(3).random((6, 20, 18))
    got = arrays_of(tiles.margins_cut(cut(spark, {"a": a, "thin": a[:, :6]}, (5, 8, 7)), (1, 3, 3), (0, 3, 3), (5, 8, 7)))
    assert got.keys() == {"a"} and np.array_equal(got["a"], a[1:, 3:-3, 3:-3])


def test_masks_of_another_size(spark):
    mask = np.zeros((10, 12), bool)
    mask[3:7, 4:9] = True
    out = volume.fitted_mask(mask, 20, 24)
    assert out.shape == (20, 24) and (out == np.repeat(np.repeat(mask, 2, 0), 2, 1)).mean() > 0.97
    assert volume.fitted_mask(np.zeros((0, 5), bool), 3, 4).shape == (3, 4) and volume.fitted_mask(mask, 5, 6)[2, 3]
    assert np.array_equal(arrays_of(tiles.fitted_masks(cut(spark, {"m": mask[None]}, (1, 50, 50)), 20, 24))["m"][0], out)


def test_mask_algebra(spark):
    a, b = (spark.createDataFrame(rows, "image_id string, y int, x int") for rows in ([("i", 0, 0), ("i", 0, 1), ("i", 0, 1)], [("i", 0, 1), ("j", 0, 0)]))
    cells = lambda df: sorted(map(tuple, df.collect()))
    assert cells(voxels.common_mask(a, b)) == [("i", 0, 1)] and cells(voxels.mask_less(a, b)) == [("i", 0, 0)]
    assert cells(voxels.complement(a, a.unionByName(b), 1, 2)) == [("j", 0, 0), ("j", 0, 1)]


@pytest.mark.parametrize(
    ("rules", "name", "want"),
    [
        ("two conditions", "18.09 FLOW day 7", "flow"), ("two conditions", "Static flow", "static"), ("two conditions", "reservoir", "resevoir"), ("two conditions", "valve 1", "NA"),
        ("valves", "run_Valve 8", "high_flow"), ("valves", "valve 4 flow", "low_flow"), ("valves", "flow", "NA"), ("valves", "static valve 1", "static"),
        ("media", "x_WP_y", "WP"), ("media", "ws", "NA"), ("donors", "Rose and iris", "iris"), ("sex of donors", "tulip", "male"), ("sex of donors", "iris rose", "female"),
        ("batches", "270325.2", "vehicle"), ("batches", "270325.1", "dexa"), ("batches", None, "NA"),
    ],
)
def test_conditions(spark, rules, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(labels.condition("n", rules)).first()[0] == want


def test_short_numbers(spark):
    values = [0.0, 1.0, 2.50004, 1234.6, 12345.6, 0.00012346, 0.000012346, -3.14159, 99999.0, None, float("nan"), float("inf"), 0.99996]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(labels.short_number("v")).collect()]
    want = ["NA" if v is None or not np.isfinite(v) else f"{v:.4g}" for v in values]
    assert [float(a) if a != "NA" else a for a in got] == [float(a) if a != "NA" else a for a in want]


def test_features_and_counts(spark):
    df = spark.createDataFrame([("a", "i", 1.0, None, 2.0, 5), ("a", "j", 2.0, None, None, 6), ("b", "k", 3.0, None, 4.0, 7), ("b", "k", 3.5, None, 4.0, 7)], "experiment string, image_name string, f double, empty double, g double, image_index int")
    rows, names = cohort.feature_matrix(df)
    assert names == ["f", "g"] and rows.count() == 3 and set(rows.columns) == {"experiment", "image_name", "f", "g"}
    assert cohort.first_of(df, "x", "g", "f") == "g" and cohort.first_of(df, "x") is None
    got = {(r["experiment"], r["whole"]): (r["images"], r["rows"]) for r in cohort.distinct_counts(df).collect()}
    assert got == {("a", False): (2, 2), ("b", False): (1, 2), (None, True): (3, 4)}


def test_settings(spark, tmp_path):
    (tmp_path / "m").write_bytes(b"x")
    good = jobs.Settings(str(tmp_path), "out", str(tmp_path / "m"), str(tmp_path / "m"), 35.0)
    assert good.checked(spark) == []
    bad = jobs.Settings(str(tmp_path / "none"), ".", "", str(tmp_path / "gone"), 0)
    assert len(bad.checked(spark)) == 5


def test_finished(spark):
    df = spark.createDataFrame([("a", "curated"), ("b", "skip")], "file_path string, status string")
    seen = []
    assert jobs.finished(df, seen.append).count() == 2 and len(seen) == 1
    assert jobs.finished(df.unionByName(spark.createDataFrame([("c", "pending")], df.schema)), seen.append) is None and len(seen) == 1


def test_why_images_stop(spark):
    images = spark.createDataFrame([(c,) for c in "abcde"], "image_id string")
    mask = spark.createDataFrame([("a", y, 0) for y in range(5)], "image_id string, y int, x int")
    votes = spark.createDataFrame([("a", 0, 9), ("c", 1, 2), ("d", 1, 5), ("e", 0, 3), ("b", 0, 0)], "image_id string, z int, votes int")
    cells = spark.createDataFrame([("d", z, y, x) for z in range(2) for y in range(2) for x in range(5)] + [("e", 0, y, x) for y in range(2) for x in range(5)], "image_id string, z int, y int, x int")
    got = {r["image_id"]: (r["category"], r["body"]) for r in analysis.stopped(images, mask, 10, votes, cells, (2, 2, 5)).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "organoid_too_large", "b": "no_valid_z_range", "c": "no_strong_vote_planes", "d": "all_slices_trimmed"}
    assert got["d"][1] == "slice    0: 1.0000\nslice    1: 1.0000" and "50.0%" in got["a"][1]
    assert "all_slices_trimmed" not in {r["category"] for r in analysis.stopped(images, mask, 10, votes.filter(F.col("image_id") != "a")).collect()}
