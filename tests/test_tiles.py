"""Tiled volumes against the same kernels on one array, and against floods and windows written out plainly."""

import itertools

import numpy as np
import pytest

from filigree.operators import tiles, volume

TILE = (5, 8, 7)


def table(spark, arrays):
    return spark.createDataFrame([volume.pack(k, a) for k, a in arrays.items()], volume.SCHEMA)


def cut(spark, arrays, tile=TILE):
    return tiles.cut(table(spark, arrays), tile)


def arrays_of(found, shape=None):
    """Each image's array; tiles must cover it, each voxel once."""
    out, seen = {}, {}
    for r in found.collect():
        a = tiles.unpacked(r.asDict())
        out.setdefault(r["image_id"], np.zeros(r["shape"], a.dtype))
        seen.setdefault(r["image_id"], np.zeros(r["shape"], int))
        at = tuple(slice(p, p + n) for p, n in zip(r["low"], a.shape, strict=True))
        out[r["image_id"]][at] = a
        seen[r["image_id"]][at] += 1
    assert all((s == 1).all() for s in seen.values())
    return out


@pytest.fixture(scope="module")
def noise():
    rng = np.random.default_rng(4)
    return {"a": rng.random((13, 17, 20)), "b": rng.random((4, 30, 9)), "flat": rng.random((1, 3, 3))}


@pytest.fixture(scope="module")
def masks(noise):
    out = {k: a > 0.6 for k, a in noise.items()}
    solid = np.zeros((14, 21, 18), bool)  # a box with a cavity over several tiles, and one with a leak to the border
    solid[1:13, 1:19, 1:17] = True
    solid[3:11, 3:9, 3:15] = False
    solid[5:8, 11:17, 5:14] = False
    solid[6, 12, 5:18] = False
    out |= {"box": solid, "none": np.zeros((6, 9, 8), bool), "all": np.ones((6, 9, 8), bool)}
    return out


def flood(mask, full):
    """Labels by depth-first search, in order of first voxels."""
    near = [o for o in itertools.product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, o)) <= (3 if full else 1)]
    out = np.zeros(mask.shape, np.int64)
    for start in map(tuple, np.argwhere(mask)):
        if out[start]:
            continue
        number, stack = np.ravel_multi_index(start, mask.shape) + 1, [start]
        out[start] = number
        while stack:
            p = stack.pop()
            for o in near:
                q = tuple(a + b for a, b in zip(p, o, strict=True))
                if all(0 <= a < n for a, n in zip(q, mask.shape, strict=True)) and mask[q] and not out[q]:
                    out[q] = number
                    stack.append(q)
    return out


@pytest.mark.parametrize("full", [True, False])
def test_numbers_of_one_array(masks, full):
    for a in masks.values():
        assert (tiles.numbered(a, full) == flood(a, full)).all()


@pytest.mark.parametrize(
    ("name", "tiled", "plain"),
    [
        ("gaussian", lambda t: tiles.gaussian(t, 1.2, TILE), lambda a: volume.gaussian(a, 1.2)),
        ("wide", lambda t: tiles.gaussian(t, 2.5, TILE), lambda a: volume.gaussian(a, 2.5)),  # reaches beyond the next tile
        ("median", lambda t: tiles.median(t, 5, TILE), lambda a: volume.median(a, 5)),
        ("hysteresis", lambda t: tiles.hysteresis(t, 0.7, 0.97, TILE), lambda a: volume.hysteresis(a, 0.7, 0.97)),
    ],
)
def test_fields(spark, noise, name, tiled, plain):
    found = tiled(cut(spark, noise))
    got = arrays_of(found)
    assert got.keys() == noise.keys() and found.count() == sum(tiles.tile_count(a.shape, TILE) for a in noise.values())
    for k, a in noise.items():
        assert np.array_equal(got[k], plain(a)), (name, k)


@pytest.mark.parametrize(
    ("name", "tiled", "plain"),
    [
        ("smoothed", lambda t: tiles.smoothed(t, 1.0, TILE), lambda a: volume.smoothed(a, 1.0)),
        ("filled", lambda t: tiles.filled(t, TILE), volume.filled),
        ("near distance", lambda t: tiles.near_distance(t, 4, TILE), lambda a: np.minimum(volume.distance(a), 4)),
        ("distance", lambda t: tiles.distance(t, (2.0, 1.0, 0.5), TILE), lambda a: volume.distance(a, (2.0, 1.0, 0.5))),
        ("projected", tiles.projected, lambda a: a.any(axis=0)[None]),
        ("labelled", lambda t: tiles.labelled(t, True, TILE), lambda a: flood(a, True)),
        ("labelled by faces", lambda t: tiles.labelled(t, False, TILE), lambda a: flood(a, False)),
    ],
)
def test_masks(spark, masks, name, tiled, plain):
    got = arrays_of(tiled(cut(spark, masks)))
    assert got.keys() == masks.keys()
    for k, a in masks.items():
        assert np.array_equal(got[k], plain(a)), (name, k)


def test_kernels_run_in_as_many_tasks_as_there_are_tiles(spark, noise):
    """A kernel sees no more than a tile with its surroundings."""

    def kernel(a):
        assert all(n <= t + 2 for n, t in zip(a.shape, TILE, strict=True))
        return np.full(a.shape, a.size)

    assert arrays_of(tiles.mapped(cut(spark, noise), kernel, (1, 1, 1), TILE)).keys() == noise.keys()


def test_tiles_of_another_size(spark, noise):
    for tile in ((3, 5, 30), None):
        found = tiles.retiled(cut(spark, noise), tile)
        assert found.count() == sum(tiles.tile_count(a.shape, tile or (1, *a.shape[1:])) for a in noise.values())
        got = arrays_of(found)
        assert all(np.array_equal(got[k], a) for k, a in noise.items())


def test_thinned(spark, masks):
    """Also where tiles lie further apart than a round reaches."""
    rng = np.random.default_rng(9)
    arrays = {"box": masks["box"], "none": masks["none"], "long": volume.smoothed(rng.random((8, 260, 14)) > 0.55, 1.2)}
    tile = (6, 50, 8)
    got = arrays_of(tiles.thinned(cut(spark, arrays, tile), tile))
    for k, a in arrays.items():
        assert np.array_equal(got[k], volume.thinned(a)), k
    assert 0 < got["long"].sum() < arrays["long"].sum() / 3
    with pytest.raises(ValueError, match="even"):
        tiles.thinned(cut(spark, arrays), TILE)


def test_from_voxels_and_back(spark):
    rows = [("a", 0, 0, 0, 2.0), ("a", 5, 8, 7, 3.0), ("a", 5, 8, 7, 9.0), ("a", 99, 0, 0, 1.0), ("a", -1, 0, 0, 1.0), ("a", None, 0, 0, 1.0), ("a", 6, 1, 1, None), ("b", 50, 1, 1, 1.0), (None, 1, 1, 1, 4.0)]
    df = spark.createDataFrame(rows, "image_id string, z int, y int, x int, value double")
    made = tiles.from_voxels(df, (7, 9, 8), TILE, "value")
    assert made.count() == 3 * tiles.tile_count((7, 9, 8), TILE)
    got = {tuple(r) for r in tiles.voxels(made).collect()}
    assert got == {("a", 0, 0, 0, 2.0), ("a", 5, 8, 7, 9.0), (None, 1, 1, 1, 4.0)}
    assert {tuple(r)[:4] for r in tiles.voxels(tiles.from_voxels(df, (7, 9, 8), TILE)).collect()} == {("a", 0, 0, 0), ("a", 5, 8, 7), ("a", 6, 1, 1), (None, 1, 1, 1)}
    empty = tiles.from_voxels(df.limit(0), (7, 9, 8), TILE)
    assert empty.count() == tiles.labelled(empty, tile=TILE).count() == tiles.filled(empty, TILE).count() == 0


def test_repeated_voxels_are_one_before_they_reach_python(spark):
    rows = [("a", 0, 0, 0, v) for v in (float("nan"), 2.0, None, -1.0)] + [("a", 1, 1, 1, float("nan")), ("a", 2, 2, 2, -3.0)]
    made = tiles.from_voxels(spark.createDataFrame(rows, "image_id string, z int, y int, x int, value double"), (7, 9, 8), TILE, "value")
    assert {tuple(r) for r in tiles.voxels(made).collect()} == {("a", 0, 0, 0, 2.0), ("a", 2, 2, 2, -3.0)}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("FlatMapGroupsInPandas") :]
    assert any("Aggregate [image_id" in line and all(f"{c}#" in line for c in "zyx") for line in below.splitlines())


def plain_blend(a, predict, roi, overlap, kind, rounds, fill):
    wide = [(max(0, (r - n) // 2), max(0, r - n - (r - n) // 2)) for n, r in zip(a.shape, roi, strict=True)]
    padded = np.pad(a, wide, constant_values=fill)
    total, weight = np.zeros(padded.shape), np.zeros(padded.shape)
    axes = []
    for n, r, o in zip(padded.shape, roi, overlap, strict=True):
        step, at = max(1, int(r * (1 - o))), [0]
        while at[-1] + r < n:
            at.append(min(at[-1] + step, n - r))
        axes.append(at)
    w = tiles.importance(roi, kind)
    for low in itertools.product(*axes):
        part = tuple(slice(p, p + r) for p, r in zip(low, roi, strict=True))
        out = sum(np.clip(predict(padded[part]), 0, 1) for _ in range(rounds)) / rounds if rounds else predict(padded[part])
        total[part] += out * w
        weight[part] += w
    return (total / weight)[tuple(slice(p, p + n) for (p, _), n in zip(wide, a.shape, strict=True))]


def sharpened():
    """A stand-in model that depends on a voxel's place in its window."""
    return lambda a: a * 1.5 - 0.2 + 0.1 * np.linspace(0, 1, a.size).reshape(a.shape)


@pytest.mark.parametrize("kind,rounds,fill", [("constant", 1, 0.0), ("gaussian", 2, -1.0), ("gaussian", 0, 0.0)])
def test_blended_windows(spark, noise, kind, rounds, fill):
    roi, overlap = (6, 8, 8), (0.75, 0.25, 0.5)
    got = arrays_of(tiles.blended(cut(spark, noise), f"sharp-{kind}", sharpened, roi, overlap, kind, rounds, fill, TILE))
    for k, a in noise.items():
        assert np.allclose(got[k], plain_blend(a, sharpened(), roi, overlap, kind, rounds, fill), rtol=1e-12, atol=1e-12)


def test_three_planes(spark, noise):
    got = arrays_of(tiles.three_planes(cut(spark, noise), "planes", sharpened, 12, 8, 0.5, TILE))
    for k, a in noise.items():
        want = 0
        for axis, side in enumerate((12, 8, 8)):
            moved = np.moveaxis(a, axis, 0)
            model = lambda w: 1 / (1 + np.exp(-sharpened()(w[0])))[None]
            want = want + np.moveaxis(plain_blend(moved, model, (1, side, side), (0, 0.5, 0.5), "gaussian", 0, -1.0 if axis else 0.0), 0, axis)
        assert np.allclose(got[k], want / 3, rtol=1e-12, atol=1e-12)


def test_a_model_is_loaded_once_in_a_worker():
    calls = []
    for _ in range(3):
        tiles.loaded("once", lambda: calls.append(1) or (lambda a: a))
    assert len(calls) == 1


@pytest.mark.parametrize("masked", [False, True])
def test_tiled_analysis_is_that_of_whole_volumes(spark, masked):
    """Centreline, distances and areas, voxel by voxel; then every number of the whole analysis."""
    from filigree.plans.analysis import analyse, skeletons, tiled_skeletons
    from tests.test_engine import grid_volume

    a = grid_volume().astype(bool)
    at = np.argwhere(a)
    cells = spark.createDataFrame([("i", *map(int, p)) for p in at], "image_id string, z int, y int, x int")
    mask = spark.createDataFrame([("i", y, x) for y in range(40, 61) for x in range(10, 31)], "image_id string, y int, x int") if masked else None
    voxel = (3.0, 2.0, 2.0)
    want = {tuple(r)[:4]: tuple(r)[4:] for r in skeletons(table(spark, {"i": a}), mask, voxel, 0.6).collect()}
    got = {tuple(r)[:4]: tuple(r)[4:] for r in tiled_skeletons(cells, a.shape, mask, voxel, 0.6, (8, 64, 64)).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and (got[k][1] is None) == (want[k][1] is None) for k in want)
    assert all(got[k][1] == pytest.approx(want[k][1], rel=1e-12) for k in want if want[k][1] is not None) and any(v[0] for v in got.values())
    if not masked:
        one = analyse(table(spark, {"i": a}), a.shape, None, voxel, margin=2, ratio=10.0, sigma=0.6)["global_metrics"].first()
        two = analyse(cells, a.shape, None, voxel, margin=2, ratio=10.0, sigma=0.6, tile=(8, 64, 64))["global_metrics"].first()
        assert one.asDict().keys() == two.asDict().keys() and one["branches_per_volume"] > 0
        assert all(two[k] == (v if isinstance(v, str) or v is None else pytest.approx(v)) for k, v in one.asDict().items())
