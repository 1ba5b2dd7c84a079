"""Hull cells, crops, saved tiles, zipped arrays and output folders."""

import io
import zipfile

import numpy as np
import pytest

from filigree.operators import crop, tiles, volume
from filigree.sources import tables
from tests.test_tiles import arrays_of, cut


def test_hull_cells(spark):
    rng = np.random.default_rng(5)
    points = {"ball": np.array([p for p in rng.integers(0, 16, (300, 3)) if ((p - 8) ** 2).sum() < 50]), "box": np.argwhere(np.ones((3, 4, 5))) + 2, "flat": np.argwhere(np.ones((1, 4, 5))), "few": np.eye(3, dtype=int)}
    df = spark.createDataFrame([(k, *map(int, p)) for k, ps in points.items() for p in ps], "image_id string, z int, y int, x int")
    got = {}
    for r in volume.hull_cells(df).collect():
        got.setdefault(r["image_id"], []).append(tuple(r)[1:])
    assert got.keys() == {"ball", "box"}
    for k, cells in got.items():
        planes = volume.hull_planes(points[k])
        every = np.argwhere(np.ones((20, 20, 20)))
        want = every[(every @ planes[:, :3].T <= planes[:, 3] + 1e-9).all(1)]
        assert sorted(cells) == sorted(map(tuple, want.tolist()))
    assert len(got["box"]) == 60 and set(map(tuple, points["ball"].tolist())) <= set(got["ball"])


def plain_crop(mask, solid, size=4, window=5, pct=50, low=0.82, least=0.25):
    y, x = np.nonzero(mask)
    fy, fx = np.nonzero(solid)
    angle = 0.5 * np.arctan2(2 * ((fx - fx.mean()) * (fy - fy.mean())).mean(), fx.var() - fy.var())
    c, s = np.cos(angle), np.sin(angle)
    u, v = c * (x - x.mean()) + s * (y - y.mean()), -s * (x - x.mean()) + c * (y - y.mean())
    upright = np.ptp(v) >= np.ptp(u)
    long, short = (v, u) if upright else (u, v)
    at = np.floor(long / size).astype(int)
    bins = sorted(set(at))
    widths = np.array([np.ptp(short[at == b]) for b in bins])
    smooth = np.convolve(np.pad(widths, window // 2, mode="edge"), np.ones(window) / window, mode="valid")
    wide, best, run = smooth >= low * np.percentile(smooth, pct), [], []
    for b, w in zip(bins, wide, strict=True):
        run = [*run, b] if w and run and b == run[-1] + 1 else [b] if w else []
        best = run if len(run) > len(best) else best
    enough = len(best) >= max(1, int(np.ceil(least * (bins[-1] - bins[0] + 1))))
    a, b = (best[0] * size, (best[-1] + 1) * size) if enough else (long.min(), long.max())
    inside = short[(long >= a) & (long <= b)]
    lo, hi = ((inside.min(), a), (inside.max(), b)) if upright else ((a, inside.min()), (b, inside.max()))
    uv = [(lo[0], lo[1]), (hi[0], lo[1]), (hi[0], hi[1]), (lo[0], hi[1])]
    return angle, [(x.mean() + c * p - s * q, y.mean() + s * p + c * q) for p, q in uv]


def chamber(upright=False, tilt=0.0, gap=False, speck=False):
    """A wide part with narrow necks at both ends, with a hole; tilted, turned, with an empty bin or almost all neck."""
    yy, xx = np.mgrid[:150, :240]
    t = np.deg2rad(tilt)
    u, v = (xx - 120) * np.cos(t) + (yy - 75) * np.sin(t), -(xx - 120) * np.sin(t) + (yy - 75) * np.cos(t)
    out = (abs(u) < (8 if speck else 50)) & (abs(v) < 30) | (abs(u) < 95) & (abs(v) < 8)
    solid = out.copy()
    out &= ~((abs(u - 10) < 6) & (abs(v + 3) < 6))
    if gap:
        out &= ~((u > 18) & (u < 28))
        solid = out.copy()
        solid |= (abs(u - 10) < 6) & (abs(v + 3) < 6)
    return (out.T, solid.T) if upright else (out, solid)


def test_crop_without_necks(spark):
    cases = {"plain": chamber(), "upright": chamber(True, 3.0), "tilted": chamber(tilt=17), "gap": chamber(gap=True), "speck": chamber(speck=True)}
    rows = lambda i: [(k, int(y), int(x)) for k, m in cases.items() for y, x in np.argwhere(m[i])]
    mask, solid = (spark.createDataFrame(rows(i), "image_id string, y int, x int") for i in (0, 1))
    got = {r["image_id"]: r for r in crop.without_necks(mask, solid).collect()}
    assert got.keys() == cases.keys()
    for k, (m, s) in cases.items():
        angle, corners = plain_crop(m, s)
        assert got[k]["angle"] == pytest.approx(angle, abs=1e-9)
        assert np.allclose([(p["x"], p["y"]) for p in got[k]["corners"]], corners, atol=1e-6), k
        assert (got[k]["y"], got[k]["x"]) == pytest.approx(np.argwhere(m).mean(0))
    x = [p["x"] for p in got["plain"]["corners"]]
    assert max(x) - min(x) < 115  # without the necks, 190 long


def test_a_box_of_saved_tiles(spark, tmp_path):
    rng = np.random.default_rng(6)
    arrays, tile = {"a": rng.random((13, 17, 20)), "b": rng.random((12, 16, 9))}, (5, 8, 7)
    for _ in range(2):  # safe to repeat
        tiles.save(cut(spark, arrays, tile), str(tmp_path / "t"), tile)
    low, high = (4, 8, 5), (11, 12, 9)
    found = tiles.box(spark, str(tmp_path / "t"), low, high, tile)
    out = {k: np.full(a.shape, np.nan) for k, a in arrays.items()}
    for r in found.collect():
        a = tiles.unpacked(r.asDict())
        out[r["image_id"]][tuple(slice(p, p + n) for p, n in zip(r["low"], a.shape, strict=True))] = a
    at = tuple(slice(a, b) for a, b in zip(low, high, strict=True))
    for k, a in arrays.items():
        want = np.full(a.shape, np.nan)
        want[at] = a[at]
        assert np.array_equal(out[k], want, equal_nan=True)
    plan = tiles.box(spark, str(tmp_path / "t"), low, high, tile, ["a"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "iz#" in plan.split("PartitionFilters:")[1].split("]")[0] and "ix" in plan.split("PushedFilters:")[1].split("]")[0]
    assert {k: v.shape for k, v in arrays_of(spark.read.schema(tiles.SCHEMA).parquet(str(tmp_path / "t"))).items()} == {k: v.shape for k, v in arrays.items()}


def test_zipped_arrays(spark, tmp_path):
    pts, flags = np.arange(6.0).reshape(2, 3), np.array([True, False])
    np.savez(tmp_path / "stored.npz", pts=pts, is_sprout=flags)
    np.savez_compressed(tmp_path / "deflated.npz", pts=pts)
    with zipfile.ZipFile(tmp_path / "mixed.npz", "w") as archive:
        archive.writestr("note.txt", "no array")
        buffer = io.BytesIO()
        np.save(buffer, np.float32(3))
        archive.writestr("one.npy", buffer.getvalue())
    (tmp_path / "broken.npz").write_bytes(b"PK no archive")
    np.savez(tmp_path / "none.npz")
    found, ledger = tables.read_zipped_arrays(spark, str(tmp_path))
    got = {(r["path"].rsplit("/", 1)[1], r["member"]): np.frombuffer(r["data"], r["dtype"]).reshape(r["shape"]) for r in found.collect()}
    assert got.keys() == {("stored.npz", "pts"), ("stored.npz", "is_sprout"), ("deflated.npz", "pts"), ("mixed.npz", "one")}
    assert (got["stored.npz", "pts"] == pts).all() and (got["stored.npz", "is_sprout"] == flags).all() and (got["deflated.npz", "pts"] == pts).all() and got["mixed.npz", "one"] == 3
    said = {r["name"].rsplit("/", 1)[1]: (r["status"], r["message"]) for r in ledger.collect()}
    assert said["stored.npz"] == said["deflated.npz"] == ("OK", None) and said["broken.npz"][0] == said["mixed.npz"][0] == "FAILED" and "note.txt" in said["mixed.npz"][1]


def test_outputs_of_folders(spark, tmp_path):
    for folder, names in (("a", ["x_skeleton.npy", "b_skeleton.npy", "x_branch_metrics.csv", "x_clean_graph.pkl", "x_other.npy"]), ("b", ["y_full_graph_skeleton.npy", "y_organoid_mask.npy"])):
        (tmp_path / folder).mkdir()
        for name in names:
            (tmp_path / folder / name).write_bytes(b"x")
    got = {(r["folder"].rsplit("/", 1)[1], r["kind"]): r["path"].rsplit("/", 1)[1] for r in tables.outputs(spark, str(tmp_path)).collect()}
    assert got == {("a", "skeleton"): "b_skeleton.npy", ("a", "branch_metrics"): "x_branch_metrics.csv", ("a", "clean_graph"): "x_clean_graph.pkl", ("b", "skeleton"): "y_full_graph_skeleton.npy", ("b", "organoid_mask"): "y_organoid_mask.npy"}
