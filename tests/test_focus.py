"""The curved focus plane against NumPy on whole stacks."""

import numpy as np
import pytest

from filigree.operators import device, focus, tiles, volume


def stack_of(seed=1, shape=(9, 60, 80), bend=True):
    """Texture that is sharp near a curved surface and washed out elsewhere."""
    rng = np.random.default_rng(seed)
    z, h, w = shape
    y, x = np.mgrid[:h, :w]
    surface = np.clip(2 + 5 * ((x - w / 2) / w) ** 2 + 3 * y / h, 0, z - 1) if bend else np.full((h, w), z // 2)
    return rng.random((h, w))[None] * np.exp(-((np.arange(z)[:, None, None] - surface[None]) ** 2) / 2) + 0.01 * rng.random(shape)


def plain_surface(a, points, patch):
    z, h, w = a.shape
    if points**2 < 6:
        return np.full((h, w), int(np.argmax([np.float32(device.sobel(p).std()) for p in a])))
    at, best = [], []
    for y in np.linspace(patch // 2, h - patch // 2 - 1, points).astype(int):
        for x in np.linspace(patch // 2, w - patch // 2 - 1, points).astype(int):
            cut = a[:, y - patch // 2 : y + patch // 2, x - patch // 2 : x + patch // 2]
            at.append((x, y))
            best.append(np.argmax([np.float32(device.sobel(p).std()) for p in cut]))
    at = np.array(at, float)
    mean, scale = at.mean(0), max(h, w)
    design = lambda x, y: np.stack([x**2, y**2, x * y, x, y, np.ones_like(x)], -1)
    c = np.linalg.lstsq(design(*((at - mean) / scale).T), np.array(best, float), rcond=None)[0]
    yy, xx = np.mgrid[:h, :w]
    return np.clip(np.rint(design((xx - mean[0]) / scale, (yy - mean[1]) / scale) @ c), 0, z - 1).astype(int)


def plain_refocus(a, zmap):
    ref = int(np.clip(np.rint(np.median(zmap)), 0, len(a) - 1))
    out = np.empty_like(a)
    for k in range(len(a)):
        for (y, x), m in np.ndenumerate(zmap):
            out[k, y, x] = a[min(max(m + k - ref, 0), len(a) - 1), y, x]
    return out


def arrays_of(found):
    out = {}
    for r in found.collect():
        a = out.setdefault(r["image_id"], np.full(r["shape"], np.nan))
        a[r["low"][0]] = tiles.unpacked(r.asDict())[0]
    assert not any(np.isnan(a).any() for a in out.values())
    return out


@pytest.fixture(scope="module")
def stacks():
    return {"bent": stack_of(), "flat": stack_of(2, (5, 50, 40), False), "one": stack_of(3, (1, 30, 31)), "same": np.zeros((4, 30, 30))}


@pytest.fixture(scope="module")
def planes(spark, stacks):
    return tiles.retiled(tiles.cut(spark.createDataFrame([volume.pack(k, a) for k, a in stacks.items()], volume.SCHEMA), (3, 16, 25)))


@pytest.mark.parametrize("points", [5, 3, 2, 1])  # fewer than 6 patches: the sharpest plane
def test_surface_and_refocused_stack(spark, stacks, planes, points):
    surface = focus.surfaces(planes, points, 12)
    found = {r["image_id"]: r.asDict() for r in surface.collect()}
    want = {k: plain_surface(a, points, 12) for k, a in stacks.items()}
    assert found.keys() == stacks.keys()
    for k, r in found.items():
        assert np.array_equal(focus.heights(r), want[k]), k
    seen = arrays_of(focus.in_focus(planes, surface))
    bent = arrays_of(focus.refocused(planes, surface))
    for k, a in stacks.items():
        assert np.array_equal(seen[k][0], np.take_along_axis(a, want[k][None], 0)[0])
        assert np.array_equal(bent[k], plain_refocus(a, want[k]))
    if points == 5:
        assert np.ptp(want["bent"]) >= 3  # it is a curved one


def test_votes(spark, stacks, planes):
    got = {}
    for r in focus.votes(planes, 5, 30).collect():
        got.setdefault(r["image_id"], {})[r["z"]] = r["votes"]
    for k, a in stacks.items():
        z, h, w = a.shape
        want = np.zeros(z, int)
        if h <= 30 or w <= 30:
            want[np.argmax([np.float32(device.sobel(p).std()) for p in a])] = 1
        else:
            for y in np.linspace(15, h - 16, 5).astype(int):
                for x in np.linspace(15, w - 16, 5).astype(int):
                    want[np.argmax([np.float32(device.sobel(p[y - 15 : y + 15, x - 15 : x + 15]).std()) for p in a])] += 1
        assert got[k] == dict(enumerate(want.tolist())), k


def test_finalised_jobs(spark, stacks, planes):
    corner = lambda x, y: {"x": float(x), "y": float(y)}
    box = [corner(20, 15), corner(45, 15), corner(45, 40), corner(20, 40)]
    rows = [("bent", box[::-1], 6.0, 2.0, 3.0, 1), ("flat", None, 6.0, 2.0, 2.0, 1), ("one", box, 6.0, None, 2.0, 1), ("gone", box, 6.0, 2.0, 2.0, 1)]
    jobs = spark.createDataFrame(rows, "image_id string, inner_corners array<struct<x:double,y:double>>, device_width_um double, x_um double, y_um double, focus_downsample int")
    crops, votes, ledger = focus.finalised(planes, jobs, 5, 12)
    assert {r["name"]: r["message"] for r in ledger.collect()} == {"bent": None, "flat": "no corners", "one": "no voxel size", "gone": "no stack"}
    got = arrays_of(crops)
    flat = plain_refocus(stacks["bent"], plain_surface(stacks["bent"], 5, 12))
    assert got.keys() == {"bent"} and np.allclose(got["bent"], flat[:, 13:43, 17:49][:, : got["bent"].shape[1], : got["bent"].shape[2]])
    assert abs(got["bent"].shape[1] - 30) <= 1 and abs(got["bent"].shape[2] - 32) <= 1  # 2 pixels more to each side upwards, 3 sideways
    assert votes.agg({"votes": "sum"}).first()[0] == 25
