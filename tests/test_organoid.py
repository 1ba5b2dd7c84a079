"""Masks of drawn planes, one for each branch of the cascade, and the kernels against plain versions."""

import numpy as np
import pytest

from filigree.operators import device, organoid, tiles, volume

SIDE = 220


def disk(radius, y=SIDE // 2, x=SIDE // 2, side=SIDE):
    yy, xx = np.mgrid[:side, :side]
    return (yy - y) ** 2 + (xx - x) ** 2 <= radius**2


def plane(*parts, ground=0.5, noise=0.01, seed=1, side=SIDE):
    out = np.full((side, side), ground) + noise * np.random.default_rng(seed).standard_normal((side, side))
    for mask, value in parts:
        out[mask] = value + noise * np.random.default_rng(seed + 1).standard_normal(int(mask.sum()))
    return out


def agreement(a, b):
    return (a & b).sum() / max(1, (a | b).sum())


def test_dark_object():
    got = organoid.mask_of(plane((disk(40), 0.1)))
    assert agreement(got, disk(40)) > 0.93


def test_the_central_one_counts():
    got = organoid.mask_of(plane((disk(40), 0.1), (disk(36, 40, 40), 0.1)))
    assert agreement(got, disk(40)) > 0.93 and not got[40, 40]


def test_light_object():
    got = organoid.mask_of(plane((disk(25), 0.9)), "light")  # with what the smoothing adds, and 20 pixels around
    assert (got & disk(30)).sum() == disk(30).sum() and not (got & ~disk(60)).any()


def test_small_light_object_is_joined_where_it_touches(monkeypatch):
    monkeypatch.setattr(organoid, "yen", lambda a: 0.7)  # of both planes
    side, middle = 400, 200
    small = disk(5, middle, middle, side)
    for at, joined in ((middle + 80, True), (middle + 130, False)):
        dark = disk(60, middle, at, side)
        image = plane((dark, 0.1), (small, 0.95), side=side, noise=1e-4)
        bright = volume.gaussian(image, 1.0)
        share = organoid.central(organoid.nearest_label(device.labelled(bright > 0.7), 20))[1]
        assert organoid.SMALL[0] <= share <= organoid.SMALL[1]
        got = organoid.mask_of(image, "light", 1.0)
        assert (got & dark).sum() > 0.97 * dark.sum()
        assert got[middle, middle] == joined


def test_otsu_where_yens_region_does_not_fit(monkeypatch):
    image = plane((disk(40), 0.1))
    monkeypatch.setattr(organoid, "yen", lambda a: a.min() - 1)  # all of the plane
    assert agreement(organoid.mask_of(image), disk(40)) > 0.93


def test_erosion_where_otsus_region_is_too_large(monkeypatch):
    """An object and a bar that bridges it to the border, which an erosion parts."""
    bar = np.zeros((SIDE, SIDE), bool)
    bar[:, :30] = bar[100:118, :110] = True
    image = plane((disk(42), 0.1), (bar, 0.1))
    monkeypatch.setattr(organoid, "yen", lambda a: a.min() - 1)
    got = organoid.mask_of(image)
    assert not got[:, :20].any() and agreement(got, disk(42)) > 0.8


def test_minimum_where_neither_fits(monkeypatch):
    image = plane((disk(40), 0.1))
    for name in ("yen", "otsu"):
        monkeypatch.setattr(organoid, name, lambda a: a.max() - 1e-3 * np.ptp(a))  # next to nothing
    assert agreement(organoid.mask_of(image), disk(40)) > 0.93


def test_nothing_fits_and_nothing_at_all(monkeypatch):
    with pytest.raises(ValueError, match="fitting size|two peaks"):
        organoid.mask_of(plane((disk(100), 0.1)))
    monkeypatch.setattr(organoid, "yen", lambda a: a.max() + 1)
    assert not organoid.mask_of(plane()).any()


def test_minimum_is_between_the_peaks():
    rng = np.random.default_rng(2)
    a = np.concatenate([rng.normal(0, 1, 5000), rng.normal(8, 1, 3000)])
    assert 2 < organoid.minimum(a) < 6
    with pytest.raises(ValueError, match="two peaks"):
        organoid.minimum(np.repeat(np.arange(256), np.arange(256)))  # it only rises


def test_nearest_label_against_all_pairs():
    rng = np.random.default_rng(3)
    for reach in (1, 4, 9):
        labels = np.where(rng.random((23, 31)) < 0.03, rng.integers(1, 9, (23, 31)), 0)
        at = np.argwhere(labels > 0)
        got = organoid.nearest_label(labels, reach)
        for (y, x), k in np.ndenumerate(got):
            d = ((at - (y, x)) ** 2).sum(1)
            want = min(labels[tuple(p)] for p in at[d == d.min()]) if d.min() <= reach**2 else 0
            assert k == want


def test_holes_by_area():
    mask = ~disk(0, 5, 5, 40) & ~disk(3, 20, 20, 40)
    mask[0, 0] = mask[30:, 30:] = False
    got = organoid.holes_filled(mask, 10)
    assert got[5, 5] and got[0, 0] and not got[20, 20] and not got[35, 35]
    assert organoid.holes_filled(mask, 30)[20, 20] and organoid.holes_filled(np.zeros((4, 4), bool), 5).sum() == 0


def test_masks_of_planes(spark):
    arrays = {"good": plane((disk(40), 0.1))[None], "bad": plane((disk(100), 0.1))[None]}
    planes = tiles.retiled(tiles.cut(spark.createDataFrame([volume.pack(k, a) for k, a in arrays.items()], volume.SCHEMA), (1, 100, 100)))
    found, ledger = organoid.masks(planes)
    assert {r["name"]: r["status"] for r in ledger.collect()} == {"good": "OK", "bad": "FAILED"}
    (row,) = found.collect()
    assert np.array_equal(tiles.unpacked(row.asDict())[0], organoid.mask_of(arrays["good"][0]))
