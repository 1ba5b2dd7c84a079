"""Volumes of any size as tiles: kernels with a halo, components and holes over tile borders, blended windows of a model.

A tile table has image_id, shape (of the whole volume: z, y, x), low (the first voxel of the tile), size, dtype and data
(bytes in C order). Tiles lie on a grid of a given size, those at the far borders may be smaller, and no two overlap. All that
an image needs to be whole is done by exchanging parts of tiles, grouped by what they are for: a halo, a window, a pair of
borders. So no task ever holds more than a tile with its surroundings, whatever the volume.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.operators import volume
from filigree.operators.components import components
from filigree.sources.scratch import discard, stored
from filigree.sources.workers import importable

SCHEMA = "image_id string, shape array<int>, low array<int>, size array<int>, dtype string, data binary"
TILE = (64, 256, 256)
KEYS = ["image_id", "key"]
#: Half of the neighbours of a voxel; the others are those that it is a neighbour of.
AHEAD = [o for o in itertools.product((-1, 0, 1), repeat=3) if o > (0, 0, 0)]

Box = tuple[tuple[int, ...], tuple[int, ...]]


def unpacked(row) -> np.ndarray:
    return np.frombuffer(row["data"], np.dtype(row["dtype"])).reshape(tuple(row["size"]))


def packed(image: str, shape: Iterable[int], low: Iterable[int], a: np.ndarray) -> dict:
    ints = lambda t: [int(x) for x in t]
    return {"image_id": image, "shape": ints(shape), "low": ints(low), "size": ints(a.shape), "dtype": a.dtype.str, "data": np.ascontiguousarray(a).tobytes()}


def grid(shape: Iterable[int], tile: tuple = TILE) -> list[tuple[int, ...]]:
    """The first voxels of all tiles."""
    return list(itertools.product(*(range(0, n, t) for n, t in zip(shape, tile, strict=True))))


def from_voxels(voxels: DataFrame, shape: tuple[int, int, int], tile: tuple = TILE, value: str | None = None) -> DataFrame:
    """All tiles of each image of (image_id, z, y, x): boolean, or the doubles of a column, 0 where no voxel is.

    Voxels outside the shape, and rows with a null place, don't count; of repeated voxels the greatest value does. An image
    with rows has all its tiles, also those without voxels; a null value is 0. Repeated voxels are one before tiles are built,
    so that no task holds more rows than a tile has voxels.
    """
    importable(voxels.sparkSession)
    corner = F.array(*(F.floor(F.col(c) / t).cast("int") * t for c, t in zip("zyx", tile, strict=True)))
    inside = functools.reduce(lambda a, b: a & b, [(F.col(c) >= 0) & (F.col(c) < n) for c, n in zip("zyx", shape, strict=True)])
    rows = voxels.select("image_id", *(F.col(c).cast("int").alias(c) for c in "zyx"), (F.col(value).cast("double") if value else F.lit(1.0)).alias("v"))
    once = rows.filter(inside).groupBy("image_id", *"zyx").agg(F.max(F.when(~F.isnan("v"), F.col("v"))).alias("v")).withColumn("key", corner)
    every = F.explode(F.array(*(F.array(*map(F.lit, low)) for low in grid(shape, tile))))
    none = rows.select("image_id").distinct().select("image_id", *(F.lit(None).cast("int").alias(c) for c in "zyx"), F.lit(None).cast("double").alias("v"), every.alias("key"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        low = np.array(pdf["key"].iloc[0])
        a = np.zeros(np.minimum(tile, np.array(shape) - low))
        known = pdf[pdf["z"].notna()]
        if len(known):
            a[tuple((known[c].to_numpy(int) - k) for c, k in zip("zyx", low, strict=True))] = known["v"].fillna(0.0)
        return pd.DataFrame([packed(pdf["image_id"].iloc[0], shape, low, a if value else a > 0)])

    return once.unionByName(none).groupBy(*KEYS).applyInPandas(build, SCHEMA)


def cut(volumes: DataFrame, tile: tuple = TILE) -> DataFrame:
    """Tiles of volumes that are one row each (image_id, shape, dtype, data)."""
    importable(volumes.sparkSession)

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                a = volume.unpack(row)
                for low in grid(a.shape, tile):
                    yield pd.DataFrame([packed(row["image_id"], a.shape, low, a[tuple(slice(p, p + t) for p, t in zip(low, tile, strict=True))])])

    return volumes.select("image_id", "shape", "dtype", "data").mapInPandas(run, SCHEMA)


def voxels(tiles: DataFrame) -> DataFrame:
    """(image_id, z, y, x, value) of all voxels that aren't 0."""
    importable(tiles.sparkSession)

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                a = unpacked(row)
                at = np.nonzero(a)
                yield pd.DataFrame({"image_id": row["image_id"], **{c: (i + k).astype(np.int32) for c, i, k in zip("zyx", at, row["low"], strict=True)}, "value": a[at].astype(np.float64)})

    return tiles.mapInPandas(run, "image_id string, z int, y int, x int, value double")


PART = "image_id string, key array<int>, shape array<int>, low array<int>, size array<int>, dtype string, data binary"


def _sent(tiles: DataFrame, targets: Callable[[dict], Iterable[tuple[tuple, Box]]]) -> DataFrame:
    """What each tile has of each target's box, under the target's key."""
    importable(tiles.sparkSession)

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                a, low = unpacked(row), row["low"]
                for key, (start, stop) in targets(row):
                    first = [max(p, s) for p, s in zip(low, start, strict=True)]
                    last = [min(p + n, s) for p, n, s in zip(low, a.shape, stop, strict=True)]
                    if all(f < e for f, e in zip(first, last, strict=True)):
                        part = a[tuple(slice(f - p, e - p) for f, e, p in zip(first, last, low, strict=True))]
                        yield pd.DataFrame([{"key": list(key), **packed(row["image_id"], row["shape"], first, part)}])

    return tiles.mapInPandas(run, PART)


def _met(pdf: pd.DataFrame, start: Iterable[int], stop: Iterable[int], fill: float = 0) -> np.ndarray:
    """A box of the parts that have come for it; fill where none has."""
    rows = pdf.to_dict("records")
    out = np.full([e - s for s, e in zip(start, stop, strict=True)], fill, np.dtype(rows[0]["dtype"]))
    for row in rows:
        a = unpacked(row)
        out[tuple(slice(p - s, p - s + n) for p, s, n in zip(row["low"], start, a.shape, strict=True))] = a
    return out


def _around(low: Iterable[int], size: Iterable[int], shape: Iterable[int], reach: tuple) -> Box:
    return tuple(max(0, p - r) for p, r in zip(low, reach, strict=True)), tuple(min(n, p + s + r) for p, s, n, r in zip(low, size, shape, reach, strict=True))


def _near(row: dict, tile: tuple, reach: tuple) -> list[tuple]:
    """First voxels of the tiles whose surroundings touch a tile."""
    axes = [range(max(0, (p - r) // t) * t, min(n, p + s + r), t) for p, s, n, r, t in zip(row["low"], row["size"], row["shape"], reach, tile, strict=True)]
    return list(itertools.product(*axes))


def mapped(tiles: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], reach: tuple, tile: tuple = TILE) -> DataFrame:
    """A kernel on each tile with up to `reach` voxels around it, of which the tile's own are kept.

    The result is that of the whole volume for kernels whose value at a voxel depends on no voxel further away, and which treat
    the ends of an array as those of the volume: at the volume's borders there are no voxels beyond. One shuffle: a tile
    goes to its own task, its outer layers to those of its neighbours.
    """
    size = lambda low, shape: [min(t, n - p) for p, n, t in zip(low, shape, tile, strict=True)]

    def targets(row):
        for low in _near(row, tile, reach):
            yield low, _around(low, size(low, row["shape"]), row["shape"], reach)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low, shape = tuple(pdf["key"].iloc[0]), tuple(pdf["shape"].iloc[0])
        own = size(low, shape)
        start, stop = _around(low, own, shape, reach)
        out = kernel(_met(pdf, start, stop))
        return pd.DataFrame([packed(pdf["image_id"].iloc[0], shape, low, out[tuple(slice(p - s, p - s + n) for p, s, n in zip(low, start, own, strict=True))])])

    return _sent(tiles, targets).groupBy(*KEYS).applyInPandas(run, SCHEMA)


def retiled(tiles: DataFrame, tile: tuple | Callable[[list[int]], tuple] | None = None) -> DataFrame:
    """The same volumes in tiles of another size, or of one that depends on the shape; without one, in whole planes.

    Every tile must be there.
    """

    def of(shape) -> tuple:
        return tile([int(n) for n in shape]) if callable(tile) else tile or (1, *(int(n) for n in shape[1:]))

    def targets(row):
        shape = [int(n) for n in row["shape"]]
        for low in _near({**row, "shape": shape}, of(shape), (0, 0, 0)):
            yield low, (low, tuple(min(n, p + t) for p, t, n in zip(low, of(shape), shape, strict=True)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low, shape = tuple(pdf["key"].iloc[0]), tuple(pdf["shape"].iloc[0])
        return pd.DataFrame([packed(pdf["image_id"].iloc[0], shape, low, _met(pdf, low, [min(n, p + t) for p, t, n in zip(low, of(shape), shape, strict=True)]))])

    return _sent(tiles, targets).groupBy(*KEYS).applyInPandas(run, SCHEMA)


def gaussian(tiles: DataFrame, sigma: float, tile: tuple = TILE, truncate: float = 4.0) -> DataFrame:
    return mapped(tiles, lambda a: volume.gaussian(a, sigma, truncate), (int(truncate * sigma + 0.5),) * 3, tile)


def smoothed(tiles: DataFrame, sigma: float = 3.0, tile: tuple = TILE) -> DataFrame:
    """Masks after a Gaussian, cut at one half."""
    return mapped(tiles, lambda a: volume.smoothed(a, sigma), (int(4 * sigma + 0.5),) * 3, tile)


def median(tiles: DataFrame, size: int = 7, tile: tuple = TILE) -> DataFrame:
    return mapped(tiles, lambda a: volume.median(a, size), (size // 2,) * 3, tile)


def near_distance(tiles: DataFrame, most: int, tile: tuple = TILE) -> DataFrame:
    """The distance of set voxels to the nearest unset one, in voxels; `most` where it is that or more."""
    return mapped(tiles, lambda a: np.minimum(volume.distance(a.astype(bool)), most), (most,) * 3, tile)


def numbered(inside: np.ndarray, full: bool, low: Iterable[int] = (0, 0, 0), shape: Iterable[int] | None = None) -> np.ndarray:
    """Components of a mask, 26 neighbours (full) or 6; each has the position (from 1, within `shape`) of its first voxel.

    Runs along x are nodes, pairs of neighbouring runs links; the least number goes along links, and by jumps to the least
    that a run's number knows itself, until nothing changes.
    """
    shape = inside.shape if shape is None else tuple(int(n) for n in shape)
    out = np.zeros(inside.shape, np.int64)
    if not inside.any():
        return out
    begins = inside.copy()
    begins[:, :, 1:] &= ~inside[:, :, :-1]
    run = np.cumsum(begins.reshape(-1)).reshape(inside.shape) - 1
    links = []
    for o in AHEAD:
        if sum(map(abs, o)) > (3 if full else 1) or o == (0, 0, 1):
            continue
        a = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(o, inside.shape, strict=True))
        b = tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(o, inside.shape, strict=True))
        both = inside[a] & inside[b]
        links.append(np.unique(np.stack([run[a][both], run[b][both]], axis=1), axis=0))
    links = np.unique(np.concatenate(links), axis=0)
    least = np.arange(run.max() + 1)
    while True:
        new = least.copy()
        np.minimum.at(new, links[:, 0], least[links[:, 1]])
        np.minimum.at(new, links[:, 1], least[links[:, 0]])
        np.minimum.at(new, least, new)  # a run's number hears of it, too
        new = new[new]
        if (new == least).all():
            break
        least = new
    at = np.argwhere(begins) + np.array(list(low))
    first = (at[:, 0] * shape[1] + at[:, 1]) * shape[2] + at[:, 2] + 1
    out[inside] = first[least[run[inside]]]
    return out


def _kept(tiles: DataFrame) -> DataFrame:
    """Tiles that are read more than once, written before if they aren't yet."""
    return tiles if hasattr(tiles, "_stored_at") else stored(tiles, "tiles")


def _components(tiles: DataFrame, inside: Callable[[np.ndarray], np.ndarray], flag: Callable[[np.ndarray, dict], np.ndarray], full: bool, tile: tuple) -> tuple[DataFrame, DataFrame]:
    """Tiles of numbers within each tile, and (image_id, key, label, root, flagged) of all these numbers.

    inside: which voxels count. flag: which voxels mark their component, wherever the rest of it is. Each tile is numbered by
    itself; its outermost layers meet those of its neighbours, and pairs of numbers that touch there are links of a graph
    whose components are those of the volume. Layers, links and a row for each number are all that is shuffled.
    """
    importable(tiles.sparkSession)
    tiles = _kept(tiles)

    def number(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                yield pd.DataFrame([packed(row["image_id"], row["shape"], row["low"], numbered(inside(unpacked(row)), full, row["low"], row["shape"]))])

    def facts(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                labels = numbered(inside(a := unpacked(row)), full, row["low"], row["shape"])
                on = labels > 0
                own, at = np.unique(labels[on], return_inverse=True)
                marked = np.bincount(at, flag(a, row)[on], len(own)) > 0
                if len(own):
                    yield pd.DataFrame({"image_id": row["image_id"], "key": [list(row["low"])] * len(own), "label": own, "flag": marked})

    labels = stored(tiles.mapInPandas(number, SCHEMA), "labels")
    own = tiles.mapInPandas(facts, "image_id string, key array<int>, label long, flag boolean")

    def layers(row):
        low, size, shape = row["low"], row["size"], row["shape"]
        for key in _near(row, tile, (1, 1, 1)):
            if key != tuple(low):
                yield key, _around(key, [min(t, n - p) for p, n, t in zip(key, shape, tile, strict=True)], shape, (1, 1, 1))
                continue
            for axis in range(3):  # of its own, the six faces
                for p in {low[axis], low[axis] + size[axis] - 1}:
                    start, stop = list(low), [a + n for a, n in zip(low, size, strict=True)]
                    start[axis], stop[axis] = p, p + 1
                    yield key, (tuple(start), tuple(stop))

    def touching(pdf: pd.DataFrame) -> pd.DataFrame:
        low, shape = tuple(pdf["key"].iloc[0]), tuple(pdf["shape"].iloc[0])
        start, stop = _around(low, [min(t, n - p) for p, n, t in zip(low, shape, tile, strict=True)], shape, (1, 1, 1))
        a, pairs = _met(pdf, start, stop), [np.zeros((0, 2), np.int64)]
        for o in AHEAD:
            if sum(map(abs, o)) > (3 if full else 1):
                continue
            x = a[tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(o, a.shape, strict=True))]
            y = a[tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(o, a.shape, strict=True))]
            both = (x > 0) & (y > 0) & (x != y)
            pairs.append(np.stack([x[both], y[both]], axis=1))
        found = np.unique(np.concatenate(pairs), axis=0)
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "x": found[:, 0], "y": found[:, 1]})

    links = _sent(labels, layers).groupBy(*KEYS).applyInPandas(touching, "image_id string, x long, y long")
    roots = components(links.select(F.struct("image_id", F.col("x").alias("label")).alias("a"), F.struct("image_id", F.col("y").alias("label")).alias("b")))
    roots = roots.select(F.col("node.image_id").alias("image_id"), F.col("node.label").alias("label"), F.col("root.label").alias("root"))
    known = stored(own.join(roots, ["image_id", "label"], "left").withColumn("root", F.coalesce("root", "label")), "numbers")
    flags = known.groupBy("image_id", "root").agg(F.bool_or("flag").alias("flagged"))
    return labels, known.join(flags, ["image_id", "root"]).select("image_id", "key", "label", "root", "flagged")


def _renumbered(tiles: DataFrame, changes: DataFrame, final: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """final(tile, its numbers, their roots, their flags), where numbers are sorted; with nothing else of the volume."""

    def run(key: tuple, t: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(t):
            return pd.DataFrame(columns=["image_id", "shape", "low", "size", "dtype", "data"])
        row, c = t.to_dict("records")[0], c.sort_values("label")
        return pd.DataFrame([packed(row["image_id"], row["shape"], row["low"], final(unpacked(row), *(c[x].to_numpy(k) for x, k in (("label", np.int64), ("root", np.int64), ("flagged", bool)))))])

    return tiles.withColumn("key", F.col("low")).groupBy(*KEYS).cogroup(changes.groupBy(*KEYS)).applyInPandas(run, SCHEMA)


def labelled(tiles: DataFrame, full: bool = True, tile: tuple = TILE) -> DataFrame:
    """Components of masks over all tiles: each voxel has the position, from 1, of its component's first voxel; 0 outside."""
    labels, changes = _components(tiles, lambda a: a.astype(bool), lambda a, row: np.zeros(a.shape, bool), full, tile)

    def final(a, label, root, flagged):
        return np.where(a > 0, root[np.searchsorted(label, a).clip(0, max(len(root) - 1, 0))], 0) if len(label) else a

    return _renumbered(labels, changes, final)


def _chosen(tiles: DataFrame, inside, flag, tile: tuple, wanted: bool) -> DataFrame:
    """Tiles of whether a voxel is inside and its component (6 neighbours) is flagged, or isn't."""
    labels, changes = _components(tiles, inside, flag, False, tile)

    def final(a, label, root, flagged):
        return (a > 0) & (flagged == wanted)[np.searchsorted(label, a).clip(0, len(label) - 1)] if len(label) else np.zeros(a.shape, bool)

    return _renumbered(labels, changes, final)


def filled(tiles: DataFrame, tile: tuple = TILE) -> DataFrame:
    """Masks with their holes filled: background that reaches the volume's border nowhere, through whatever tiles."""

    def border(a: np.ndarray, row: dict) -> np.ndarray:
        out = np.zeros(a.shape, bool)
        for axis, (p, s, n) in enumerate(zip(row["low"], row["size"], row["shape"], strict=True)):
            at = np.moveaxis(out, axis, 0)
            if p == 0:
                at[0] = True
            if p + s == n:
                at[-1] = True
        return out

    tiles = _kept(tiles)
    holes = _chosen(tiles, lambda a: ~a.astype(bool), border, tile, False)
    both = tiles.withColumn("key", F.col("low")).groupBy(*KEYS).cogroup(holes.withColumn("key", F.col("low")).groupBy(*KEYS))

    def run(key: tuple, t: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        a, b = t.to_dict("records")[0], h.to_dict("records")[0]
        return pd.DataFrame([packed(a["image_id"], a["shape"], a["low"], unpacked(a).astype(bool) | unpacked(b))])

    return both.applyInPandas(run, SCHEMA)


def hysteresis(tiles: DataFrame, low: float = 0.2, high: float = 0.5, tile: tuple = TILE) -> DataFrame:
    """Voxels above the low threshold whose component, by faces, has one above the high threshold."""
    return _chosen(tiles, lambda a: a > low, lambda a, row: a > high, tile, True)


def _each(tiles: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A kernel on each tile by itself; nothing is shuffled."""
    importable(tiles.sparkSession)

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                yield pd.DataFrame([packed(row["image_id"], row["shape"], row["low"], kernel(unpacked(row)))])

    return tiles.mapInPandas(run, SCHEMA)


def count(tiles: DataFrame) -> int:
    """Of all voxels that are set."""
    importable(tiles.sparkSession)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [sum(int(np.count_nonzero(unpacked(r))) for r in pdf.to_dict("records"))]})

    return tiles.mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def distance(tiles: DataFrame, sampling: tuple | None = None, tile: tuple = TILE) -> DataFrame:
    """Exact Euclidean distance of each set voxel to the nearest unset one of the whole volume; infinite if there is none.

    Axis by axis as on one array: tiles are cut anew so that lines along an axis are whole, and as many of them together as a
    tile has voxels. Four shuffles of the volume.
    """
    sampling = sampling or (1.0, 1.0, 1.0)
    found = _each(tiles, lambda a: np.where(a.astype(bool), np.inf, 0.0))
    for axis in range(3):

        def pass_(a: np.ndarray, axis: int = axis) -> np.ndarray:
            moved = np.moveaxis(a, axis, -1)
            return np.moveaxis(volume.lowered(np.ascontiguousarray(moved).reshape(-1, a.shape[axis]), float(sampling[axis])).reshape(moved.shape), -1, axis)

        found = _each(retiled(found, _slab(axis, tile)), pass_)
    return retiled(_each(found, np.sqrt), tile)


def thinned(tiles: DataFrame, tile: tuple = TILE) -> DataFrame:
    """Centrelines, voxel by voxel those of the whole volume: rounds of thinning with what a round can reach around each tile.

    Tiles must have even sides (voxels go by the parity of their place). A round is a shuffle of the volume; there are as many
    as the thickest part has layers. A count of voxels reaches the driver.
    """
    if any(t % 2 for t in tile):
        raise ValueError("tiles for thinning have even sides")

    def once(a: np.ndarray) -> np.ndarray:
        wide = np.pad(a.astype(bool), 1)
        volume.thinned_once(wide)
        return wide[1:-1, 1:-1, 1:-1]

    left, before = _kept(tiles), None
    while True:
        new = stored(mapped(left, once, (volume.THINNING_REACH,) * 3, tile), "thinned")
        now = count(new)
        if left is not tiles:
            discard(left)
        if now == before or not now:
            return new
        left, before = new, now


def _slab(axis: int, tile: tuple) -> Callable[[list[int]], tuple]:
    """Tiles that are whole along an axis, with about as many voxels as a tile."""

    def of(shape: list[int]) -> tuple:
        side = max(1, math.isqrt(math.prod(tile) // shape[axis]))
        return tuple(n if i == axis else min(n, side) for i, n in enumerate(shape))

    return of


def resized(tiles: DataFrame, factors: tuple, tile: tuple = TILE) -> DataFrame:
    """Volumes with so many times as many voxels along each axis, rounded half to even, at least one: by cubic splines, smoothed
    before where an axis shrinks, within the values' range, and of their type.

    Axis by axis, over tiles that are whole along it; the range comes from one aggregate.
    """
    tiles = _kept(tiles)

    def ends(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                a = unpacked(row)
                yield pd.DataFrame({"image_id": [row["image_id"]], "least": [float(a.min())], "most": [float(a.max())], "kind": [row["dtype"]]})

    found = _each(tiles, lambda a: a.astype(np.float64))
    for axis, factor in enumerate(factors):

        def run(batches, axis: int = axis, factor: float = factor):
            for pdf in batches:
                for row in pdf.to_dict("records"):
                    shape = [int(n) for n in row["shape"]]
                    shape[axis] = volume.resized_shape((shape[axis],), (factor,))[0]
                    yield pd.DataFrame([packed(row["image_id"], shape, row["low"], volume.recut(unpacked(row), shape[axis], axis))])

        found = retiled(found, _slab(axis, tile)).mapInPandas(run, SCHEMA)

    def clipped(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                yield pd.DataFrame([packed(row["image_id"], row["shape"], row["low"], np.clip(unpacked(row), row["least"], row["most"]).astype(row["kind"]))])

    bounds = tiles.mapInPandas(ends, "image_id string, least double, most double, kind string").groupBy("image_id").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.first("kind").alias("kind"))
    cells = retiled(found, tile).withColumn("_image", F.to_json(F.struct("image_id")))
    return cells.join(bounds.withColumn("_image", F.to_json(F.struct("image_id"))).drop("image_id"), "_image").drop("_image").mapInPandas(clipped, SCHEMA)


def margins_cut(tiles: DataFrame, low: tuple, high: tuple, tile: tuple = TILE) -> DataFrame:
    """Volumes without so many voxels before and behind along each axis, moved to the origin; what would have none left has no row."""
    importable(tiles.sparkSession)

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                shape = [int(n) - a - b for n, a, b in zip(row["shape"], low, high, strict=True)]
                first = [max(int(p), a) for p, a in zip(row["low"], low, strict=True)]
                last = [min(int(p) + int(s), int(n) - b) for p, s, n, b in zip(row["low"], row["size"], row["shape"], high, strict=True)]
                if min(shape) > 0 and all(f < e for f, e in zip(first, last, strict=True)):
                    part = unpacked(row)[tuple(slice(f - p, e - p) for f, e, p in zip(first, last, row["low"], strict=True))]
                    yield pd.DataFrame([packed(row["image_id"], shape, [f - a for f, a in zip(first, low, strict=True)], part)])

    return retiled(tiles.mapInPandas(run, SCHEMA), tile)


def fitted_masks(planes: DataFrame, height: int, width: int) -> DataFrame:
    """Plane masks (tiles of one plane an image) brought to a size: see volume.fitted_mask."""
    importable(planes.sparkSession)

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                yield pd.DataFrame([packed(row["image_id"], [1, height, width], [0, 0, 0], volume.fitted_mask(unpacked(row)[0], height, width)[None])])

    return planes.mapInPandas(run, SCHEMA)


def projected(tiles: DataFrame) -> DataFrame:
    """Which columns (image_id, y, x) have a set voxel, as tiles of one plane."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        flat = functools.reduce(np.logical_or, (unpacked(r).any(axis=0) for r in pdf.to_dict("records")))
        return pd.DataFrame([packed(row["image_id"], [1, *row["shape"][1:]], [0, *row["low"][1:]], flat[None])])

    return tiles.withColumn("key", F.slice("low", 2, 2)).groupBy(*KEYS).applyInPandas(run, SCHEMA)


_loaded: dict[str, Callable] = {}


def loaded(name: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> Callable[[np.ndarray], np.ndarray]:
    """A model, loaded by the first task of a worker that needs it, and used by all that come after."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def importance(roi: tuple, kind: str = "gaussian") -> np.ndarray:
    """Weights of a window's voxels: equal, or a Gaussian around the middle, an eighth of the window wide, at least 0.001."""
    if kind == "constant":
        return np.ones(roi)
    axes = [np.exp(-0.5 * ((np.arange(n) - (n - 1) / 2) / (0.125 * n)) ** 2) for n in roi]
    return np.maximum(axes[0][:, None, None] * axes[1][None, :, None] * axes[2][None, None, :], 1e-3)


def _starts(n: int, r: int, overlap: float) -> list[int]:
    """First voxels of windows along an axis; one that is shorter than a window has one, which starts before it by half the rest."""
    if n <= r:
        return [-((r - n) // 2)]
    step = r if r == 1 else max(1, int(r * (1 - overlap)))
    return sorted({min(i, n - r) for i in range(0, n - r + step, step)})


def blended(tiles: DataFrame, name: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]], roi: tuple, overlap: tuple, kind: str = "constant", rounds: int = 1, fill: float = 0.0, tile: tuple = TILE) -> DataFrame:
    """A model's predictions for overlapping windows, averaged by weight at each voxel.

    load() gives the model, a function of a window (roi, doubles) to one of the same shape; it is called once in a worker and
    named, so that other calls find it. Windows that are larger than the volume are filled. rounds: predictions of a window,
    each clipped to 0 to 1, whose mean counts; 0 takes one as it is. Two shuffles: parts of tiles to windows, and
    weighted parts of windows to tiles.
    """

    def touched(start: int, stop: int, n: int, r: int, o: float) -> list[int]:
        return [s for s in _starts(n, r, o) if s < stop and s + r > start]

    def targets(row):
        for low in itertools.product(*(touched(p, p + s, n, r, o) for p, s, n, r, o in zip(row["low"], row["size"], row["shape"], roi, overlap, strict=True))):
            yield low, (low, tuple(p + r for p, r in zip(low, roi, strict=True)))

    def predict(pdf: pd.DataFrame) -> pd.DataFrame:
        start, shape = tuple(int(x) for x in pdf["key"].iloc[0]), tuple(int(x) for x in pdf["shape"].iloc[0])
        a = np.full(roi, fill)
        for row in pdf.to_dict("records"):
            part = unpacked(row)
            a[tuple(slice(p - s, p - s + n) for p, s, n in zip(row["low"], start, part.shape, strict=True))] = part
        model = loaded(name, load)
        out = sum(np.clip(model(a), 0, 1) for _ in range(rounds)) / rounds if rounds else model(a)
        weight = importance(roi, kind)
        weighted, rows = np.stack([out * weight, weight]), []
        low, high = [max(0, s) for s in start], [min(n, s + r) for n, s, r in zip(shape, start, roi, strict=True)]
        for key in itertools.product(*(range(p // t * t, q, t) for p, q, t in zip(low, high, tile, strict=True))):
            first = [max(k, p) for k, p in zip(key, low, strict=True)]
            last = [min(k + t, q) for k, t, q in zip(key, tile, high, strict=True)]
            part = weighted[(slice(None), *(slice(f - s, e - s) for f, e, s in zip(first, last, start, strict=True)))]
            rows.append({"key": list(key), **packed(pdf["image_id"].iloc[0], shape, first, part)})
        return pd.DataFrame(rows)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        low, shape = tuple(pdf["key"].iloc[0]), tuple(pdf["shape"].iloc[0])
        out = np.zeros((2, *(min(t, n - p) for p, n, t in zip(low, shape, tile, strict=True))))
        rows = sorted(pdf.to_dict("records"), key=lambda r: (tuple(r["low"]), tuple(r["size"]), r["data"]))  # sums in one order
        for row in rows:
            part = unpacked(row)
            out[(slice(None), *(slice(p - s, p - s + n) for p, s, n in zip(row["low"], low, part.shape[1:], strict=True)))] += part
        return pd.DataFrame([packed(pdf["image_id"].iloc[0], shape, low, out[0] / out[1])])

    return _sent(tiles, targets).groupBy(*KEYS).applyInPandas(predict, PART).groupBy(*KEYS).applyInPandas(total, SCHEMA)


def three_planes(tiles: DataFrame, name: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]], flat: int = 1024, upright: int = 256, overlap: float = 0.5, tile: tuple = TILE) -> DataFrame:
    """The mean of a plane model's sigmoids over slices along each axis, windows of each slice blended by a Gaussian.

    Upright slices of volumes that aren't as high as a window are filled with -1. load() gives a function of a plane.
    """

    def along(axis: int):
        def model():
            plane = load()
            return lambda a: np.expand_dims(1 / (1 + np.exp(-plane(np.squeeze(a, axis)))), axis)

        return model

    parts, tiles = [], _kept(tiles)
    for axis in range(3):
        side = flat if axis == 0 else upright
        roi = tuple(1 if i == axis else side for i in range(3))
        share = tuple(0.0 if i == axis else overlap for i in range(3))
        parts.append(blended(tiles, f"{name}/{axis}", along(axis), roi, share, "gaussian", 0, -1.0 if axis else 0.0, tile))

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.to_dict("records")
        return pd.DataFrame([packed(rows[0]["image_id"], rows[0]["shape"], rows[0]["low"], sum(sorted(map(unpacked, rows), key=lambda a: a.tobytes())) / len(rows))])

    return functools.reduce(DataFrame.unionByName, parts).withColumn("key", F.col("low")).groupBy(*KEYS).applyInPandas(mean, SCHEMA)


def save(tiles: DataFrame, path: str, tile: tuple = TILE) -> None:
    """Tiles as a table to read boxes from: by image, and by the tile's number along z and y; a repeated call replaces its images'."""
    numbers = {f"i{c}": F.floor(F.col("low")[i] / t).cast("int") for i, (c, t) in enumerate(zip("zyx", tile, strict=True))}
    out = tiles.withColumns(numbers).repartition("image_id", "iz", "iy").sortWithinPartitions("image_id", "iz", "iy", "ix")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("image_id", "iz", "iy").parquet(path)


def box(spark: SparkSession, path: str, low: tuple, high: tuple, tile: tuple = TILE, images: list[str] | None = None) -> DataFrame:
    """The parts of saved tiles within a box (low included, high not): only the files and row groups of tiles that it touches are read."""
    rows = spark.read.schema(f"{SCHEMA}, iz int, iy int, ix int").parquet(path)
    for c, a, b, t in zip("zyx", low, high, tile, strict=True):
        rows = rows.filter(F.col(f"i{c}").between(a // t, max(a, b - 1) // t))
    rows = rows.filter(F.col("image_id").isin(images)) if images is not None else rows
    return _sent(rows.select(*(c.split()[0] for c in SCHEMA.split(", "))), lambda row: [(tuple(low), (tuple(low), tuple(high)))]).drop("key")


def whole(tiles: DataFrame) -> DataFrame:
    """Volumes in one row each, for those that fit (below 2 GB)."""
    importable(tiles.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = tuple(pdf["shape"].iloc[0])
        return pd.DataFrame([volume.pack(pdf["image_id"].iloc[0], _met(pdf, [0] * len(shape), shape))])

    return tiles.groupBy("image_id").applyInPandas(run, volume.SCHEMA)


def tile_count(shape: Iterable[int], tile: tuple = TILE) -> int:
    return math.prod(-(-n // t) for n, t in zip(shape, tile, strict=True))
