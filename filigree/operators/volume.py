"""Dense kernels on one image's volume, in NumPy; images run in parallel as groups of chunk tables.

A chunk table has image_id, shape (z, y, x), dtype and data (the bytes of the whole volume in C order).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from filigree.sources.workers import importable

SCHEMA = "image_id string, shape array<int>, dtype string, data binary"


def unpack(row) -> np.ndarray:
    return np.frombuffer(row["data"], np.dtype(row["dtype"])).reshape(tuple(row["shape"]))


def pack(image: str, a: np.ndarray) -> dict:
    return {"image_id": image, "shape": list(a.shape), "dtype": str(a.dtype), "data": np.ascontiguousarray(a).tobytes()}


def mapped(volumes: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A kernel on each image's volume; rows keep streaming, one volume in memory at a time."""
    importable(volumes.sparkSession)

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                yield pd.DataFrame([pack(row["image_id"], kernel(unpack(row)))])

    return volumes.mapInPandas(run, SCHEMA)


def tiled(a: np.ndarray, kernel: Callable[[np.ndarray], np.ndarray], chunk: tuple, overlap: tuple) -> np.ndarray:
    """A kernel on overlapping tiles, of which the cores are stitched."""
    out = None
    for z in range(0, a.shape[0], chunk[0]):
        for y in range(0, a.shape[1], chunk[1]):
            for x in range(0, a.shape[2], chunk[2]):
                at = (z, y, x)
                low = [max(0, p - o) for p, o in zip(at, overlap, strict=True)]
                high = [min(n, p + c + o) for n, p, c, o in zip(a.shape, at, chunk, overlap, strict=True)]
                part = kernel(a[low[0] : high[0], low[1] : high[1], low[2] : high[2]])
                out = np.empty(a.shape, part.dtype) if out is None else out
                stop = [min(n, p + c) for n, p, c in zip(a.shape, at, chunk, strict=True)]
                out[z : stop[0], y : stop[1], x : stop[2]] = part[tuple(slice(p - b, s - b) for p, b, s in zip(at, low, stop, strict=True))]
    return a.copy() if out is None else out


def convolved(a: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Along one axis, edges reflected."""
    half = len(kernel) // 2
    pad = [(0, 0)] * a.ndim
    pad[axis] = (half, half)
    wide = np.pad(a, pad, mode="symmetric")
    return sum(k * np.take(wide, range(i, i + a.shape[axis]), axis=axis) for i, k in enumerate(kernel))


def gaussian(a: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    half = int(truncate * sigma + 0.5)
    x = np.arange(-half, half + 1)
    kernel = np.exp(-0.5 * (x / sigma) ** 2)
    kernel /= kernel.sum()
    out = a.astype(np.float64)
    for axis in range(a.ndim):
        out = convolved(out, kernel, axis)
    return out


def smoothed(mask: np.ndarray, sigma: float = 3.0) -> np.ndarray:
    return gaussian(mask, sigma) > 0.5


def flooded(open_: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """What the seeds reach through open cells, by sweeps along the axes."""
    reached = seeds & open_
    while True:
        new = reached.copy()
        for axis in range(open_.ndim):
            for step in (1, -1):
                moved = np.roll(new, step, axis)
                edge = [slice(None)] * open_.ndim
                edge[axis] = 0 if step == 1 else -1
                moved[tuple(edge)] = False
                new |= moved & open_
        if (new == reached).all():
            return reached
        reached = new


def filled(mask: np.ndarray) -> np.ndarray:
    """Holes filled: background that doesn't reach the border."""
    border = np.zeros(mask.shape, bool)
    for axis in range(mask.ndim):
        edge = [slice(None)] * mask.ndim
        for side in (0, -1):
            edge[axis] = side
            border[tuple(edge)] = True
    return mask | ~flooded(~mask, border)


def distance(mask: np.ndarray, sampling: tuple | None = None) -> np.ndarray:
    """Exact Euclidean distance of each set cell to the nearest unset one; infinite if there is none.

    Axis by axis, the least of f(q) + (step (p - q))^2 over a line: first by the nearest unset cell to both sides, then by
    growing offsets for all lines at once, each until no offset so far can lower its greatest value.
    """
    sampling = sampling or (1.0,) * mask.ndim
    out = np.where(mask, np.inf, 0.0)
    for axis in range(mask.ndim):
        n, step = mask.shape[axis], float(sampling[axis])
        lines = np.ascontiguousarray(np.moveaxis(out, axis, -1)).reshape(-1, n)
        if axis == 0:
            at = np.arange(n)
            before = np.maximum.accumulate(np.where(lines == 0, at, -np.inf), axis=1)
            after = np.minimum.accumulate(np.where(lines == 0, at, np.inf)[:, ::-1], axis=1)[:, ::-1]
            best = (step * np.minimum(at - before, after - at)) ** 2
        else:
            best = lowered(lines, step)
        out = np.moveaxis(best.reshape(np.moveaxis(out, axis, -1).shape), -1, axis)
    return np.sqrt(out)


def lowered(lines: np.ndarray, step: float) -> np.ndarray:
    """The least of f(q) + (step (p - q))^2 over q, for each p of each line (row)."""
    best, active = lines.copy(), np.arange(len(lines))
    for d in range(1, lines.shape[1]):
        cost = (step * d) ** 2
        active = active[best[active].max(axis=1) > cost]
        if not len(active):
            break
        own, f = best[active], lines[active]
        np.minimum(own[:, d:], f[:, :-d] + cost, out=own[:, d:])
        np.minimum(own[:, :-d], f[:, d:] + cost, out=own[:, :-d])
        best[active] = own
    return best


def median(a: np.ndarray, size: int = 7) -> np.ndarray:
    half = size // 2
    wide = np.pad(a, half, mode="symmetric")
    return np.median(np.lib.stride_tricks.sliding_window_view(wide, (size,) * a.ndim), axis=tuple(range(a.ndim, 2 * a.ndim)))


def hysteresis(p: np.ndarray, low: float = 0.2, high: float = 0.5) -> np.ndarray:
    return flooded(p > low, p > high)


def resized_shape(shape: tuple, factors: tuple) -> tuple:
    """Rounded half to even, at least 1."""
    return tuple(max(1, round(n * f)) for n, f in zip(shape, factors, strict=True))


def resized(a: np.ndarray, factors: tuple) -> np.ndarray:
    """Linear, by cell centres; smoothed before where it shrinks."""
    out = a.astype(np.float64)
    for axis, (n, m) in enumerate(zip(a.shape, resized_shape(a.shape, factors), strict=True)):
        if m < n:
            half = max(0.0, (n / m - 1) / 2)
            if half > 0:
                r = int(4 * half + 0.5)
                x = np.arange(-r, r + 1)
                k = np.exp(-0.5 * (x / half) ** 2)
                out = convolved(out, k / k.sum(), axis)
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        high = np.minimum(low + 1, n - 1)
        w = (at - low).reshape([-1 if i == axis else 1 for i in range(a.ndim)])
        out = np.take(out, low, axis) * (1 - w) + np.take(out, high, axis) * w
    return out


_POLE = np.sqrt(3.0) - 2  # of the cubic spline's filter


def spline(a: np.ndarray, axis: int) -> np.ndarray:
    """Coefficients of the cubic spline through the values along an axis, mirrored at its ends (Unser, 1999)."""
    c = np.moveaxis(a, axis, 0).astype(np.float64) * 6
    n = len(c)
    if n == 1:
        return a.astype(np.float64)
    mirror = np.concatenate([c, c[-2:0:-1]])
    powers = _POLE ** np.arange(len(mirror))
    c[0] = np.tensordot(powers, mirror, (0, 0)) / (1 - _POLE ** len(mirror))
    for i in range(1, n):
        c[i] += _POLE * c[i - 1]
    c[-1] = _POLE / (_POLE**2 - 1) * (_POLE * c[-2] + c[-1])
    for i in range(n - 2, -1, -1):
        c[i] = _POLE * (c[i + 1] - c[i])
    return np.moveaxis(c, 0, axis)


def recut(a: np.ndarray, m: int, axis: int) -> np.ndarray:
    """m values along an axis, at the centres of as many equal cells, by a cubic spline; smoothed before where it shrinks."""
    n, out = a.shape[axis], a.astype(np.float64)
    half = max(0.0, (n / m - 1) / 2)
    if half > 0:
        r = int(4 * half + 0.5)
        k = np.exp(-0.5 * (np.arange(-r, r + 1) / half) ** 2)
        out = sum(w * np.take(out, _mirrored(np.arange(n) + d, n), axis) for w, d in zip(k / k.sum(), range(-r, r + 1), strict=True))
    if n == m:
        return out
    c, at = spline(out, axis), (np.arange(m) + 0.5) * n / m - 0.5
    low = np.floor(at).astype(int)
    t = (at - low).reshape([-1 if i == axis else 1 for i in range(a.ndim)])
    weights = ((1 - t) ** 3 / 6, (4 - 6 * t**2 + 3 * t**3) / 6, (1 + 3 * t + 3 * t**2 - 3 * t**3) / 6, t**3 / 6)
    return sum(w * np.take(c, _mirrored(low + d, n), axis) for w, d in zip(weights, (-1, 0, 1, 2), strict=True))


def _mirrored(i: np.ndarray, n: int) -> np.ndarray:
    """Places of an axis continued by its mirror image, the end values not repeated."""
    if n == 1:
        return np.zeros_like(i)
    i = np.abs(i) % (2 * n - 2)
    return np.where(i < n, i, 2 * n - 2 - i)


def cubic(a: np.ndarray, shape: tuple) -> np.ndarray:
    """An array of another shape by cubic splines, within the values' range and of their type (whole numbers are cut off)."""
    out = a
    for axis, m in enumerate(shape):
        out = recut(out, m, axis)
    return np.clip(out, a.min(), a.max()).astype(a.dtype)


def fitted_mask(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """A plane mask brought to a size, cut at one half, then padded with nothing or cropped to it; nothing of an empty plane."""
    if mask.ndim != 2 or not mask.size:
        return np.zeros((height, width), bool)
    shape = resized_shape(mask.shape, (height / mask.shape[0], width / mask.shape[1]))
    out = np.zeros((height, width), bool)
    found = cubic(mask.astype(np.float32), shape)[:height, :width] > 0.5
    out[: found.shape[0], : found.shape[1]] = found
    return out


_NEAR = np.array([(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) != (0, 0, 0)])
_TOUCH = (np.abs(_NEAR[:, None] - _NEAR[None]).max(axis=2) == 1).astype(np.float32)
_FACE = (np.abs(_NEAR[:, None] - _NEAR[None]).sum(axis=2) == 1).astype(np.float32)
_SIX, _EIGHTEEN = np.abs(_NEAR).sum(axis=1) == 1, np.abs(_NEAR).sum(axis=1) <= 2


def thinned(mask: np.ndarray) -> np.ndarray:
    """A one-voxel-wide centreline: border voxels go, direction by direction, while they are simple and not ends.

    Voxels whose coordinates have equal parities don't touch, so all that may go of one of these eight kinds go at once.
    """
    a = np.pad(mask.astype(bool), 1)
    while thinned_once(a):
        pass
    return a[1:-1, 1:-1, 1:-1]


#: How far away a round of thinning can make a difference: six sides of eight kinds, each of which looks at neighbours.
THINNING_REACH = 48


def thinned_once(a: np.ndarray) -> bool:
    """One round over all six sides, in place; a has a layer of unset voxels around it. Whether any voxel went."""
    steps = _NEAR @ np.array([a.shape[1] * a.shape[2], a.shape[2], 1])
    flat, changed = a.reshape(-1), False
    for side in np.flatnonzero(_SIX):
        places = np.flatnonzero(flat)
        places = places[~flat[places + steps[side]]]
        z, y, x = np.unravel_index(places, a.shape)
        kind = (z & 1) * 4 + (y & 1) * 2 + (x & 1)
        for k in range(8):
            own = places[kind == k]
            gone = own[_simple(flat[own[:, None] + steps])]
            flat[gone] = False
            changed |= len(gone) > 0
    return changed


def _simple(on: np.ndarray) -> np.ndarray:
    """For neighbourhoods (rows of the 26 around a voxel), whether the voxel can go: it isn't an end or alone, and there is
    one object (26 neighbours) and one background part (6 neighbours, of the 18 that share a face or edge) around it."""

    def one(cells: np.ndarray, seeds: np.ndarray, touch: np.ndarray) -> np.ndarray:
        """Whether the first of the seeds reaches all of them within the cells."""
        reached = np.zeros_like(cells)
        rows = np.flatnonzero(seeds.any(axis=1))
        reached[rows, seeds[rows].argmax(axis=1)] = True
        while True:
            new = reached | cells & (reached.astype(np.float32) @ touch > 0)
            if (new == reached).all():
                return ~(seeds & ~reached).any(axis=1) & seeds.any(axis=1)
            reached = new

    out = on.sum(axis=1) >= 2
    rows = np.flatnonzero(out)
    off = ~on[rows] & _EIGHTEEN
    out[rows] = one(on[rows], on[rows], _TOUCH) & one(off, off & _SIX, _FACE)
    return out


def hull_planes(points: np.ndarray) -> np.ndarray:
    """Half-spaces (a, b, c, d), a x + b y + c z <= d, of the convex hull: the farthest point outside replaces the faces that
    it sees, and points inside all faces are left out from then on.

    Fewer than four points, or all in a plane, have none.
    """
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 4:
        return np.zeros((0, 4))
    i = [0, int(np.argmax(((p - p[0]) ** 2).sum(1)))]
    line = np.cross(p - p[0], p[i[1]] - p[0])
    i.append(int(np.argmax((line**2).sum(1))))
    normal = np.cross(p[i[1]] - p[0], p[i[2]] - p[0])
    off = (p - p[0]) @ normal
    i.append(int(np.argmax(np.abs(off))))
    if abs(off[i[3]]) < 1e-9:
        return np.zeros((0, 4))
    inside = p[i].mean(0)

    def planes(corners: np.ndarray) -> np.ndarray:
        a = p[corners[:, 0]]
        n = np.cross(p[corners[:, 1]] - a, p[corners[:, 2]] - a)
        n /= np.maximum(np.linalg.norm(n, axis=1), 1e-300)[:, None]
        n *= np.where((n * (inside - a)).sum(1) > 0, -1, 1)[:, None]
        return np.column_stack([n, (n * a).sum(1)])

    faces = np.array([[i[k] for k in t] for t in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))])
    sides, left = planes(faces), np.arange(len(p))
    while True:
        out = (p[left] @ sides[:, :3].T - sides[:, 3]).max(axis=1)
        left, out = left[out > 1e-9], out[out > 1e-9]
        if not len(left):
            return sides
        q = left[out.argmax()]
        seen = sides[:, :3] @ p[q] - sides[:, 3] > 1e-9
        edges = np.sort(faces[seen][:, [[0, 1], [1, 2], [0, 2]]].reshape(-1, 2), axis=1)
        edges, times = np.unique(edges, axis=0, return_counts=True)
        border = edges[times == 1]
        new = np.column_stack([border, np.full(len(border), q)])
        faces, sides = np.concatenate([faces[~seen], new]), np.concatenate([sides[~seen], planes(new)])


def hull_volume(points: np.ndarray) -> float:
    """Of the convex hull, by pyramids over the triangles of its faces from its centre."""
    planes = hull_planes(points)
    if not len(planes):
        return 0.0
    p = np.unique(np.asarray(points, float), axis=0)
    centre, total = p.mean(0), 0.0
    for n in np.unique(np.round(planes, 9), axis=0):
        on = p[np.abs(p @ n[:3] - n[3]) < 1e-6]
        if len(on) < 3:
            continue
        u = np.cross(n[:3], [1, 0, 0] if abs(n[0]) < 0.9 else [0, 1, 0])
        u /= np.linalg.norm(u)
        v = np.cross(n[:3], u)
        flat = np.stack([on @ u, on @ v], 1)
        total += _flat_area(flat) * abs(n[3] - n[:3] @ centre) / 3
    return total


def _flat_area(q: np.ndarray) -> float:
    """Of the convex hull of points in a plane, by the monotone chain."""
    q = q[np.lexsort((q[:, 1], q[:, 0]))]

    def half(points: np.ndarray) -> list:
        out: list = []
        for r in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (r[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (r[0] - out[-2][0]) <= 1e-12:
                out.pop()
            out.append(r)
        return out[:-1]

    h = np.array(half(q) + half(q[::-1]))
    return 0.5 * abs(float((h[:, 0] * np.roll(h[:, 1], -1) - np.roll(h[:, 0], -1) * h[:, 1]).sum()))


def hulls(voxels: DataFrame, voxel: tuple = (2.0, 2.0, 2.0)) -> DataFrame:
    """(image_id, convex_hull_volume): only voxels that end a row of x can be corners, so others don't leave their task."""
    from pyspark.sql import functions as F

    importable(voxels.sparkSession)
    ends = voxels.groupBy("image_id", "z", "y").agg(F.min("x").alias("a"), F.max("x").alias("b")).select("image_id", "z", "y", F.explode(F.array("a", "b")).alias("x"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"image_id": [pdf.image_id.iloc[0]], "convex_hull_volume": [hull_volume(pdf[["z", "y", "x"]].to_numpy(float) * voxel)]})

    return ends.groupBy("image_id").applyInPandas(run, "image_id string, convex_hull_volume double")


def hull_cells(voxels: DataFrame) -> DataFrame:
    """(image_id, z, y, x) of all cells within the convex hull of an image's voxels, its faces included; none without a hull.

    Faces come from the voxels that end a row of x, one image to a task. A row of cells of the hull's box is cut by all faces
    to one interval of x, with built-in functions, and only what is inside is made.
    """
    from pyspark.sql import functions as F

    importable(voxels.sparkSession)
    rows = voxels.groupBy("image_id", "z", "y").agg(F.min("x").alias("a"), F.max("x").alias("b")).select("image_id", "z", "y", F.explode(F.array("a", "b")).alias("x"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["z", "y", "x"]].to_numpy(float)
        faces = np.unique(np.round(hull_planes(p), 12), axis=0)
        out = {"image_id": pdf.image_id.iloc[0], "faces": [dict(zip("zyxd", f, strict=True)) for f in faces.tolist()], **{f"{c}{i}": int(v) for i, e in enumerate((p.min(0), p.max(0))) for c, v in zip("zyx", e, strict=True)}}
        return pd.DataFrame([out] if len(faces) else [], columns=["image_id", "faces", "z0", "y0", "x0", "z1", "y1", "x1"])

    boxes = rows.groupBy("image_id").applyInPandas(run, "image_id string, faces array<struct<z:double,y:double,x:double,d:double>>, z0 int, y0 int, x0 int, z1 int, y1 int, x1 int")
    cells = boxes.select("*", F.explode(F.sequence("z0", "z1")).alias("z")).select("*", F.explode(F.sequence("y0", "y1")).alias("y"))
    room = lambda f: f["d"] + 1e-9 - f["z"] * F.col("z") - f["y"] * F.col("y")
    first = F.array_max(F.transform(F.filter("faces", lambda f: f["x"] < 0), lambda f: room(f) / f["x"]))
    last = F.array_min(F.transform(F.filter("faces", lambda f: f["x"] > 0), lambda f: room(f) / f["x"]))
    level = F.forall(F.filter("faces", lambda f: f["x"] == 0), lambda f: room(f) >= 0)
    cells = cells.filter(level).select("image_id", "z", "y", F.greatest(F.ceil(first).cast("int"), "x0").alias("a"), F.least(F.floor(last).cast("int"), "x1").alias("b"))
    return cells.filter("a <= b").select("image_id", "z", "y", F.explode(F.sequence("a", "b")).alias("x"))


def hulls_without_mask(voxels: DataFrame, mask: DataFrame, shape: tuple, voxel: tuple = (2.0, 2.0, 2.0)) -> DataFrame:
    """Hull volumes less the masked columns' voxels within the hull, at least 0; without a hull, the chip's volume.

    mask: (image_id, y, x). Both tables meet by image; of the voxels only those that end a row of x. An image has a row if
    either table has one.
    """
    from pyspark.sql import functions as F

    importable(voxels.sparkSession)
    ends = voxels.groupBy("image_id", "z", "y").agg(F.min("x").alias("a"), F.max("x").alias("b")).select("image_id", "z", "y", F.explode(F.array("a", "b")).alias("x"))
    unit = voxel[0] * voxel[1] * voxel[2]

    def run(key: tuple, v: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        p = v[["z", "y", "x"]].to_numpy(float)
        planes = hull_planes(p)
        if not len(planes):
            out = float(np.prod(shape)) * unit - len(m) * shape[0] * unit
        else:
            out = hull_volume(p * voxel)
            low, high = p.min(0), p.max(0)
            at = m[["y", "x"]].to_numpy(float)
            at = at[((at >= low[1:]) & (at <= high[1:])).all(1)]  # only what the hull's box holds is tested
            for z in range(int(low[0]), int(high[0]) + 1):
                inside = (np.column_stack([np.full(len(at), z), at]) @ planes[:, :3].T <= planes[:, 3] + 1e-9).all(1)
                out -= inside.sum() * unit
        return pd.DataFrame({"image_id": [key[0]], "convex_hull_volume": [max(0.0, float(out))]})

    both = ends.groupBy("image_id").cogroup(mask.select("image_id", "y", "x").distinct().groupBy("image_id"))
    return both.applyInPandas(run, "image_id string, convex_hull_volume double")


def focus_surface(points: DataFrame) -> DataFrame:
    """(image_id, c0..c5): z = c0 + c1 x + c2 y + c3 x^2 + c4 x y + c5 y^2 by least squares; below 6 points only c0, the mean.

    The normal equations come from sums, so an image's points needn't meet in one task.
    """
    from pyspark.sql import functions as F

    importable(points.sparkSession)
    terms = [F.lit(1.0), F.col("x") * 1.0, F.col("y") * 1.0, F.col("x") * F.col("x") * 1.0, F.col("x") * F.col("y") * 1.0, F.col("y") * F.col("y") * 1.0]
    sums = [F.sum(terms[i] * terms[j]).alias(f"a{i}{j}") for i in range(6) for j in range(i, 6)] + [F.sum(terms[i] * F.col("z")).alias(f"b{i}") for i in range(6)]
    moments = points.groupBy("image_id").agg(*sums, F.count(F.lit(1)).alias("n"))

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                a, b = np.zeros((6, 6)), np.array([r[f"b{i}"] for i in range(6)], float)
                for i in range(6):
                    for j in range(i, 6):
                        a[i, j] = a[j, i] = r[f"a{i}{j}"]
                c = np.linalg.lstsq(a, b, rcond=None)[0] if r["n"] >= 6 else np.array([b[0] / r["n"], 0, 0, 0, 0, 0])
                rows.append([r["image_id"], *c])
            yield pd.DataFrame(rows, columns=["image_id", *(f"c{i}" for i in range(6))])

    return moments.mapInPandas(solve, "image_id string, " + ", ".join(f"c{i} double" for i in range(6)))


def windows(shape: tuple, roi: tuple, overlap: tuple) -> list[tuple]:
    """Corners of windows that cover a volume, neighbours overlapping by at least the given shares."""
    axes = []
    for n, r, o in zip(shape, roi, overlap, strict=True):
        step = max(1, int(r * (1 - o)))
        starts = list(range(0, max(n - r, 0) + 1, step))
        if starts[-1] + r < n:
            starts.append(n - r)
        axes.append(starts)
    return [(z, y, x) for z in axes[0] for y in axes[1] for x in axes[2]]


def sliding(a: np.ndarray, predict: Callable[[np.ndarray], np.ndarray], roi: tuple, overlap: tuple, rounds: int = 1) -> np.ndarray:
    """The mean of a model's windows, each predicted `rounds` times, clipped to 0 to 1. The model is the caller's."""
    total, weight = np.zeros(a.shape), np.zeros(a.shape)
    for at in windows(a.shape, roi, overlap):
        part = tuple(slice(p, min(p + r, n)) for p, r, n in zip(at, roi, a.shape, strict=True))
        total[part] += sum(predict(a[part]) for _ in range(rounds)) / rounds
        weight[part] += 1
    return np.clip(total / np.maximum(weight, 1), 0, 1)


def three_planes(a: np.ndarray, predict: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The mean of a plane model's sigmoids over slices along each axis."""
    out = []
    for axis in range(3):
        moved = np.moveaxis(a, axis, 0)
        out.append(np.moveaxis(np.stack([1 / (1 + np.exp(-predict(s))) for s in moved]), 0, axis))
    return sum(out) / 3
