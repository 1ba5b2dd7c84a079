"""From a stack to its curved focus plane and back: where each patch is sharpest, a surface through it, and the stack bent flat.

Stacks are tile tables (see `tiles`) of whole planes, so that the planes of an image are spread over tasks; what meets by
image are a bounded grid of points, the coefficients of a surface, and one plane.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.functions import geometry, labels
from filigree.operators.device import rectified as _straightened
from filigree.operators.device import sobel
from filigree.operators.tiles import KEYS, SCHEMA, packed, unpacked
from filigree.sources.scratch import stored
from filigree.sources.workers import importable

SURFACE = "image_id string, c array<double>, mean_x double, mean_y double, scale double, z_ref int, shape array<int>"


def grid(n: int, patch: int, points: int) -> np.ndarray:
    """Middles of patches along an axis, evenly from one end to the other."""
    return np.linspace(patch // 2, n - patch // 2 - 1, points).astype(int)


def sharpness(a: np.ndarray) -> float:
    """The deviation of the gradient's size, in single precision: ties are ties there."""
    return float(np.float32(np.std(sobel(a)))) if a.size else float("nan")


def patch_focus(planes: DataFrame, points: int = 20, patch: int = 50) -> DataFrame:
    """(image_id, point, y, x, z, focus): the sharpness of a patch around each of points x points places, in each plane.

    Nothing meets: a plane gives its own rows. Patches are cut at the plane's borders; one without pixels has no row.
    """
    importable(planes.sparkSession)
    half = patch // 2

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                a, rows = unpacked(row)[0].astype(float), []
                for i, y in enumerate(grid(a.shape[0], patch, points)):
                    for j, x in enumerate(grid(a.shape[1], patch, points)):
                        part = a[max(0, y - half) : max(0, y + half), max(0, x - half) : max(0, x + half)]
                        if part.size:
                            rows.append((row["image_id"], i * points + j, int(y), int(x), int(row["low"][0]), sharpness(part)))
                yield pd.DataFrame(rows, columns=["image_id", "point", "y", "x", "z", "focus"])

    return planes.mapInPandas(run, "image_id string, point int, y int, x int, z int, focus double")


def sharpest(focus: DataFrame, *by: str) -> DataFrame:
    """The plane of greatest sharpness for each group, the first on ties."""
    return focus.groupBy("image_id", *by).agg(F.min_by("z", F.struct(-F.col("focus"), F.col("z"))).alias("z"))


def plane_focus(planes: DataFrame) -> DataFrame:
    """(image_id, z, focus) of whole planes."""
    importable(planes.sparkSession)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(r["image_id"], int(r["low"][0]), sharpness(unpacked(r)[0].astype(float))) for r in pdf.to_dict("records")], columns=["image_id", "z", "focus"])

    return planes.mapInPandas(run, "image_id string, z int, focus double")


def heights(surface: dict) -> np.ndarray:
    """The plane of each column: the surface at its place, rounded half to even, within the stack."""
    _, h, w = surface["shape"]
    y, x = np.mgrid[:h, :w]
    y, x = (y - surface["mean_y"]) / surface["scale"], (x - surface["mean_x"]) / surface["scale"]
    c = surface["c"]
    return np.clip(np.rint(c[0] * x**2 + c[1] * y**2 + c[2] * x * y + c[3] * x + c[4] * y + c[5]), 0, surface["shape"][0] - 1).astype(int)


def surfaces(planes: DataFrame, points: int = 20, patch: int = 50) -> DataFrame:
    """One surface an image: z = c0 x^2 + c1 y^2 + c2 x y + c3 x + c4 y + c5 by least squares through the patches' sharpest planes.

    x and y count from the patches' mean, in units of the longer side. With fewer than 6 patches the surface is flat, at the
    plane that is sharpest as a whole. z_ref: the rounded median of heights(). Scores meet by patch, points x points of
    them by image.
    """
    importable(planes.sparkSession)
    shapes = planes.groupBy("image_id").agg(F.first("shape").alias("shape"))
    if points * points < 6:
        best = sharpest(plane_focus(planes)).select("image_id", F.col("z").cast("double").alias("z"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    else:
        best = sharpest(patch_focus(planes, points, patch), "point", "y", "x").select("image_id", F.col("z").cast("double").alias("z"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = [int(n) for n in pdf["shape"].iloc[0]]
        out = {"image_id": pdf["image_id"].iloc[0], "c": [0.0] * 5 + [float(pdf["z"].iloc[0])], "mean_x": 0.0, "mean_y": 0.0, "scale": 1.0, "shape": shape}
        if len(pdf) >= 6:
            pdf = pdf.sort_values(["y", "x"])  # the same sums whatever came first
            out |= {"mean_x": float(pdf["x"].mean()), "mean_y": float(pdf["y"].mean()), "scale": float(max(shape[1:]))}
            x, y = (pdf["x"].to_numpy() - out["mean_x"]) / out["scale"], (pdf["y"].to_numpy() - out["mean_y"]) / out["scale"]
            out["c"] = np.linalg.lstsq(np.column_stack([x**2, y**2, x * y, x, y, np.ones_like(x)]), pdf["z"].to_numpy(), rcond=None)[0].tolist()
        out["z_ref"] = int(np.clip(np.rint(np.median(heights(out))), 0, shape[0] - 1))
        return pd.DataFrame([out])[["image_id", "c", "mean_x", "mean_y", "scale", "z_ref", "shape"]]

    return best.join(shapes, "image_id").groupBy("image_id").applyInPandas(fit, SURFACE)


def _moved(planes: DataFrame, surface: DataFrame, sources) -> DataFrame:
    """Planes made of pixels of others: sources(z, heights, surface) gives pairs of a plane and which pixels of z go there."""
    importable(planes.sparkSession)
    rows = planes.select("image_id", "low", "size", "dtype", "data").join(surface, "image_id")

    def send(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                a, shape = unpacked(row).reshape(-1), [int(n) for n in row["shape"]]
                for z, mask in sources(int(row["low"][0]), heights(row), row):
                    at = np.flatnonzero(mask).astype(np.int32)
                    if len(at):
                        yield pd.DataFrame([{"image_id": row["image_id"], "key": int(z), "shape": shape, "at": at.tobytes(), "dtype": a.dtype.str, "data": a[at].tobytes()}])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        shape, kind = [int(n) for n in pdf["shape"].iloc[0]], np.dtype(pdf["dtype"].iloc[0])
        depth, z = (1, 0) if pdf["key"].iloc[0] < 0 else (shape[0], int(pdf["key"].iloc[0]))
        out = np.zeros(shape[1] * shape[2], kind)
        for at, data in zip(pdf["at"], pdf["data"], strict=True):
            out[np.frombuffer(at, np.int32)] = np.frombuffer(data, kind)
        return pd.DataFrame([packed(pdf["image_id"].iloc[0], [depth, *shape[1:]], [z, 0, 0], out.reshape(1, *shape[1:]))])

    parts = rows.mapInPandas(send, "image_id string, key int, shape array<int>, at binary, dtype string, data binary")
    return parts.groupBy(*KEYS).applyInPandas(build, SCHEMA)


def in_focus(planes: DataFrame, surface: DataFrame) -> DataFrame:
    """The one plane of each image that follows its surface: of each column the pixel at its height."""
    return _moved(planes, surface, lambda z, h, s: [(-1, h == z)])


def refocused(planes: DataFrame, surface: DataFrame) -> DataFrame:
    """Stacks whose columns are shifted so that the surface lies in plane z_ref; the end planes repeat beyond the ends.

    Each plane sends its pixels to where they go, so a stack is shuffled once and no task holds more than a few planes.
    """

    def sources(z, h, s):
        depth, ref = s["shape"][0], s["z_ref"]
        for out in range(depth):
            at = h + (out - ref)
            yield out, (at <= 0 if z == 0 else np.zeros(h.shape, bool)) | (at == z) | (at >= depth - 1 if z == depth - 1 else np.zeros(h.shape, bool))

    return _moved(planes, surface, sources)


def cropped(planes: DataFrame, corners: DataFrame) -> DataFrame:
    """The part of each plane within four corners (image_id, corners), straightened; images without corners, or whose corners
    span no pixels, have none."""
    importable(planes.sparkSession)
    ordered = corners.filter(F.size("corners") == 4).select("image_id", geometry.ordered_corners("corners").alias("corners"))

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                c = np.array([(p["x"], p["y"]) for p in row["corners"]], float)
                if min(np.ptp(c[:, 0]), np.ptp(c[:, 1])) >= 1:
                    out = _straightened(unpacked(row)[0], c)
                    yield pd.DataFrame([packed(row["image_id"], [row["shape"][0], *out.shape], [row["low"][0], 0, 0], out[None])])

    return planes.join(ordered, "image_id").mapInPandas(run, SCHEMA)


def votes(planes: DataFrame, points: int = 10, patch: int = 50) -> DataFrame:
    """(image_id, z, votes): how many patches are sharpest in each plane, 0 included; at least 4 x 4 patches of at least 5 pixels.

    A stack that is no larger than a patch has one vote, for its sharpest plane.
    """
    points, patch = max(4, points), max(5, patch)
    small = (F.col("shape")[1] <= patch) | (F.col("shape")[2] <= patch)
    best = sharpest(patch_focus(planes.filter(~small), points, patch), "point").select("image_id", "z")
    best = best.unionByName(sharpest(plane_focus(planes.filter(small))).select("image_id", "z"))
    every = planes.groupBy("image_id").agg(F.max(F.col("shape")[0]).alias("n")).select("image_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("z"))
    return every.join(best.groupBy("image_id", "z").agg(F.count(F.lit(1)).alias("votes")), ["image_id", "z"], "left").fillna(0, ["votes"])


def finalised(planes: DataFrame, jobs: DataFrame, points: int = 10, patch: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cropped stacks, their focus votes, and a ledger (name, status, message) of curated jobs.

    jobs: (image_id, inner_corners of the reduced focus image, device_width_um, x_um, y_um, focus_downsample). Stacks are bent flat, cropped to the corners moved outwards by the device's width, and
    their votes are those within the inner corners. A job without corners, without a voxel size, or without a stack fails.
    """
    scale = F.greatest(F.coalesce(F.col("focus_downsample"), F.lit(1)), F.lit(1)).cast("double")
    ready = jobs.withColumns({"_dx": labels.microns_to_pixels("device_width_um", "x_um"), "_dy": labels.microns_to_pixels("device_width_um", "y_um"), "_scale": scale})
    ready = stored(ready.join(planes.select("image_id").distinct().withColumn("_stack", F.lit(True)), "image_id", "left"), "jobs")
    message = F.when(F.col("_stack").isNull(), "no stack").when(F.coalesce(F.size("inner_corners"), F.lit(0)) != 4, "no corners").when(F.col("_dx").isNull() | F.col("_dy").isNull(), "no voxel size")
    ledger = ready.select(F.col("image_id").alias("name"), F.when(message.isNull(), "OK").otherwise("FAILED").alias("status"), message.alias("message"))
    good = ready.filter(message.isNull()).withColumn("inner", geometry.ordered_corners("inner_corners"))
    grown = F.transform(geometry.expanded("inner", F.col("_dx"), F.col("_dy")), lambda p: F.struct((p["x"] * F.col("_scale")).alias("x"), (p["y"] * F.col("_scale")).alias("y")))
    inner = F.transform("inner", lambda p: F.struct((p["x"] * F.col("_scale")).alias("x"), (p["y"] * F.col("_scale")).alias("y")))
    own = planes.join(good.select("image_id"), "image_id", "left_semi")
    flat = stored(refocused(own, surfaces(own, points, patch)), "refocused")
    return cropped(flat, good.select("image_id", grown.alias("corners"))), votes(cropped(flat, good.select("image_id", inner.alias("corners"))), points, patch), ledger
