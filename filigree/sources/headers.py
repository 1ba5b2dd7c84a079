"""Voxel sizes from the headers of image files, and the axes of what a decoder returns.

TIFF (classic and big, both byte orders): the tags of the first directory, of which numbers and text are read where they
stand; pixels aren't touched. LIF: the XML at the start of the file. A header that can't be read gives no sizes, never an error.
"""

from __future__ import annotations

import re
import struct
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.functions.labels import voxel_size
from filigree.sources.workers import importable

#: Fixed values of the format: bytes of each type of a tag's values, and the tags that hold sizes.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
X_RESOLUTION, Y_RESOLUTION, DESCRIPTION, METADATA_COUNTS, METADATA = 282, 283, 270, 50838, 50839


def tags(content: bytes | memoryview) -> dict[int, tuple[int, bytes]]:
    """Type and bytes of each tag of a TIFF file's first directory, as little-endian values; what lies outside the file raises."""
    order = {b"II": "<", b"MM": ">"}[bytes(content[:2])]
    (version,) = struct.unpack_from(order + "H", content, 2)
    if version == 42:
        count, entry, offset, room = "H", "HHI", "I", 4
        (at,) = struct.unpack_from(order + "I", content, 4)
    elif version == 43:
        count, entry, offset, room = "Q", "HHQ", "Q", 8
        (at,) = struct.unpack_from(order + "Q", content, 8)
    else:
        raise ValueError(f"TIFF version {version}")
    (n,) = struct.unpack_from(order + count, content, at)
    at += struct.calcsize(order + count)
    out = {}
    for i in range(n):
        place = at + i * (struct.calcsize(order + entry) + room)
        tag, kind, values = struct.unpack_from(order + entry, content, place)
        place += struct.calcsize(order + entry)
        size = SIZES.get(kind, 1) * values
        if size > room:
            (place,) = struct.unpack_from(order + offset, content, place)
        data = bytes(content[place : place + size])
        if len(data) < size:
            raise ValueError("a tag's values lie beyond the end")
        width = {5: 4, 10: 4}.get(kind, SIZES.get(kind, 1))
        if order == ">" and width > 1:
            data = np.frombuffer(data, f">u{width}").astype(f"<u{width}").tobytes()
        out[tag] = (kind, data)
    return out


def _step(value: tuple[int, bytes] | None) -> float | None:
    """Micrometres of a pixel, from a resolution in pixels a micrometre; a resolution of 0 raises."""
    if value is None:
        return None
    numerator, denominator = struct.unpack("<II" if value[0] == 5 else "<ii", value[1][:8])
    return 1.0 / (numerator / denominator)


def _text(value: tuple[int, bytes]) -> str:
    return value[1].split(b"\x00")[0].decode("latin-1")


def _metadata(found: dict[int, tuple[int, bytes]]) -> str:
    """The texts of the block of metadata: after its header, UTF-16 in either order."""
    data = found[METADATA][1]
    counts = np.frombuffer(found[METADATA_COUNTS][1], "<u4") if METADATA_COUNTS in found else []
    body = data[int(counts[0]) :] if len(counts) else data
    big = body[:2] == b"\x00" + body[1:2]
    return body[: len(body) // 2 * 2].decode("utf-16-be" if big else "utf-16-le", "ignore")


def tiff_steps(content: bytes | memoryview) -> tuple[float | None, float | None, float | None]:
    """(z, y, x) in micrometres; a side that has no tag takes the other's. All None if the header can't be read.

    z: the third entry of `nscales` in the metadata block, up to the unit, else `spacing` of the description, up to `loop`.
    """
    try:
        found = tags(content)
        x, y = _step(found.get(X_RESOLUTION)), _step(found.get(Y_RESOLUTION))
    except Exception:
        return None, None, None
    z = None
    for read in (lambda: _metadata(found).split("nscales=")[1].split(",")[2].split("\nunit")[0], lambda: _text(found[DESCRIPTION]).split("spacing=")[1].split("loop")[0]):
        try:
            z = float(read())
            break
        except (KeyError, IndexError, ValueError):
            continue
    return z, y if y is not None else x, x if x is not None else y


def lif_steps(content: bytes | memoryview, index: int) -> tuple[float | None, float | None, float | None]:
    """(z, y, x) in micrometres of an image of a LIF container, by its dimensions' lengths and numbers of elements.

    All None if the header can't be read or there is no such image; a side without a finite step above 0 takes the other's.
    """
    try:
        mark, _, star, n = struct.unpack_from("<iicI", content, 0)
        if mark != 0x70 or star != b"*" or index < 0:
            return None, None, None
        root = ElementTree.fromstring(bytes(content[13 : 13 + 2 * n]).decode("utf-16-le"))
        image = [e for e in root.iter("Element") if e.find("./Data/Image/ImageDescription/Dimensions") is not None][index]
        steps = {}
        for d in image.find("./Data/Image/ImageDescription/Dimensions"):
            elements = int(d.get("NumberOfElements", 0))
            step = abs(float(d.get("Length", "nan"))) / (elements - 1) * 1e6 if elements > 1 else float("nan")
            if np.isfinite(step) and step > 0:
                steps[d.get("DimID")] = step
        x, y, z = (steps.get(k) for k in ("1", "2", "3"))
    except Exception:
        return None, None, None
    return z, y if y is not None else x, x if x is not None else y


def voxel_sizes(files: DataFrame) -> DataFrame:
    """file_path, image_index and voxel (z_um, y_um, x_um, xy_um) of files (file_path, image_index, content).

    By the ending of the path, in any case; other files have no sizes. Sizes that aren't finite and above 0 are NULL.
    """
    importable(files.sparkSession)

    def run(batches):
        for pdf in batches:
            rows = []
            for path, index, content in pdf.itertuples(index=False):
                steps = (None, None, None)
                if content is not None and re.search(r"\.tiff?$", path or "", re.I):
                    steps = tiff_steps(memoryview(content))
                elif content is not None and re.search(r"\.lif$", path or "", re.I):
                    steps = lif_steps(memoryview(content), int(index or 0))
                rows.append((path, index, *steps))
            yield pd.DataFrame(rows, columns=["file_path", "image_index", "z", "y", "x"]).astype({"image_index": "Int32", "z": "Float64", "y": "Float64", "x": "Float64"})

    found = files.select("file_path", F.col("image_index").cast("int").alias("image_index"), "content").mapInPandas(run, "file_path string, image_index int, z double, y double, x double")
    return found.select("file_path", "image_index", voxel_size(F.col("z"), F.col("y"), F.col("x")).alias("voxel"))


def lif_stack(a: np.ndarray, channel: int = 0) -> np.ndarray:
    """The stack (z, y, x) of a container's image: a plane, or 64 planes and more, get a z axis before all else; of four axes one is
    the channels' (the first with fewer than 4 entries, or else the smallest), of which one is taken, clipped to their number."""
    if a.ndim == 2 or (a.ndim == 3 and a.shape[0] >= 64):
        return a[None]
    if a.ndim == 3:
        return a
    if a.ndim != 4:
        raise ValueError(f"{a.ndim} axes")
    return _channel(a, channel)


def tiff_stack(a: np.ndarray, channel: int = 0) -> tuple[np.ndarray, bool]:
    """An array of a TIFF file, and whether it is one plane rather than a stack: two axes, or three of which the last holds 3 or 4
    colours and the others are longer than 32."""
    if a.ndim == 4:
        a = _channel(a, channel)
    colours = a.ndim == 3 and a.shape[-1] in (3, 4) and min(a.shape[:2]) > 32
    return a, colours or a.ndim < 3


def _channel(a: np.ndarray, channel: int) -> np.ndarray:
    axis = next((i for i, n in enumerate(a.shape) if n < 4), int(np.argmin(a.shape)))
    return np.take(a, min(max(channel, 0), a.shape[axis] - 1), axis)
