"""The mask of the object in the middle of a device, by a cascade of thresholds; one plane at a time, planes in parallel.

Written from the published definitions of the thresholds and of the morphology.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from filigree.operators.device import BINS, closed, dilated, labelled, otsu, yen
from filigree.operators.tiles import SCHEMA, numbered, packed, unpacked
from filigree.operators.volume import convolved, gaussian
from filigree.sources.workers import importable

#: Shares of the plane that an object may have, and those of a small light one that is joined to a dark one.
FITTING, SMALL = (0.02, 0.15), (0.01, 0.02)


def minimum(a: np.ndarray, rounds: int = 500) -> float:
    """The lowest point between the two peaks of the histogram, once smoothing has left two (Prewitt and Mendelsohn, 1966).

    Raises where smoothing never leaves exactly two.
    """
    counts, edges = np.histogram(a, BINS)
    h, middles = counts.astype(float), (edges[:-1] + edges[1:]) / 2
    for _ in range(rounds - 1):
        h = convolved(h, np.full(3, 1 / 3), 0)
        rise = np.sign(np.diff(h))
        moves = np.flatnonzero(rise)  # flat stretches belong to what comes before them
        first = rise[moves[0]] < 0 if len(moves) else False
        peaks = [int(j) for i, j in zip(moves[:-1], moves[1:], strict=True) if rise[i] > 0 > rise[j]]
        if first:
            peaks.insert(0, int(moves[0]))
        if len(peaks) < 3:
            break
    if len(peaks) != 2:
        raise ValueError("the histogram hasn't two peaks")
    return float(middles[peaks[0] + int(np.argmin(h[peaks[0] : peaks[1] + 1]))])


def nearest_label(labels: np.ndarray, reach: int) -> np.ndarray:
    """Each pixel outside labels takes the label of the nearest labelled pixel within reach, the least one on ties.

    First along columns, then along rows over what the columns found: distances are exact within the reach.
    """
    h, w = labels.shape
    far = (h + w) ** 2 * 4
    best, own = np.where(labels > 0, 0, far), labels.copy()
    for axis in (0, 1):
        base, names = best.copy(), own.copy()
        n = labels.shape[axis]
        for d in range(1, min(reach, n - 1) + 1):
            for sign in (1, -1):
                to = [slice(None)] * 2
                of = [slice(None)] * 2
                to[axis], of[axis] = (slice(d, None), slice(None, -d)) if sign == 1 else (slice(None, -d), slice(d, None))
                to, of = tuple(to), tuple(of)
                cost, name = base[of] + d * d, names[of]
                better = (name > 0) & ((cost < best[to]) | ((cost == best[to]) & (name < own[to])))
                best[to] = np.where(better, cost, best[to])
                own[to] = np.where(better, name, own[to])
    return np.where(best <= reach * reach, own, 0)


def holes_filled(mask: np.ndarray, area: int) -> np.ndarray:
    """Background regions (by sides) of less than an area become part of the mask, at the border too."""
    holes = numbered(~mask[None], False)[0]
    number, at, n = np.unique(holes, return_inverse=True, return_counts=True)
    return mask | ((number > 0) & (n < area))[at.reshape(mask.shape)]


def central(labels: np.ndarray) -> tuple[np.ndarray, float] | None:
    """The region that has most of a disk around the middle, then the nearest to it, and its share of the plane; or None."""
    h, w = labels.shape
    n = int(labels.max(initial=0))
    if not n:
        return None
    y, x = np.mgrid[:h, :w]
    disk = (y - h // 2) ** 2 + (x - w // 2) ** 2 <= int(min(h, w) * 0.1) ** 2
    flat = labels.reshape(-1)
    area = np.bincount(flat, minlength=n + 1)
    with np.errstate(invalid="ignore"):
        off = (np.bincount(flat, y.reshape(-1), n + 1) / area - h // 2) ** 2 + (np.bincount(flat, x.reshape(-1), n + 1) / area - w // 2) ** 2
    overlap = np.bincount(flat, disk.reshape(-1), n + 1)
    k = min((k for k in range(1, n + 1) if area[k]), key=lambda k: (-overlap[k], off[k]))
    return labels == k, area[k] / labels.size


def mask_of(plane: np.ndarray, mode: str = "dark", sigma: float = 3.0) -> np.ndarray:
    """The object's mask.

    light: what Yen's threshold leaves of the smoothed plane, regions grown by 20 pixels; if the central one has 2 to 15 % of
    the plane, it is the object. If it has 1 to 2 %, it is joined to the dark object where they touch. Else, and for dark:
    of the inverted plane the central region by Yen's threshold, and where that doesn't fit by Otsu's; where this is too large,
    what an erosion by 20 pixels leaves of it, grown again; where none fits, by the minimum between two peaks. No region: an empty
    mask. None that fits: an error. Last, holes of less than 10,000 pixels are filled and the outline closed by a disk of 5.
    """
    raw = plane.astype(np.float32).astype(float)
    light = None
    if mode == "light":
        bright = np.nan_to_num(gaussian(raw, sigma), nan=0.0, posinf=0.0, neginf=0.0)
        found = central(nearest_label(labelled(bright > yen(bright)), 20))
        if found and FITTING[0] < found[1] <= FITTING[1]:
            return _smooth(found[0])
        if found and SMALL[0] <= found[1] <= SMALL[1]:
            light = found[0]
    dark = np.nan_to_num(gaussian(1.0 - raw, sigma), nan=0.0, posinf=0.0, neginf=0.0)
    hole, shares = int(0.015 * raw.size), []

    def region(threshold: float) -> tuple[np.ndarray, np.ndarray, float] | None:
        binary = holes_filled(dark > threshold, hole)
        best = central(labelled(binary))
        if best:
            shares.append(best[1])
        return best and (binary, *best)

    fits = lambda share: FITTING[0] <= share <= FITTING[1]
    for threshold in (yen, otsu, minimum):
        found = region(threshold(dark))
        if found is None:
            return np.zeros(raw.shape, bool)
        binary, own, share = found
        if threshold is otsu and share > FITTING[1]:
            worn = ~dilated(~np.pad(binary, 20), 20)[20:-20, 20:-20]  # beyond the plane there is nothing
            kept = central(nearest_label(labelled(worn), 20))
            if kept and fits(kept[1]):
                own, share = kept
        if fits(share):
            break
    else:
        raise ValueError("no threshold gives an object of a fitting size: " + ", ".join(f"{s:.1%}" for s in shares))
    if light is not None:
        wide = light.copy()
        wide[1:] |= light[:-1]
        wide[:-1] |= light[1:]
        wide[:, 1:] |= light[:, :-1]
        wide[:, :-1] |= light[:, 1:]
        if (wide & own).any():
            own = own | light
    return _smooth(own)


def _smooth(mask: np.ndarray) -> np.ndarray:
    return closed(holes_filled(mask, 10_000), 5)


def masks(planes: DataFrame, mode: str = "dark", sigma: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """Masks of whole planes (tile tables of one plane an image), and a ledger (name, status, message) of all of them."""
    importable(planes.sparkSession)

    def run(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                out = {"image_id": row["image_id"], "shape": None, "low": None, "size": None, "dtype": None, "data": None, "message": None}
                try:
                    out |= packed(row["image_id"], row["shape"], row["low"], mask_of(unpacked(row)[0], mode, sigma)[None])
                except ValueError as error:
                    out["message"] = str(error)
                yield pd.DataFrame([out])

    both = planes.mapInPandas(run, SCHEMA + ", message string")
    ledger = both.selectExpr("image_id AS name", "CASE WHEN message IS NULL THEN 'OK' ELSE 'FAILED' END AS status", "message")
    return both.filter("message IS NULL").drop("message"), ledger
