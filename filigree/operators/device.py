"""Planes of a device image: thresholds, regions of interest, perspective crops, focus, masks; one image at a time, in NumPy.

Mapped over images like the kernels in `volume`. Written from the published definitions of each method.
"""

from __future__ import annotations

import numpy as np

from filigree.operators.volume import convolved, flooded

BINS = 256


def _histogram(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts, edges = np.histogram(a[np.isfinite(a)], BINS)
    return counts.astype(float), (edges[:-1] + edges[1:]) / 2


def otsu(a: np.ndarray) -> float:
    """The threshold of greatest variance between classes (Otsu, 1979)."""
    h, x = _histogram(a)
    below, above = np.cumsum(h), np.cumsum(h[::-1])[::-1]
    m0, m1 = np.cumsum(h * x) / np.maximum(below, 1e-12), (np.cumsum((h * x)[::-1]) / np.maximum(np.cumsum(h[::-1]), 1e-12))[::-1]
    return float(x[np.argmax(below[:-1] * above[1:] * (m0[:-1] - m1[1:]) ** 2)])


def yen(a: np.ndarray) -> float:
    """The threshold of greatest correlation (Yen, Chang and Chang, 1995)."""
    h, x = _histogram(a)
    p = h / max(h.sum(), 1e-12)
    total, low, high = np.cumsum(p), np.cumsum(p**2), np.cumsum((p**2)[::-1])[::-1]
    inner = low[:-1] * high[1:]
    crit = np.where(inner > 0, -np.log(np.maximum(inner, 1e-300)) + 2 * np.log(np.maximum(total[:-1] * (1 - total[:-1]), 1e-300)), -np.inf)
    return float(x[np.argmax(crit)])


def triangle(a: np.ndarray) -> float:
    """The bin farthest from the line between the peak and the longer tail's end (Zack, Rogers and Latt, 1977)."""
    h, x = _histogram(a)
    used = np.flatnonzero(h)
    peak, first, last = int(np.argmax(h)), int(used[0]), int(used[-1])
    flip = peak - first > last - peak
    if flip:
        h, peak, last = h[::-1], len(h) - 1 - peak, len(h) - 1 - first
    at = np.arange(peak, last + 1)
    if len(at) < 2:
        return float(x[peak if not flip else len(h) - 1 - peak])
    distance = h[peak] - (h[peak] - h[last]) * (at - peak) / (last - peak) - h[at]
    best = int(at[np.argmax(distance)])
    return float(x[len(h) - 1 - best if flip else best])


def sobel(a: np.ndarray) -> np.ndarray:
    """The magnitude of the gradient."""
    smooth, slope = np.array([1, 2, 1]) / 4, np.array([-1, 0, 1]) / 2
    gy = convolved(convolved(a.astype(float), slope, 0), smooth, 1)
    gx = convolved(convolved(a.astype(float), slope, 1), smooth, 0)
    return np.hypot(gy, gx) / np.sqrt(2)


def dilated(mask: np.ndarray, radius: int) -> np.ndarray:
    """By a disk."""
    out = np.zeros_like(mask)
    h, w = mask.shape
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if dy * dy + dx * dx <= radius * radius:
                out[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] |= mask[max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
    return out


def eroded(mask: np.ndarray, radius: int) -> np.ndarray:
    return ~dilated(~mask, radius)


def closed(mask: np.ndarray, radius: int) -> np.ndarray:
    return eroded(dilated(mask, radius), radius)


def dilated_along(mask: np.ndarray, length: int, angle: float) -> np.ndarray:
    """By a line through each pixel at an angle (radians from the x axis)."""
    out = mask.copy()
    h, w = mask.shape
    for t in range(-(length // 2), length // 2 + 1):
        dy, dx = round(t * np.sin(angle)), round(t * np.cos(angle))
        if abs(dy) < h and abs(dx) < w:
            out[max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] |= mask[max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
    return out


def labelled(mask: np.ndarray) -> np.ndarray:
    """Regions of eight neighbours, numbered from 1 in the order of their first pixels; 0 outside."""
    out = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        wide = np.pad(np.where(mask, out, mask.size + 1), 1, constant_values=mask.size + 1)
        least = np.min([wide[1 + a : 1 + a + mask.shape[0], 1 + b : 1 + b + mask.shape[1]] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0)
        new = np.where(mask, least, 0)
        new = np.where(mask, new.reshape(-1)[np.maximum(new - 1, 0)], 0)  # a label's own pixel may know a smaller one
        if (new == out).all():
            return np.where(mask, np.searchsorted(np.unique(out[mask]), out) + 1, 0) if mask.any() else out
        out = new


def regions(labels: np.ndarray) -> list[dict]:
    """Area, centroid, eccentricity, orientation and bounds of each region."""
    found = []
    for k in range(1, int(labels.max(initial=0)) + 1):
        y, x = np.nonzero(labels == k)
        a, b, c = y.var() + 1 / 12, x.var() + 1 / 12, ((y - y.mean()) * (x - x.mean())).mean()
        half, root = (a + b) / 2, np.hypot((a - b) / 2, c)
        found.append({"label": k, "area": len(y), "y": y.mean(), "x": x.mean(), "eccentricity": float(np.sqrt(max(0.0, 1 - (half - root) / (half + root)))), "angle": 0.5 * np.arctan2(2 * c, b - a), "bounds": (y.min(), x.min(), y.max() + 1, x.max() + 1)})
    return found


def small_holes_filled(mask: np.ndarray, area: int) -> np.ndarray:
    out = mask.copy()
    holes = labelled(~mask)
    for r in regions(holes):
        y0, x0, y1, x1 = r["bounds"]
        if r["area"] < area and y0 > 0 and x0 > 0 and y1 < mask.shape[0] and x1 < mask.shape[1]:
            out[holes == r["label"]] = True
    return out


def central_object(image: np.ndarray, mode: str = "dark", low: float = 0.02, high: float = 0.15) -> np.ndarray:
    """The mask of an object near the middle: the first of several thresholds that gives one of a fitting size.

    A candidate is the region that overlaps most with a central disk, then the nearest to the middle. Its holes are filled
    and its outline closed. Raises if no threshold gives one.
    """
    a = image.astype(float)
    if mode == "dark":
        a = -a
    h, w = a.shape
    yy, xx = np.mgrid[:h, :w]
    off = (yy - (h - 1) / 2) ** 2 + (xx - (w - 1) / 2) ** 2
    disk = off <= (min(h, w) / 6) ** 2
    for t in (yen(a), otsu(a), triangle(a)):
        labels = labelled(a > t)
        best = max(regions(labels), key=lambda r: ((disk & (labels == r["label"])).sum(), -((r["y"] - h / 2) ** 2 + (r["x"] - w / 2) ** 2), -r["label"]), default=None)
        if best and low <= best["area"] / a.size <= high:
            return closed(small_holes_filled(labels == best["label"], 10_000), 5)
    raise ValueError("no object of a fitting size")


def device_rectangle(image: np.ndarray, area: int = 100, eccentricity: float = 0.5, reach: int = 71) -> np.ndarray:
    """Corners (x, y) of the chamber between a device's walls; of the whole image where no walls are found.

    Walls are edges: long regions of steep gradient outside the middle third, stretched along their direction. The chamber
    is the largest background region between them that doesn't touch the border.
    """
    steep = sobel(image)
    walls = steep > triangle(steep)
    h, w = image.shape
    walls[:, w // 3 : 2 * w // 3] &= False if w >= h else walls[:, w // 3 : 2 * w // 3]
    labels, kept = labelled(walls), np.zeros_like(walls)
    for r in regions(labels):
        if r["area"] > area and r["eccentricity"] > eccentricity:
            kept |= dilated_along(labels == r["label"], reach, r["angle"])
    whole = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)
    for radius in (0, 3, 6, 10):
        inside = labelled(~(dilated(kept, radius) if radius else kept))
        free = [r for r in regions(inside) if r["bounds"][0] > 0 and r["bounds"][1] > 0 and r["bounds"][2] < h and r["bounds"][3] < w]
        best = max(free, key=lambda r: (r["area"], -r["label"]), default=None)
        if best:
            return oriented_box(inside == best["label"]) if best["area"] >= 0.4 * image.size else whole
    return whole


def oriented_box(mask: np.ndarray) -> np.ndarray:
    """Corners (x, y), clockwise from the top left, of the box along a region's principal axes."""
    y, x = np.nonzero(mask)
    angle = 0.5 * np.arctan2(2 * ((x - x.mean()) * (y - y.mean())).mean(), x.var() - y.var())
    c, s = np.cos(angle), np.sin(angle)
    u, v = c * x + s * y, -s * x + c * y
    box = np.array([[u.min(), v.min()], [u.max(), v.min()], [u.max(), v.max()], [u.min(), v.max()]])
    corners = box @ np.array([[c, s], [-s, c]])
    corners = corners[np.argsort(np.arctan2(*(corners - corners.mean(0)).T[::-1]))]
    return np.roll(corners, -int(np.argmin(corners.sum(1))), axis=0)


def perspective(corners: np.ndarray, width: int, height: int) -> np.ndarray:
    """The 3 x 3 map from a rectangle to four corners (x, y)."""
    target = [(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)]
    rows, right = [], []
    for (x, y), (u, v) in zip(target, corners, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.append(np.linalg.solve(np.array(rows, float), np.array(right, float)), 1).reshape(3, 3)


def sampled(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear; 0 outside."""
    h, w = image.shape
    inside = (y >= 0) & (x >= 0) & (y <= h - 1) & (x <= w - 1)
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    a, b = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    c, d = np.minimum(a + 1, h - 1), np.minimum(b + 1, w - 1)
    fy, fx = y - a, x - b
    out = (1 - fy) * ((1 - fx) * image[a, b] + fx * image[a, d]) + fy * ((1 - fx) * image[c, b] + fx * image[c, d])
    return np.where(inside, out, 0.0)


def rectified(image: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """The part of an image within four corners (x, y), straightened to a rectangle of their mean sides."""
    side = lambda i, j: float(np.hypot(*(corners[i] - corners[j])))
    width, height = max(2, round((side(0, 1) + side(3, 2)) / 2) + 1), max(2, round((side(0, 3) + side(1, 2)) / 2) + 1)
    yy, xx = np.mgrid[:height, :width]
    u, v, k = perspective(corners, width, height) @ np.stack([xx.ravel(), yy.ravel(), np.ones(xx.size)])
    return sampled(image.astype(float), (v / k).reshape(height, width), (u / k).reshape(height, width))


def focus_scores(stack: np.ndarray, patch: int = 50) -> np.ndarray:
    """(z, rows, columns): the deviation of the gradient in each patch of each slice."""
    z, h, w = stack.shape
    n, m = max(1, h // patch), max(1, w // patch)
    out = np.zeros((z, n, m))
    for k in range(z):
        steep = sobel(stack[k])
        for i in range(n):
            for j in range(m):
                out[k, i, j] = steep[i * h // n : (i + 1) * h // n, j * w // m : (j + 1) * w // m].std()
    return out


def votes(stack: np.ndarray, patch: int = 50) -> dict[int, int]:
    """How many patches are sharpest in each slice, the first on ties, zeros included."""
    counts = np.bincount(focus_scores(stack, patch).argmax(axis=0).ravel(), minlength=len(stack))
    return dict(enumerate(counts.tolist()))


def refocused(stack: np.ndarray, zmap: np.ndarray) -> np.ndarray:
    """Columns shifted so that a z-map lies in its median plane; what has no source repeats the end slices."""
    at = np.arange(len(stack))[:, None, None] + np.rint(zmap - np.median(zmap)).astype(int)[None]
    return np.take_along_axis(stack, np.clip(at, 0, len(stack) - 1), axis=0)


def as_stack(a: np.ndarray, channel: int = 0) -> np.ndarray:
    """(z, y, x) from 2 to 4 axes: a plane gets a z axis; of 4 axes the first with fewer than 4 entries, or else the
    smallest, holds channels, of which one (clipped to their number) is taken."""
    if a.ndim == 2:
        return a[None]
    if a.ndim == 4:
        axis = next((i for i, n in enumerate(a.shape) if n < 4), int(np.argmin(a.shape)))
        return np.take(a, min(max(channel, 0), a.shape[axis] - 1), axis)
    if a.ndim == 3:
        return a
    raise ValueError(f"{a.ndim} axes")


def reached_from(mask: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    return flooded(mask, seeds)
