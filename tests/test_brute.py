"""Queries without SQL, against plain Python over the same views."""

import heapq
import math
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from filigree.operators import volume
from filigree.plans.fixtures import SOLID, STACK, Fixtures
from filigree.plans.queries import ORACLE_SQL, QUERIES, SHARE, WINDOW, contrast
from tests.test_focus import plain_refocus, plain_surface
from tests.test_outputs import plain_crop
from tests.test_tiles import flood, plain_blend

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def edges_of(fx):
    out = defaultdict(dict)
    for r in fx.edges().collect():
        out[r["image_id"]][r["u"], r["v"]] = r["weight"]
    return out


def degrees(edges):
    n = defaultdict(int)
    for u, v in edges:
        n[u] += 1
        n[v] += 1
    return n


def merged(edges):
    """Nodes of degree 2 go one by one, least number first, again and again, where their neighbours aren't linked."""
    edges, again = {k: (w, 1) for k, w in edges.items()}, True
    while again:
        again = False
        for n in sorted({x for e in edges for x in e}):
            own = [e for e in edges if n in e]
            if len(own) != 2:
                continue
            a, b = (e[0] if e[1] == n else e[1] for e in own)
            key = min(a, b), max(a, b)
            if key in edges:
                continue
            (wa, ca), (wb, cb) = edges.pop(own[0]), edges.pop(own[1])
            edges[key] = wa + wb, ca + cb
            again = True
    return edges


def near(a, b):
    return a.keys() == b.keys() and all(np.allclose(np.array(a[k], float), np.array(b[k], float), rtol=1e-7, atol=1e-9, equal_nan=True) for k in a)


def rows(found, *keys):
    none = lambda x: math.nan if x is None else x
    return {tuple(r[k] for k in keys): tuple(none(r[c]) for c in found.columns if c not in keys) for r in found.collect()}


def peel(fx, found):
    want = {}
    for image, edges in edges_of(fx).items():
        while True:
            n = degrees(edges)
            go = [e for e, w in edges.items() if w <= 1.5 and 1 in (n[e[0]], n[e[1]])]
            if not go:
                break
            edges = {e: w for e, w in edges.items() if e not in go}
        want |= {(image, *e): (w,) for e, w in edges.items()}
    return near(rows(found, "image_id", "u", "v"), want)


def contract(fx, found, sprouts=True):
    want = {}
    for image, edges in edges_of(fx).items():
        n = degrees(edges)
        kept = edges if sprouts else {e: w for e, w in edges.items() if n[e[0]] > 1 and n[e[1]] > 1}
        want |= {(image, *e): x for e, x in merged(kept).items()}
    return near(rows(found.select("image_id", "u", "v", "weight", "merged"), "image_id", "u", "v"), want)


def along(fx, found):
    """A search from each node of each image."""
    kinds, want = {(r["image_id"], r["node_id"]): r["sprout"] for r in fx.nodes().collect()}, {}
    links = defaultdict(list)
    for image, edges in edges_of(fx).items():
        for (u, v), w in edges.items():
            links[image, u].append((v, w))
            links[image, v].append((u, w))
    for (image, start), kind in kinds.items():
        heap, seen, best = [(0.0, start)], set(), math.nan
        while heap:
            d, at = heapq.heappop(heap)
            if at in seen:
                continue
            seen.add(at)
            if at != start and kinds[image, at] == kind:
                best = d
                break
            for to, w in links[image, at]:
                heapq.heappush(heap, (d + w, to))
        want[image, start, kind] = (best,)
    return near(rows(found, "image_id", "node_id", "sprout"), want)


def surface(fx, found):
    points = defaultdict(list)
    for r in fx.table("events").selectExpr("event_type AS i", "user_id % 10 AS x", "cast(user_id / 10 AS int) % 10 AS y", "day(ts) AS z").collect():
        points[r["i"]].append((r["x"], r["y"], r["z"]))
    for r in found.collect():
        x, y, z = np.array(points[r["image_id"]], float).T
        c = np.linalg.lstsq(np.stack([x * 0 + 1, x, y, x * x, x * y, y * y], 1), z, rcond=None)[0]
        if not np.allclose(c, [r[f"c{i}"] for i in range(6)], atol=1e-6):
            return False
    return found.count() == len(points)


def standard(fx):
    f = fx.features().toPandas().set_index("image_name").drop(columns="experiment")
    return f, (f - f.mean()) / f.std(ddof=0)


def components(fx, k=2):
    f, z = standard(fx)
    _, s, v = np.linalg.svd(z.to_numpy(), full_matrices=False)
    v = v[:k] * np.where(v[np.arange(k), np.abs(v[:k]).argmax(1)] < 0, -1, 1)[:, None]
    return f, z, v, s[:k] ** 2 / (s**2).sum()


def scores(fx, found):
    f, z, v, _ = components(fx)
    want = dict(zip(f.index, (z.to_numpy() @ v.T).tolist(), strict=True))
    got = {r["image_name"]: (r["pc1"], r["pc2"]) for r in found.collect()}
    return got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-6) for i in want)


def importance(fx, found):
    f, _, v, shares = components(fx)
    want = {(c,): (math.sqrt(sum((v[j, i] * shares[j]) ** 2 for j in (0, 1))), v[0, i], v[1, i]) for i, c in enumerate(f.columns)}
    return near({k: np.round(x, 6) for k, x in rows(found, "feature").items()}, {k: np.round(x, 6) for k, x in want.items()})


def discriminating(fx, found):
    """H from ranks, and its tail by integrating the density of chi-square."""
    f = fx.features().toPandas()
    p = {}
    for c in f.columns.drop(["image_name", "experiment"]):
        r, n = f[c].rank(), len(f)
        groups = r.groupby(f["experiment"])
        t = f[c].value_counts().to_numpy(float)
        h = (12 / (n * (n + 1)) * (groups.sum() ** 2 / groups.count()).sum() - 3 * (n + 1)) / (1 - (t**3 - t).sum() / (n**3 - n))
        k = groups.ngroups - 1
        x = np.linspace(h, h + 400, 2_000_001)
        d = np.exp((k / 2 - 1) * np.log(np.maximum(x, 1e-300)) - x / 2 - k / 2 * math.log(2) - math.lgamma(k / 2))
        p[c] = float(((d[1:] + d[:-1]) / 2 * np.diff(x)).sum())
    hits = sorted((v, c) for c, v in p.items() if v < 0.05) or sorted((v, c) for c, v in p.items())[:5]
    got = [(r["p"], r["feature"]) for r in found.orderBy("rank").collect()]
    return [c for _, c in got] == [c for _, c in hits] and np.allclose([v for v, _ in got], [v for v, _ in hits], atol=1e-6)


def hull(fx, found):
    """Planes through three points that have all others on one side, each with the pyramid over its face."""
    out = {r["image_id"]: r["convex_hull_volume"] for r in found.collect()}
    points = fx.voxels().toPandas()
    good = set(out) == set(points["image_id"])
    for image, part in points.groupby("image_id"):
        p = part[["z", "y", "x"]].to_numpy(float) * 2
        good &= out[image] == pytest.approx(volume.hull_volume(p), rel=1e-9)
    rng = np.random.default_rng(5)
    for _ in range(20):
        q = rng.integers(0, 6, (rng.integers(4, 14), 3)).astype(float)
        c, total, seen = q.mean(0), 0.0, set()
        for i in range(len(q)):
            for j in range(i):
                for k in range(j):
                    n = np.cross(q[j] - q[i], q[k] - q[i])
                    if not n.any():
                        continue
                    side = (q - q[i]) @ n
                    if (side > 1e-9).any() and (side < -1e-9).any():
                        continue
                    n = n / np.linalg.norm(n) * (-1 if (side > 1e-9).any() else 1)
                    key = tuple(np.round([*n, n @ q[i]], 6) + 0.0)
                    if key in seen:
                        continue
                    seen.add(key)
                    on = np.unique(q[np.abs(side) < 1e-9], axis=0)
                    u = (on[1] - on[0]) / np.linalg.norm(on[1] - on[0])
                    flat = np.stack([(on - on[0]) @ u, (on - on[0]) @ np.cross(n, u)], 1)
                    total += volume._flat_area(flat) * abs(n @ (q[i] - c)) / 3
        good &= volume.hull_volume(q) == pytest.approx(total, abs=1e-6)
    return good


def whole(df, shape, value=None):
    """Each image's array."""
    out = {}
    for r in df.collect():
        a = out.setdefault(r["image_id"], np.zeros(shape))
        a[r["z"], r["y"], r["x"]] = r[value] if value else 1
    return out


def smooth_fill(fx, found):
    want = {}
    for image, a in whole(fx.solid(), SOLID).items():
        n = volume.filled(volume.smoothed(a > 0, 0.7)).sum(axis=2)
        want |= {(image, z, y): (k,) for (z, y), k in np.ndenumerate(n) if k}
    return near(rows(found, "image_id", "z", "y"), want)


def connected(fx, found):
    want = {}
    for image, a in whole(fx.solid(), SOLID).items():
        number, n = np.unique(flood(a > 0, False), return_counts=True)
        want |= {(image, k): (m,) for k, m in zip(number.tolist(), n.tolist(), strict=True) if k}
    return near(rows(found, "image_id", "component"), want)


def blend(fx, found):
    got, want = whole(found, STACK, "value"), whole(fx.stack(), STACK, "value")
    return got.keys() == want.keys() and all(np.allclose(got[k], plain_blend(a, contrast(), WINDOW, SHARE, "gaussian", 2, 0.0), rtol=0, atol=2e-9) for k, a in want.items())


def bent_flat(fx, found):
    got, want = whole(found, STACK, "value"), whole(fx.stack(), STACK, "value")
    return got.keys() == want.keys() and all(np.array_equal(got[k], plain_refocus(a, plain_surface(a, 5, 12))) for k, a in want.items())


def thin(fx, found):
    want = {}
    for image, a in whole(fx.solid(), SOLID).items():
        solid = volume.filled(volume.smoothed(a > 0, 0.7))
        thin, deep, flat = volume.thinned(solid), volume.distance(solid, (2.0, 2.0, 2.0)), volume.distance((a > 0).any(axis=0), (2.0, 2.0))
        for z, y, x in np.argwhere(solid).tolist():
            want[image, z, y, x] = (thin[z, y, x], np.pi * flat[y, x] * deep[z, y, x] if thin[z, y, x] else math.nan)
    got = rows(found, "image_id", "z", "y", "x")
    return near({k: v[:1] for k, v in got.items()}, {k: v[:1] for k, v in want.items()}) and all(np.allclose(got[k][1], want[k][1], atol=1e-6, equal_nan=True) for k in want)


def hull_rows(fx, found):
    want = {}
    for image, a in whole(fx.solid(), SOLID).items():
        at = np.argwhere(a)
        planes, cells = volume.hull_planes(at), np.argwhere(np.ones(SOLID))
        inside = cells[(cells @ planes[:, :3].T <= planes[:, 3] + 1e-9).all(1)]
        for (z, y), n in zip(*np.unique(inside[:, :2], axis=0, return_counts=True), strict=True):
            want[image, int(z), int(y)] = (int(n),)
    return near(rows(found, "image_id", "z", "y"), want)


def cropped(fx, found):
    cells, want = defaultdict(set), {}
    for r in fx.table("part").selectExpr("p_partkey AS k", "p_size AS s").collect():
        cells[str(r["k"] % 3)].add((r["k"] % 97, r["s"] + r["k"] % 97 // 3))
    for image, at in cells.items():
        mask = np.zeros(np.array(list(at)).max(axis=0) + 1, bool)
        mask[tuple(np.array(list(at)).T)] = True
        angle, corners = plain_crop(mask, mask)
        want |= {(image, i): (angle, *p) for i, p in enumerate(corners)}
    got = {k: (v[0], *v[1:]) for k, v in rows(found, "image_id", "corner").items()}
    return got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=2e-6) for k in want)


BRUTE = {
    "q70_tiled_skeletons": thin, "q71_hull_cells": hull_rows, "q72_crop_without_necks": cropped,
    "q66_tiled_smooth_fill": smooth_fill, "q67_tiled_components": connected, "q68_blended_windows": blend, "q69_refocused_stack": bent_flat,
    "q31_focus_plane_lsq": surface, "q32_leaf_peel_fixpoint": peel, "q33_contract_degree2": contract, "q34_branch_only_graph": lambda fx, found: contract(fx, found, False),
    "q38_skeleton_nn": along, "q47_pca_scores": scores, "q47a_pca_importance": importance, "q51_top_discriminating": discriminating, "q60_hull_volume": hull,
}


def test_each_query_has_sql_or_a_brute_force_version():
    assert set(QUERIES) == set(ORACLE_SQL) | set(BRUTE)


@pytest.mark.parametrize("name", sorted(BRUTE))
def test_against_brute_force(spark, name):
    fx = Fixtures(spark, str(DATA))
    assert BRUTE[name](fx, QUERIES[name](spark, str(DATA)))
