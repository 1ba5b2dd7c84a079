"""Skeleton graphs: edges (image_id, u, v, weight, ...) with u < v, no loops, no parallels; nodes (image_id, node_id, z, y, x)."""

from __future__ import annotations

import functools
import heapq
import itertools
import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from filigree.operators.components import components as _components
from filigree.sources.scratch import discard, stored
from filigree.sources.workers import importable

IMAGE = "image_id"


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(IMAGE, F.explode(F.array("u", "v")).alias("node_id")).groupBy(IMAGE, "node_id").agg(F.count(F.lit(1)).alias("degree"))


def with_degrees(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    du, dv = d.withColumnsRenamed({"node_id": "u", "degree": "du"}), d.withColumnsRenamed({"node_id": "v", "degree": "dv"})
    return edges.join(du, [IMAGE, "u"]).join(dv, [IMAGE, "v"])


def kinds(edges: DataFrame) -> DataFrame:
    """edge_kind: floating_sprout if both ends are tips, attached_sprout if one is, else branch."""
    a, b = F.col("du") == 1, F.col("dv") == 1
    return with_degrees(edges).withColumn("edge_kind", F.when(a & b, "floating_sprout").when(a | b, "attached_sprout").otherwise("branch")).drop("du", "dv")


def sprouts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that have an edge, with their degree and sprout: whether it is 1."""
    return nodes.drop("sprout", "degree").join(degrees(edges), [IMAGE, "node_id"]).withColumn("sprout", F.col("degree") == 1)


def peeled(edges: DataFrame, removable: str) -> DataFrame:
    """Edges left when removable ones at tips go, again and again until none is left.

    Whether an edge is removable depends on itself only, so the rounds of all images run together; the loop ends with the
    longest chain of removable edges, however long it is. Rounds are stored; the driver sees one count.
    """
    marked = None
    while True:
        old, marked = marked, stored(with_degrees(edges).withColumn("_go", F.col(removable) & ((F.col("du") == 1) | (F.col("dv") == 1))).drop("du", "dv"), "peel")
        if old is not None:
            discard(old)
        if marked.filter("_go").isEmpty():
            return marked.drop("_go")
        edges = marked.filter("NOT _go").drop("_go")


def removable(length: str, tip: str, neighbour: str, most: float = 25.0, ratio: float = 0.20):
    """Short (in voxels), or with a tip that isn't thin against its other end."""
    return (F.col(length) <= most) | (F.col(tip) / (F.col(neighbour) + 1e-6) > ratio)


def joined(a: list, b: list) -> list:
    """Two polylines as one, put together at their nearest ends; a shared end point counts once."""
    options = [(x, y) for x in (a, a[::-1]) for y in (b, b[::-1])]
    x, y = min(options, key=lambda o: sum((p - q) ** 2 for p, q in zip(o[0][-1], o[1][0], strict=True)))
    return [*x, *(y[1:] if x[-1] == y[0] else y)]


#: Edges that go to Python in one group, about.
GROUP = 50_000


def _buckets(n: int) -> int:
    return max(1, math.ceil(n / GROUP))


def contracted(edges: DataFrame) -> DataFrame:
    """Nodes of degree 2 merged away, by image, in ascending order of node number, as long as the graph stays simple.

    Weights add up, `merged` counts the edges, and polylines (pts), if there are any, are joined at their nearest ends.

    Degrees don't change, so all other nodes stay, and what a chain of nodes of degree 2 becomes depends on nothing but the
    chains and the edge between the same two ends. Order matters there only, so these meet in one group, many in
    a group of bounded size; other edges stay as they are. The driver sees one count.
    """
    importable(edges.sparkSession)
    lines = "pts" in edges.columns
    kind = edges.schema[IMAGE].dataType.simpleString()
    pts = ["pts"] * lines
    schema = f"{IMAGE} {kind}, u long, v long, weight double, merged long" + ", pts array<struct<z:int,y:int,x:int>>" * lines

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, dict[int, tuple[float, int, list]]] = defaultdict(dict)
        points = [[(p["z"], p["y"], p["x"]) for p in x] for x in pdf.pts] if lines else [[] for _ in range(len(pdf))]
        for u, v, w, p in zip(pdf.u.tolist(), pdf.v.tolist(), pdf.weight.tolist(), points, strict=True):
            near[u][v] = near[v][u] = (w, 1, p)
        inner = sorted({*pdf.u[pdf.u_inner].tolist(), *pdf.v[pdf.v_inner].tolist()})
        again = True
        while again:
            again, rest = False, []
            for n in inner:
                (a, (wa, ca, pa)), (b, (wb, cb, pb)) = near[n].items()
                if b in near[a]:
                    rest.append(n)
                    continue
                del near[n], near[a][n], near[b][n]
                near[a][b] = near[b][a] = (wa + wb, ca + cb, joined(pa, pb) if pa and pb else pa or pb)
                again = True
            inner = rest
        rows = [(pdf[IMAGE].iloc[0], u, v, w, c, [dict(zip("zyx", q, strict=True)) for q in p]) for u in near for v, (w, c, p) in near[u].items() if u < v]
        return pd.DataFrame(rows, columns=[IMAGE, "u", "v", "weight", "merged", "pts"])[[IMAGE, "u", "v", "weight", "merged", *pts]]

    # one edge between two nodes; one from a node to itself keeps the node
    own = edges.select(IMAGE, F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v"), F.col("weight").cast("double").alias("weight"), *pts)
    own = own.groupBy(IMAGE, "u", "v").agg(F.min_by(F.struct("weight", *pts), "weight").alias("_e")).select(IMAGE, "u", "v", "_e.*")
    degree = own.select(IMAGE, F.explode(F.array("u", "v")).alias("node_id"), (F.col("u") == F.col("v")).alias("_loop")).groupBy(IMAGE, "node_id")
    inner = degree.agg(F.count(F.lit(1)).alias("_n"), F.bool_or("_loop").alias("_loop")).filter("_n = 2 AND NOT _loop").select(IMAGE, "node_id")
    marked = own.filter("u < v")
    for c in "uv":
        marked = marked.join(inner.select(IMAGE, F.col("node_id").alias(c), F.lit(True).alias(f"{c}_inner")), [IMAGE, c], "left").withColumn(f"{c}_inner", F.coalesce(f"{c}_inner", F.lit(False)))
    marked = stored(marked, "contracted")

    # chains: inner nodes that edges link, by their least node; their ends: the other nodes of their edges
    link = lambda c: F.struct(IMAGE, F.col(c).alias("n"))
    roots = _components(marked.filter("u_inner AND v_inner").select(link("u").alias("a"), link("v").alias("b"))).select(F.col(f"node.{IMAGE}").alias(IMAGE), F.col("node.n").alias("_n"), F.col("root.n").alias("_root"))
    chains = marked.filter("u_inner OR v_inner").withColumn("_n", F.when(F.col("u_inner"), F.col("u")).otherwise(F.col("v")))
    chains = chains.join(roots, [IMAGE, "_n"], "left").withColumn("_root", F.coalesce("_root", "_n"))
    outer = F.when(~F.col("u_inner"), F.col("u")).when(~F.col("v_inner"), F.col("v"))
    ends = chains.groupBy(IMAGE, "_root").agg(F.coalesce(F.min(outer), F.col("_root")).alias("_a"), F.coalesce(F.max(outer), F.col("_root")).alias("_b"))
    chains = chains.join(ends, [IMAGE, "_root"]).select(*marked.columns, "_a", "_b")
    plain = marked.filter("NOT u_inner AND NOT v_inner").withColumns({"_a": F.col("u"), "_b": F.col("v")})
    between = ends.select(IMAGE, "_a", "_b").distinct()
    chains = stored(chains.unionByName(plain.join(between, [IMAGE, "_a", "_b"], "left_semi")), "chains")
    parts = _buckets(chains.count())
    found = chains.withColumn("_part", F.pmod(F.xxhash64("_a", "_b"), F.lit(parts))).drop("_a", "_b").groupBy(IMAGE, "_part").applyInPandas(merge, schema)
    return found.unionByName(plain.join(between, [IMAGE, "_a", "_b"], "left_anti").select(IMAGE, "u", "v", "weight", F.lit(1).cast("long").alias("merged"), *pts))


def without_sprouts(edges: DataFrame) -> DataFrame:
    """Edges neither end of which is a tip."""
    return with_degrees(edges).filter("du > 1 AND dv > 1").drop("du", "dv")


def branch_only(edges: DataFrame) -> DataFrame:
    return contracted(without_sprouts(edges))


def labelled(edges: DataFrame) -> DataFrame:
    """(image_id, node_id, component): the least node that each node reaches. Node numbers are unique across images."""
    found = _components(edges.select(F.col("u").alias("a"), F.col("v").alias("b")))
    nodes = edges.select(IMAGE, F.explode(F.array("u", "v")).alias("node_id")).distinct()
    return nodes.join(found, nodes["node_id"] == found["node"], "left").select(IMAGE, "node_id", F.coalesce("root", "node_id").alias("component"))


def linked_pixels(pixels: DataFrame, width: int, image_span: int) -> DataFrame:
    """Connected regions of a plane (image_no, y, x), eight neighbours: `label` is the least pixel number of its region."""
    own = pixels.select("image_no", "y", "x", (F.col("image_no") * image_span + F.col("y") * width + F.col("x")).cast("long").alias("p"))
    near = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1)))))
    to = own.select("image_no", near.alias("o"), "y", "x", F.col("p").alias("a")).select("image_no", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "a")
    edges = to.join(own.select("image_no", "y", "x", F.col("p").alias("b")), ["image_no", "y", "x"]).select("a", "b")
    found = _components(edges)
    return own.join(found, own["p"] == found["node"], "left").select("image_no", "y", "x", F.coalesce("root", "p").alias("label"))


def hysteresis(field: DataFrame, low: float, high: float, width: int, image_span: int) -> DataFrame:
    """Pixels (image_no, y, x, value) above low in regions that hold one above high."""
    weak = field.filter(F.col("value") > low)
    marked = linked_pixels(weak.select("image_no", "y", "x"), width, image_span).join(weak, ["image_no", "y", "x"])
    strong = marked.filter(F.col("value") > high).select("image_no", "label").distinct()
    return marked.join(strong, ["image_no", "label"], "left_semi").select("image_no", "y", "x")


#: Voxels of the tiles that a dense image's places are dealt by, and how far (in voxels) the nearest is first looked for in an array.
PLACES, STEPS = (32, 128, 128), 5
#: Pairs up to which two tiles' places are compared one by one; beyond, a transform counts them.
PAIRS = 50_000_000


def _smooth(n: int) -> int:
    """The least number from n on that only 2, 3 and 5 divide: lengths whose transforms are fast."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def _blocks(n: int, m: int) -> list[slice]:
    """Rows of an n by m table of distances, in blocks that stay in the cache."""
    step = max(1, 200_000 // max(m, 1))
    return [slice(a, min(a + step, n)) for a in range(0, n, step)] if m else []


def _squares(p: np.ndarray, q: np.ndarray, voxel: tuple) -> np.ndarray:
    g = np.zeros((len(p), len(q)))
    for axis in range(3):
        off = np.subtract.outer(p[:, axis], q[:, axis]) * float(voxel[axis])
        off *= off
        g += off
    return g


def _within(p: np.ndarray, q: np.ndarray, weights: np.ndarray, voxel: tuple, radius: float) -> np.ndarray:
    """For each place of p, by column of weights, the sum over the places of q within the radius.

    Of few pairs by distance; else as a convolution of q's box with a ball. Sums are whole numbers far below 2^52, so the
    transform's rounding errors are far below one half.
    """
    away = [max(abs(int(a)), abs(int(b))) * float(s) for a, b, s in zip(q.max(axis=0) - p.min(axis=0), p.max(axis=0) - q.min(axis=0), voxel, strict=True)]
    if sum(a * a for a in away) <= radius * radius:
        return np.tile(weights.sum(axis=0), (len(p), 1))
    out = np.zeros((len(p), weights.shape[1]), np.int64)
    if len(p) * len(q) <= PAIRS:
        for at in _blocks(len(p), len(q)):
            out[at] = np.rint((_squares(p[at], q, voxel) <= radius * radius).astype(np.float64) @ weights.astype(np.float64))
        return out
    low, first = q.min(axis=0), p.min(axis=0)
    own, wide = p.max(axis=0) - first + 1, q.max(axis=0) - low + 1
    size = tuple(_smooth(int(n)) for n in own + wide - 1)
    # the ball's place k holds the offset p - q of first - low - (wide - 1) + k
    axes = [((f - b - (w - 1) + np.arange(n)) * float(s)) ** 2 for f, b, w, n, s in zip(first, low, wide, own + wide - 1, voxel, strict=True)]
    ball = np.fft.rfftn((axes[0][:, None, None] + axes[1][None, :, None] + axes[2][None, None, :] <= radius * radius).astype(np.float64), size, (0, 1, 2))
    at = tuple((p - first + wide - 1).T)
    for i in range(weights.shape[1]):
        box = np.zeros(tuple(wide))
        box[tuple((q - low).T)] = weights[:, i]
        out[:, i] = np.rint(np.fft.irfftn(np.fft.rfftn(box, size, (0, 1, 2)) * ball, size, (0, 1, 2))[at])
    return out


def _nearest(p: np.ndarray, tiles: list[np.ndarray], voxel: tuple) -> np.ndarray:
    """For each place of p the squared distance to the nearest other place of the tiles; infinite where there is none.

    Most are within some steps, where an array of the places around is looked up step by step, nearest first; what is left
    meets the tiles, nearest first, as long as they may hold something nearer.
    """
    best = np.full(len(p), np.inf)
    low, high = p.min(axis=0) - STEPS, p.max(axis=0) + STEPS
    on = np.zeros(tuple(high - low + 1), bool)
    for q in tiles:
        inside = q[((q >= low) & (q <= high)).all(axis=1)]
        on[tuple((inside - low).T)] = True
    reach = STEPS * min(map(float, voxel))
    steps = np.array([o for o in itertools.product(range(-STEPS, STEPS + 1), repeat=3) if any(o)])
    length = ((steps * np.array(voxel, float)) ** 2).sum(axis=1)
    left, flat, width = np.arange(len(p)), on.reshape(-1), np.array([on.shape[1] * on.shape[2], on.shape[2], 1])
    at = (p - low) @ width
    for i in np.argsort(length, kind="stable"):
        if length[i] > reach * reach or not len(left):
            break
        hit = flat[at[left] + int(steps[i] @ width)]
        best[left[hit]] = length[i]
        left = left[~hit]
    gaps = [(np.maximum(0, np.maximum(q.min(axis=0) - p.max(axis=0), p.min(axis=0) - q.max(axis=0))) * np.array(voxel, float)) for q in tiles]
    for gap, q in sorted(zip([float((g * g).sum()) for g in gaps], tiles, strict=True), key=lambda t: t[0]):
        open_ = left[best[left] > gap]
        for block in _blocks(len(open_), len(q)):
            rows = open_[block]
            g = _squares(p[rows], q, voxel)
            g[g == 0] = np.inf  # the place itself
            best[rows] = np.minimum(best[rows], g.min(axis=1))
    return best


def _dense_neighbours(nodes: DataFrame, voxel: tuple, radius: float, tile: tuple) -> DataFrame:
    """What neighbours() finds within the radius, of images whose nodes lie so close that pairs of nodes are too many.

    Nodes of one place are one row, with how many of each kind; a tile's places are packed into one row, which goes to all tiles
    within the radius. There a tile is counted as a whole, by pairs, or by convolution, whichever is less work: what a
    pair of tiles costs is bounded, whatever the number of nodes.
    """
    kind = nodes.schema[IMAGE].dataType.simpleString()
    corner = F.array(*(F.floor(F.col(c) / t).cast("int") for c, t in zip("zyx", tile, strict=True)))
    places = nodes.groupBy(IMAGE, *"zyx").agg(F.count_if(~F.col("sprout")).alias("junctions"), F.count_if("sprout").alias("tips")).withColumn("tile", corner)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {c: pdf[c].to_numpy(np.int64).tobytes() for c in (*"zyx", "junctions", "tips")}
        return pd.DataFrame([{IMAGE: pdf[IMAGE].iloc[0], "tile": list(pdf["tile"].iloc[0]), **row}])

    packed = stored(places.groupBy(IMAGE, "tile").applyInPandas(pack, f"{IMAGE} {kind}, tile array<int>, z binary, y binary, x binary, junctions binary, tips binary"), "places")
    reach = [math.ceil(radius / float(s) / t) for s, t in zip(voxel, tile, strict=True)]
    known = packed.select(IMAGE, "tile")
    goals = known
    for i, r in enumerate(reach):  # to the tiles around that there are
        goals = goals.withColumn(f"_{i}", F.explode(F.sequence(F.lit(-r), F.lit(r))))
    goals = goals.withColumn("goal", F.array(*(F.col("tile")[i] + F.col(f"_{i}") for i in range(3)))).select(IMAGE, "tile", "goal")
    goals = goals.join(known.withColumnRenamed("tile", "goal"), [IMAGE, "goal"], "left_semi")

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.to_dict("records")
        read = lambda row, *names: np.stack([np.frombuffer(row[c], np.int64) for c in names], axis=1)
        own = next(r for r in rows if tuple(r["tile"]) == tuple(r["goal"]))
        p = read(own, *"zyx")
        out, kinds = np.zeros((len(p), 2), np.int64), ([], [])
        for row in rows:
            q, n = read(row, *"zyx"), read(row, "junctions", "tips")
            out += _within(p, q, n, voxel, radius)
            for i in range(2):
                if n[:, i].any():
                    kinds[i].append(q[n[:, i] > 0])
        d = [np.sqrt(_nearest(p, k, voxel)) if k else np.full(len(p), np.inf) for k in kinds]
        found = pd.DataFrame({**dict(zip("zyx", p.T, strict=True)), "_cj": out[:, 0], "_ct": out[:, 1], "_dj": d[0], "_dt": d[1], "_nj": np.frombuffer(own["junctions"], np.int64), "_nt": np.frombuffer(own["tips"], np.int64)})
        found.insert(0, IMAGE, rows[0][IMAGE])
        return found.replace({np.inf: None})

    met = packed.join(goals, [IMAGE, "tile"]).groupBy(IMAGE, "goal").applyInPandas(near, f"{IMAGE} {kind}, z long, y long, x long, _cj long, _ct long, _dj double, _dt double, _nj long, _nt long")
    out = nodes.select(IMAGE, "node_id", *(F.col(c).cast("long").alias(c) for c in "zyx"), "degree", "sprout").join(met, [IMAGE, *"zyx"])
    columns = []
    for name, k, own in (("junction", "j", ~F.col("sprout")), ("endpoint", "t", F.col("sprout"))):
        self_ = own.cast("long")  # a node of the kind doesn't count itself
        columns += [F.when(F.col(f"_n{k}") > self_, 0.0).otherwise(F.col(f"_d{k}")).alias(f"dist_nearest_{name}"), (F.col(f"_c{k}") - self_).alias(f"num_{name}_neighbors")]
    return out.select(IMAGE, "node_id", F.col("degree").cast("long").alias("degree"), "sprout", *columns)


def neighbours(nodes: DataFrame, voxel: tuple = (2.0, 2.0, 2.0), radius: float = 500.0, share: int = 2048) -> DataFrame:
    """For each node (with `sprout`): distances to the nearest other junction and tip, and how many lie within the radius.

    Distances stay NULL and counts 0 where there is no other node of the kind; where an image has one kind only, nodes
    see their own kind only. Node numbers are unique in an image.

    An image's nodes are dealt to tasks by shares of about `share`, a block of distances of bounded memory at a time. Up to
    27 shares each meet all nodes of the image. Larger images are cut into cells of the radius, and a share meets its
    cell and the 26 around it; what is nearest there is nearest, if it is no further than a cell is wide. Nodes that find
    nothing so near look again in cells four times as wide, and so on until a cell holds the image: few do, and how many is all
    that the driver sees, with the widest extent. Where the cells of a large image would hold far more nodes than `share` (and
    places are whole numbers), its places are counted over tiles instead.
    """
    importable(nodes.sparkSession)

    def near(key: tuple, own: pd.DataFrame, every: pd.DataFrame) -> pd.DataFrame:
        own, every = own.sort_values("node_id"), every.rename(columns=lambda c: c.removeprefix("o_")).sort_values("node_id")
        p, q, tip = own[["z", "y", "x"]].to_numpy(float) * voxel, every[["z", "y", "x"]].to_numpy(float) * voxel, every["sprout"].to_numpy(bool)
        place = np.searchsorted(every["node_id"].to_numpy(), own["node_id"].to_numpy())
        out = {}
        for name, wanted in (("junction", ~tip), ("endpoint", tip)):
            at = np.flatnonzero(wanted)
            d, c = np.full(len(p), np.nan), np.zeros(len(p), np.int64)
            step = max(1, 200_000 // max(len(at), 1))  # distances at once: they stay in the cache
            for a in range(0, len(p), step) if len(at) else ():
                b = min(a + step, len(p))
                g = np.zeros((b - a, len(at)))
                for axis in range(3):
                    off = np.subtract.outer(p[a:b, axis], q[at, axis])
                    off *= off
                    g += off
                mine = np.flatnonzero(wanted[place[a:b]])
                g[mine, np.searchsorted(at, place[a:b][mine])] = np.inf
                best = np.sqrt(g.min(axis=1))
                d[a:b] = np.where(np.isfinite(best), best, np.nan)
                c[a:b] = np.count_nonzero(g <= radius * radius, axis=1)
            out[f"dist_nearest_{name}"], out[f"num_{name}_neighbors"] = d, c
        return own[[IMAGE, "node_id", "degree", "sprout"]].assign(**out).replace({np.nan: None})

    kind = nodes.schema[IMAGE].dataType.simpleString()
    schema = f"{IMAGE} {kind}, node_id long, degree long, sprout boolean, dist_nearest_junction double, num_junction_neighbors long, dist_nearest_endpoint double, num_endpoint_neighbors long"
    n = nodes.select(IMAGE, "node_id", "z", "y", "x", "degree", "sprout")
    ends = [((F.max(c) - F.min(c)) * float(s)).cast("double") for c, s in zip("zyx", voxel, strict=True)]
    full = F.count(F.lit(1)) > 27 * share
    crowd = functools.reduce(lambda a, e: a * F.least(F.lit(1.0), 3 * radius / F.greatest(e, F.lit(1e-9))), ends, F.count(F.lit(1)))
    whole = all(isinstance(n.schema[c].dataType, IntegralType) for c in "zyx")
    sizes = n.groupBy(IMAGE).agg(full.alias("_large"), (full & (crowd > 27 * share) & F.lit(whole)).alias("_dense"), F.greatest(*ends).alias("_extent"), F.count_if(~F.col("sprout")).alias("_junctions"), F.count_if("sprout").alias("_tips"))
    sizes = stored(sizes, "sizes")

    def met(own: DataFrame, every: DataFrame, side: float) -> DataFrame:
        cells = [F.when(F.col("_large"), F.floor(F.col(c) * float(s) / side)).otherwise(0).cast("long").alias(f"_c{c}") for c, s in zip("zyx", voxel, strict=True)]
        keys = ["_cz", "_cy", "_cx"]
        own, every = own.select("*", *cells), every.select("*", *cells)
        parts = own.groupBy(IMAGE, *keys).agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("_parts"))
        own = own.join(parts, [IMAGE, *keys]).withColumn("_part", F.pmod(F.xxhash64("node_id"), "_parts").cast("int"))
        steps = F.array(*(F.struct(*(F.lit(d).alias(c) for c, d in zip("zyx", o, strict=True))) for o in itertools.product((-1, 0, 1), repeat=3)))
        around = every.withColumn("_o", F.explode(F.when(F.col("_large"), steps).otherwise(F.array(F.struct(*(F.lit(0).alias(c) for c in "zyx"))))))
        around = around.withColumns({f"_c{c}": F.col(f"_c{c}") + F.col(f"_o.{c}") for c in "zyx"}).join(parts, [IMAGE, *keys])
        around = around.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(IMAGE, "node_id", "z", "y", "x", "sprout", *keys, "_part")
        around = around.toDF(*(f"o_{c}" for c in around.columns))  # names of their own: both sides stem from one table
        own = own.select(IMAGE, "node_id", "z", "y", "x", "degree", "sprout", *keys, "_part")
        return own.groupBy(IMAGE, *keys, "_part").cogroup(around.groupBy(*(f"o_{c}" for c in (IMAGE, *keys, "_part")))).applyInPandas(near, schema)

    cut = n.join(sizes, IMAGE)
    large, dense, extent = sizes.agg(F.bool_or("_large"), F.bool_or("_dense"), F.max(F.when(F.col("_large"), F.col("_extent")))).first()
    found = met(*[cut.filter("NOT _dense")] * 2, radius) if dense else met(cut, cut, radius)
    if not large:
        return found
    if dense:
        found = found.unionByName(_dense_neighbours(cut.filter("_dense"), voxel, radius, PLACES))
    found, side, better = stored(found, "near"), radius, []
    kinds = ["dist_nearest_junction", "dist_nearest_endpoint"]
    others = {kinds[0]: F.col("_junctions") - (~F.col("sprout")).cast("int"), kinds[1]: F.col("_tips") - F.col("sprout").cast("int")}  # none: nothing to look for

    def unsure(df: DataFrame, side: float) -> DataFrame:
        open_ = functools.reduce(lambda a, b: a | b, [(others[k] > 0) & (F.col(k).isNull() | (F.col(k) > side)) for k in kinds])
        return df.join(sizes.filter("_large"), IMAGE).filter(open_).select(IMAGE, "node_id")

    left = stored(unsure(found, side), "unsure")
    while side < extent and left.take(1):
        side *= 4
        again = stored(met(cut.join(left, [IMAGE, "node_id"], "left_semi"), cut, side), "near")
        better.append(again.select(IMAGE, "node_id", *kinds, F.lit(len(better)).alias("_n")))
        left = stored(unsure(again, side), "unsure")
    if not better:
        return found
    last = functools.reduce(DataFrame.unionByName, better).groupBy(IMAGE, "node_id").agg(F.max_by(F.struct(*kinds), "_n").alias("_last"))
    out = found.join(last, [IMAGE, "node_id"], "left")
    return out.withColumns({k: F.when(F.col("_last").isNotNull(), F.col(f"_last.{k}")).otherwise(F.col(k)) for k in kinds}).select(*found.columns)


def along_skeleton(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(image_id, node_id, sprout, distance): along edges to the nearest other node of the same kind; NULL if none is reached.

    One Dijkstra search from all nodes of a kind at once, in which each node keeps the two nearest different sources. Paths
    don't leave a connected component, so components are dealt to groups of bounded size; only one that is larger by itself is
    a larger group. The driver sees one count.
    """
    importable(edges.sparkSession)

    def search(key: tuple, e: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        near = defaultdict(list)
        for u, v, w in zip(e.u.tolist(), e.v.tolist(), e.weight.tolist(), strict=True):
            near[u].append((v, w))
            near[v].append((u, w))
        rows = []
        for kind in (False, True):
            sources = n.loc[n["sprout"] == kind, "node_id"].tolist()
            seen: dict[int, dict[int, float]] = defaultdict(dict)
            heap = [(0.0, s, s) for s in sources]
            while heap:
                d, at, source = heapq.heappop(heap)
                if source in seen[at] or len(seen[at]) == 2:
                    continue
                seen[at][source] = d
                for to, w in near[at]:
                    if source not in seen[to] and len(seen[to]) < 2:
                        heapq.heappush(heap, (d + w, to, source))
            rows += [(key[0], s, kind, min((d for o, d in seen[s].items() if o != s), default=None)) for s in sources]
        return pd.DataFrame(rows, columns=[IMAGE, "node_id", "sprout", "distance"])

    kind = edges.schema[IMAGE].dataType.simpleString()
    own = stored(edges.select(IMAGE, "u", "v", "weight"), "along")
    of = lambda c: F.struct(IMAGE, F.col(c).cast("long").alias("n"))
    roots = _components(own.select(of("u").alias("a"), of("v").alias("b"))).select(F.col(f"node.{IMAGE}").alias(IMAGE), F.col("node.n").alias("_n"), F.col("root.n").alias("_root"))
    parts = _buckets(own.count())

    def dealt(df: DataFrame, c: str) -> DataFrame:
        rooted = df.withColumn("_n", F.col(c).cast("long")).join(roots, [IMAGE, "_n"], "left")
        return rooted.withColumn("_part", F.pmod(F.xxhash64(F.coalesce("_root", "_n")), F.lit(parts))).drop("_n", "_root")

    a = dealt(own, "u").select(IMAGE, "_part", "u", "v", "weight").groupBy(IMAGE, "_part")
    b = dealt(nodes.select(IMAGE, "node_id", "sprout"), "node_id").toDF("o_image", "node_id", "sprout", "o_part").groupBy("o_image", "o_part")  # names of their own, as both may stem from one table
    return a.cogroup(b).applyInPandas(search, f"{IMAGE} {kind}, node_id long, sprout boolean, distance double")


def from_skeleton(voxels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of thinned voxels, by image: voxels with other than two neighbours are nodes (touching ones are one),
    runs between them edges with their polyline. A closed run without a node gives none."""
    importable(voxels.sparkSession)
    near = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        on = set(zip(pdf.z.tolist(), pdf.y.tolist(), pdf.x.tolist(), strict=True))
        around = {p: [q for d in near if (q := (p[0] + d[0], p[1] + d[1], p[2] + d[2])) in on] for p in on}
        node: dict[tuple, int] = {}
        first = []
        for p in sorted(on):
            if len(around[p]) == 2 or p in node:
                continue
            todo = [p]
            node[p] = len(first)
            while todo:
                for q in around[todo.pop()]:
                    if len(around[q]) != 2 and q not in node:
                        node[q] = len(first)
                        todo.append(q)
            first.append(p)
        best: dict[tuple[int, int], list] = {}
        for p, i in node.items():
            for q in around[p]:
                if q in node:
                    continue
                line, before = [p, q], p
                while line[-1] not in node:
                    at = line[-1]
                    on_ = [r for r in around[at] if r != before]
                    before = at
                    if not on_:
                        break
                    line.append(on_[0])
                j = node.get(line[-1])
                if j is not None and i < j and ((i, j) not in best or len(line) < len(best[i, j])):
                    best[i, j] = line
        image = pdf[IMAGE].iloc[0]
        rows = [(image, i, None, *p, None, None) for i, p in enumerate(first)]
        for (i, j), line in best.items():
            length = float(sum(np.sqrt(((np.array(line[1:]) - np.array(line[:-1])) ** 2).sum(axis=1))))
            rows.append((image, i, j, None, None, None, length, [{"z": a, "y": b, "x": c} for a, b, c in line]))
        return pd.DataFrame(rows, columns=[IMAGE, "u", "v", "z", "y", "x", "weight", "pts"]).astype({"u": "Int64", "v": "Int64", "z": "Int32", "y": "Int32", "x": "Int32"})

    kind = voxels.schema[IMAGE].dataType.simpleString()
    both = stored(voxels.groupBy(IMAGE).applyInPandas(build, f"{IMAGE} {kind}, u long, v long, z int, y int, x int, weight double, pts array<struct<z:int,y:int,x:int>>"), "skeleton")
    nodes = both.filter("v IS NULL").select(IMAGE, F.col("u").alias("node_id"), "z", "y", "x")
    return nodes, both.filter("v IS NOT NULL").select(IMAGE, "u", "v", "weight", "pts")
