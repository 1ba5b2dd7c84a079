"""A prefix tree over ordered sets, and the similarity join that walks it."""

from __future__ import annotations

import numpy as np

#: Tokens in a node at most: longer unbranched paths are chains of nodes.
WIDTH = 16


class Forest:
    """Disjoint sets of small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))], np.int64)


class Trie:
    """Sets as paths of tokens in ascending order; sets with a common beginning share its nodes.

    codes: the sets' tokens one after the other; offsets: where each set begins. No two sets are equal.
    """

    def __init__(self, codes: np.ndarray, offsets: np.ndarray, pad: int):
        n = np.diff(offsets)
        order = sorted(range(len(n)), key=lambda i: codes[offsets[i] : offsets[i + 1]].astype(">u4").tobytes())
        tokens, parent, depth, low, high, ends = [], [], [], [], [], []

        def lcp(a: int, b: int, start: int) -> int:
            m = int(min(n[a], n[b]))
            x, y = codes[offsets[a] + start : offsets[a] + m], codes[offsets[b] + start : offsets[b] + m]
            differ = np.flatnonzero(x != y)
            return start + int(differ[0]) if len(differ) else m

        shared = [lcp(a, b, 0) for a, b in zip(order, order[1:], strict=False)]

        def path(of: int, a: int, b: int, above: int, least: int, most: int) -> int:
            """Nodes for the tokens a to b of a set; the last one's number."""
            part = codes[offsets[of] + a : offsets[of] + b]
            k = -(-len(part) // WIDTH)
            block = np.full(k * WIDTH, pad, codes.dtype)
            block[: len(part)] = part
            first = self._count
            tokens.append(block.reshape(k, WIDTH))
            parent.append(np.concatenate(([above], np.arange(first, first + k - 1))))
            depth.append(np.minimum(a + WIDTH * np.arange(1, k + 1), b))
            low.append(np.full(k, least))
            high.append(np.full(k, most))
            ends.append(np.full(k, -1))
            self._count += k
            return self._count - 1

        self._count = 0
        tops, stack = [], [(0, len(order), 0, -1)]
        while stack:
            lo, hi, start, above = stack.pop()
            if lo == hi:
                continue
            if hi - lo == 1:
                of, common = order[lo], int(n[order[lo]])
            else:
                of, common = order[lo], min(shared[lo : hi - 1])
            sizes = n[order[lo:hi]]
            node = above
            if common > start:
                node = path(of, start, common, above, int(sizes.min()), int(sizes.max()))
            if n[order[lo]] == common:  # the shortest comes first
                ends[-1][-1] = order[lo]
                lo += 1
            at = lo
            while at < hi:  # groups by the next token
                to = at + 1
                while to < hi and shared[to - 1] > common:
                    to += 1
                stack.append((at, to, common, node))
                at = to
        join = lambda x, empty: np.concatenate(x) if x else empty
        none = np.zeros(0, np.int64)
        self.tokens = join(tokens, np.zeros((0, WIDTH), codes.dtype))
        parent, self.depth, self.low, self.high, self.ends = (join(x, none).astype(np.int64) for x in (parent, depth, low, high, ends))
        by = np.argsort(parent, kind="stable")
        self.children = by
        self.first = np.searchsorted(parent[by], np.arange(-1, self._count + 1))  # of the root at 0, of node i at i + 1

    def expand(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of nodes (-1: the root), and for each which of the nodes is its parent."""
        a, b = self.first[nodes + 1], self.first[nodes + 2]
        count = b - a
        at = np.repeat(np.arange(len(nodes)), count)
        return self.children[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + a[at]], at

    def matches(self, member: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (probe, set) with den * overlap >= num * union. member[probe, token]; its last column is False.

        The walk goes down a level at a time for all probes: a pair of a probe and a node carries the overlap of the path,
        computed once for all sets below, and is dropped when even a full match of all that remains can't reach the bound
        for the shortest set below.
        """
        probe, node, overlap = np.arange(len(sizes)), np.full(len(sizes), -1), np.zeros(len(sizes), np.int64)
        out = []
        while len(probe):
            node, at = self.expand(node)
            probe, overlap = probe[at], overlap[at]
            size = sizes[probe]
            near = (den * self.high[node] >= num * size) & (den * size >= num * self.low[node])
            probe, node, overlap, size = probe[near], node[near], overlap[near], size[near]
            if not len(probe):
                break
            overlap = overlap + member[probe[:, None], self.tokens[node]].sum(axis=1)
            # overlap o reaches the bound if (num + den) * o >= num * (size + length)
            least = num * (size + np.maximum(self.low[node], -(-num * size // den)))
            keep = (num + den) * (overlap + np.minimum(self.high[node] - self.depth[node], size - overlap)) >= least
            probe, node, overlap, size = probe[keep], node[keep], overlap[keep], size[keep]
            done = np.flatnonzero(self.ends[node] >= 0)
            if len(done):
                found = self.ends[node[done]]
                length = self.depth[node[done]]
                good = (num + den) * overlap[done] >= num * (size[done] + length)
                out.append((probe[done][good], found[good]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def linked(sets: list[np.ndarray], num: int, den: int, labels: np.ndarray | None = None, cells: int = 1 << 24, pairs: int = 1 << 18) -> np.ndarray:
    """For each set (sorted, none equal) the least number of a set that it reaches by links of den * overlap >= num * union.

    Some pivots first gather what is like them, so that a large group of near copies becomes one component cheaply. Each
    link between components has an end outside the largest one; so the sets outside it, and only these, walk the trie of
    all sets, and no link is lost. cells and pairs bound the memory of the walk.

    labels: sets with equal ones are in one component already.
    """
    m = len(sets)
    forest = Forest(m)
    often = None
    if labels is not None:
        _, first, place, many = np.unique(labels, return_index=True, return_inverse=True, return_counts=True)
        for i in range(m):
            forest.join(int(first[place[i]]), i)
        often = place != many.argmax() if m and many.max() > 1 else None
    if m < 2:
        return forest.roots()
    n = np.array([len(s) for s in sets], np.int64)
    offsets = np.concatenate(([0], np.cumsum(n)))
    values, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # tokens of one set match nothing: they keep their order in the trie, but share the column that is always False
    column = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)
    width = int((counts > 1).sum())
    open_ = np.argsort(n, kind="stable")
    if often is not None:
        open_ = open_[often[open_]]
    for _ in range(8):
        if len(open_) < 2:
            break
        pivot = open_[len(open_) // 2]
        mark = np.zeros(len(values), bool)
        mark[codes[offsets[pivot] : offsets[pivot + 1]]] = True
        near = open_[(den * n[open_] >= num * n[pivot]) & (den * n[pivot] >= num * n[open_])]
        hits = np.array([np.count_nonzero(mark[codes[offsets[i] : offsets[i + 1]]]) for i in near], np.int64)
        good = (num + den) * hits >= num * (n[near] + n[pivot])
        for i in near[good]:
            forest.join(int(i), int(pivot))
        gone = np.zeros(m, bool)
        gone[near[good]] = gone[pivot] = True
        open_ = open_[~gone[open_]]
    roots = forest.roots()
    largest = np.bincount(roots).argmax()
    probes = np.flatnonzero(roots != largest) if (roots == largest).sum() > 1 else np.arange(m)
    if not len(probes):
        return roots
    trie = Trie(codes.astype(np.uint32), offsets, len(values))
    columns = np.append(column, -1)
    trie.tokens = np.where(columns[trie.tokens] < 0, width, columns[trie.tokens]).astype(np.int64)
    step = max(1, min(cells // (width + 1), pairs // m))  # a level has no more pairs than probes times sets
    for a in range(0, len(probes), step):
        some = probes[a : a + step]
        member = np.zeros((len(some), width + 1), bool)
        for k, i in enumerate(some):
            member[k, columns[codes[offsets[i] : offsets[i + 1]]]] = True
        member[:, width] = False
        for x, y in zip(*trie.matches(member, n[some], num, den), strict=True):
            forest.join(int(some[x]), int(y))
    return forest.roots()
