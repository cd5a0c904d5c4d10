"""A balanced k-d tree over points in space, as arrays, for vectorised queries.

Used inside one task on one partition's points. The tree is complete: every
level halves every node at its median along its widest side, so a node is a
slice of one permutation and a whole level is handled with array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BUCKET = 16
_PAIR_BLOCK = 40_000
#: Node pairs looked at together: bounds memory where very many points lie close.
_NODE_PAIRS = 1 << 16


class KDTree:
    def __init__(self, points: np.ndarray, bucket: int = BUCKET, depth: int | None = None):
        n = len(points)
        self.points = points
        self.depth = self.fitting(n, bucket) if depth is None else depth
        order = np.arange(n)
        self.bounds = [np.array([0, n])]
        for _ in range(self.depth):
            edges = self.bounds[-1]
            cuts = [0]
            for a, b in zip(edges[:-1], edges[1:]):
                middle = (a + b) // 2
                part = order[a:b]
                if b - a > 1:
                    here = points[part]
                    axis = int(np.argmax(here.max(axis=0) - here.min(axis=0)))
                    order[a:b] = part[np.argpartition(here[:, axis], middle - a)]
                cuts += [middle, b]
            self.bounds.append(np.array(cuts))
        self.order = order
        self.low, self.high = [], []
        sorted_points = points[order]
        for edges in self.bounds:
            starts, filled = edges[:-1], edges[1:] > edges[:-1]
            low = np.full((len(starts), points.shape[1]), np.inf)
            high = np.full((len(starts), points.shape[1]), -np.inf)
            if n:
                low[filled] = np.minimum.reduceat(sorted_points, starts[filled], axis=0)
                high[filled] = np.maximum.reduceat(sorted_points, starts[filled], axis=0)
            self.low.append(low)
            self.high.append(high)

    @staticmethod
    def fitting(n: int, bucket: int = BUCKET) -> int:
        """Levels that leave about `bucket` of n points in a node."""
        return max(0, int(np.ceil(np.log2(n / bucket)))) if n > bucket else 0

    def _apart(self, level: int, a: np.ndarray, other: KDTree, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared distances of the boxes of node pairs."""
        la, ha, lb, hb = self.low[level][a], self.high[level][a], other.low[level][b], other.high[level][b]
        gap = np.maximum(0.0, np.maximum(la - hb, lb - ha))
        span = np.maximum(ha - lb, hb - la)
        with np.errstate(invalid="ignore"):
            return (gap * gap).sum(axis=1), (span * span).sum(axis=1)

    def near_nodes(self, radius: float, other: KDTree | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the lowest level's nodes that may hold points within `radius`: i <= j
        of this tree, or i of this and j of another tree of the same depth. Blocks
        are followed to the ground one by one, so few pairs are held at a time."""
        right, r2 = other or self, radius * radius
        left = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while left:
            level, a, b = left.pop()
            if level == self.depth:
                yield a, b
                continue
            a, b = np.concatenate([2 * a, 2 * a, 2 * a + 1, 2 * a + 1]), np.concatenate([2 * b, 2 * b + 1, 2 * b, 2 * b + 1])
            if other is None:
                keep = a <= b
                a, b = a[keep], b[keep]
            near, _ = self._apart(level + 1, a, right, b)
            keep = near <= r2
            a, b = a[keep], b[keep]
            left += [(level + 1, a[s : s + _NODE_PAIRS], b[s : s + _NODE_PAIRS]) for s in range(0, len(a), _NODE_PAIRS)]

    def _members(self, level: int) -> np.ndarray:
        """Rows of point numbers by node, filled up with -1."""
        edges = self.bounds[level]
        size = edges[1:] - edges[:-1]
        width = int(size.max()) if len(size) else 0
        at = edges[:-1, None] + np.arange(width)[None, :]
        valid = np.arange(width)[None, :] < size[:, None]
        return np.where(valid, self.order[np.minimum(at, max(len(self.order) - 1, 0))], -1)

    def pairs(self, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs i != j of points at most `radius` apart, each once, in blocks."""
        if len(self.points) < 2:
            return
        for a, b in self.near_nodes(radius):
            yield from self._expand(a, b, radius)

    def pairs_with(self, other: KDTree, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of a point of this and a point of another tree of the same depth, in blocks."""
        if len(self.points) and len(other.points):
            for a, b in self.near_nodes(radius, other):
                yield from self._expand(a, b, radius, other)

    def _expand(self, a: np.ndarray, b: np.ndarray, radius: float, other: KDTree | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        right = other or self
        members, others = self._members(self.depth), right._members(right.depth)
        wide, high = members.shape[1], others.shape[1]
        step = max(1, _PAIR_BLOCK * 25 // max(1, wide * high))
        upper = np.triu(np.ones((wide, high), bool), 1)
        for s in range(0, len(a), step):
            ma, mb = members[a[s : s + step]], others[b[s : s + step]]
            d2 = np.zeros((len(ma), wide, high))
            for axis in range(self.points.shape[1]):
                d2 += (self.points[:, axis][ma][:, :, None] - right.points[:, axis][mb][:, None, :]) ** 2
            ok = (d2 <= radius * radius) & (ma >= 0)[:, :, None] & (mb >= 0)[:, None, :]
            if other is None:
                ok[a[s : s + step] == b[s : s + step]] &= upper
            k, i, j = np.nonzero(ok)
            if len(k):
                yield ma[k, i], mb[k, j]

    def weights_near(self, radius: float, weight: np.ndarray) -> np.ndarray:
        """Per point the summed weight of all points at most `radius` away, its own
        included. Node pairs that lie wholly within `radius` are added as wholes, so
        a crowd in one spot is counted without its pairs being listed."""
        n, r2 = len(self.points), radius * radius
        total = np.zeros(n, np.int64)
        if not n:
            return total
        run = np.concatenate([[0], np.cumsum(weight[self.order])])
        slope = np.zeros(n + 1, np.int64)

        def add(edges: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
            gain = run[edges[b + 1]] - run[edges[b]]
            np.add.at(slope, edges[a], gain)
            np.add.at(slope, edges[a + 1], -gain)

        left = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while left:
            level, a, b = left.pop()
            edges = self.bounds[level]
            filled = (edges[a + 1] > edges[a]) & (edges[b + 1] > edges[b])
            a, b = a[filled], b[filled]
            near, far = self._apart(level, a, self, b)
            whole = far <= r2
            add(edges, a[whole], b[whole])
            other = whole & (a != b)
            add(edges, b[other], a[other])
            keep = (near <= r2) & ~whole
            a, b = a[keep], b[keep]
            if level == self.depth:
                for i, j in self._expand(a, b, radius):
                    np.add.at(total, i, weight[j])
                    np.add.at(total, j, weight[i])
                own = np.unique(a[a == b])
                inside = self._members(level)[own].ravel()
                inside = inside[inside >= 0]
                total[inside] += weight[inside]
                continue
            a, b = np.concatenate([2 * a, 2 * a, 2 * a + 1, 2 * a + 1]), np.concatenate([2 * b, 2 * b + 1, 2 * b, 2 * b + 1])
            keep = a <= b
            a, b = a[keep], b[keep]
            left += [(level + 1, a[s : s + _NODE_PAIRS], b[s : s + _NODE_PAIRS]) for s in range(0, len(a), _NODE_PAIRS)]
        total[self.order] += np.cumsum(slope[:-1])
        return total

    def nearest(self, queries: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the point nearest each query, ties to the
        least number; number -1 where the tree is empty. A level at a time: a box is
        left when its near side lies beyond the far side of another."""
        best, least = np.full(len(queries), -1), np.full(len(queries), np.inf)
        if not len(self.points):
            return best, least
        members = self._members(self.depth)
        for s in range(0, len(queries), block):
            at = queries[s : s + block]
            q, node = np.arange(len(at)), np.zeros(len(at), np.int64)
            for level in range(self.depth + 1):
                if level:
                    q, node = np.repeat(q, 2), np.stack([2 * node, 2 * node + 1], axis=1).ravel()
                low, high, x = self.low[level][node], self.high[level][node], at[q]
                filled = low[:, 0] <= high[:, 0]
                q, node, low, high, x = q[filled], node[filled], low[filled], high[filled], x[filled]
                gap, span = np.maximum(0.0, np.maximum(low - x, x - high)), np.maximum(high - x, x - low)
                near, far = (gap * gap).sum(axis=1), (span * span).sum(axis=1)
                bound = np.full(len(at), np.inf)
                np.minimum.at(bound, q, far)
                keep = near <= bound[q] * (1 + 1e-12)
                q, node = q[keep], node[keep]
            m = members[node]
            d2 = ((self.points[m] - at[q][:, None, :]) ** 2).sum(axis=2)
            d2, m, q = np.where(m >= 0, d2, np.inf).ravel(), m.ravel(), np.repeat(q, m.shape[1])
            order = np.lexsort((m, d2, q))
            first = order[np.unique(q[order], return_index=True)[1]]
            best[s + q[first]], least[s + q[first]] = m[first], d2[first]
        return best, least

    def components(self, radius: float) -> np.ndarray:
        """Label of each point: the number of the least point of its group, where
        points at most `radius` apart belong together, transitively.

        Node pairs that lie wholly within `radius` are joined as wholes and node
        pairs that are already one group are dropped, so a spot with a huge number
        of points never has its pairs enumerated.
        """
        n = len(self.points)
        labels = np.arange(n)
        if n < 2:
            return labels
        a, b, r2 = np.zeros(1, np.int64), np.zeros(1, np.int64), radius * radius
        links: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(self.depth + 1):
            if level:
                a, b = np.concatenate([2 * a, 2 * a, 2 * a + 1, 2 * a + 1]), np.concatenate([2 * b, 2 * b + 1, 2 * b, 2 * b + 1])
                keep = a <= b
                a, b = a[keep], b[keep]
            edges = self.bounds[level]
            filled = (edges[1:] > edges[:-1])
            keep = filled[a] & filled[b]
            a, b = a[keep], b[keep]
            near, far = self._apart(level, a, self, b)
            whole = far <= r2
            if whole.any():
                links.append(self._whole(edges, a[whole], b[whole]))
                labels = merge_labels(labels, *links.pop())
            low, high = self._label_range(labels, edges)
            one = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
            keep = (near <= r2) & ~whole & ~one
            a, b = a[keep], b[keep]
        for i, j in self._expand(a, b, radius):
            labels = merge_labels(labels, i, j)
        return labels

    def _whole(self, edges: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nodes = np.unique(np.concatenate([a, b]))
        size = edges[nodes + 1] - edges[nodes]
        heads = self.order[edges[nodes]]
        slots = np.repeat(edges[nodes] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return (
            np.concatenate([np.repeat(heads, size), self.order[edges[a]]]),
            np.concatenate([self.order[slots], self.order[edges[b]]]),
        )

    def _label_range(self, labels: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by_order = labels[self.order]
        starts, filled = edges[:-1], edges[1:] > edges[:-1]
        low, high = np.full(len(starts), -1), np.full(len(starts), -2)
        low[filled] = np.minimum.reduceat(by_order, starts[filled])
        high[filled] = np.maximum.reduceat(by_order, starts[filled])
        return low, high


def merge_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the groups of linked points; labels stay the least member's number."""
    parent = labels.copy()
    i, j = parent[i], parent[j]
    while True:
        ri, rj = parent[i], parent[j]
        differ = ri != rj
        if not differ.any():
            break
        i, j, ri, rj = i[differ], j[differ], ri[differ], rj[differ]
        np.minimum.at(parent, np.maximum(ri, rj), np.minimum(ri, rj))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent[labels]


class Planes:
    """Split planes of a k-d partition, fitted on a bounded sample of points."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        self.axis = np.zeros(2**self.depth, np.int8)
        self.at = np.zeros(2**self.depth)
        groups = [sample]
        node = 1
        for _ in range(self.depth):
            below = []
            for here in groups:
                if len(here):
                    axis = int(np.argmax(here.max(axis=0) - here.min(axis=0)))
                    cut = float(np.median(here[:, axis]))
                    left = here[:, axis] <= cut
                    self.axis[node], self.at[node] = axis, cut
                    below += [here[left], here[~left]]
                else:
                    below += [here, here]
                node += 1
            groups = below

    def assign(self, points: np.ndarray, halo: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home): each point's leaf and every other leaf within `halo` of it."""
        row, node, home = np.arange(len(points)), np.ones(len(points), np.int64), np.ones(len(points), bool)
        for _ in range(self.depth):
            off = points[row, self.axis[node]] - self.at[node]
            left, right = off <= halo, off >= -halo
            on_left = off <= 0
            row, node, home = (
                np.concatenate([row[left], row[right]]),
                np.concatenate([2 * node[left], 2 * node[right] + 1]),
                np.concatenate([home[left] & on_left[left], home[right] & ~on_left[right]]),
            )
        return row, node, home

    def assign_boxes(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): every leaf that each box reaches into."""
        row, node = np.arange(len(low)), np.ones(len(low), np.int64)
        for _ in range(self.depth):
            axis, at = self.axis[node], self.at[node]
            left, right = low[row, axis] <= at, high[row, axis] > at
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
        return row, node

    def blocks(self, sample: np.ndarray, total: int, rows: int) -> np.ndarray:
        """By leaf number: into how many blocks its rows are divided so that a block has
        about `rows` of them, as far as the sample tells; 1 for a leaf of ordinary size."""
        out = np.ones(2 ** (self.depth + 1), np.int64)
        if len(sample):
            _, leaf, _ = self.assign(sample, 0.0)
            held = np.bincount(leaf, minlength=len(out)) * (total / len(sample))
            crowded = held > 4 * rows
            out[crowded] = np.ceil(held[crowded] / rows)
        return out
