"""NumPy search trees over points of a plane, and distances on a sphere from every point to all."""

from __future__ import annotations

import math

import numpy as np

LEAF = 16
#: Pairs of a point and a node that a search holds at once; a larger batch is halved.
PAIRS = 1 << 19


class Tree:
    """A balanced tree of boxes over points, which are numbered in the order of preference among ties."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n = len(x)
        self.depth = max(0, math.ceil(math.log2(n / LEAF)))
        order, cuts = np.arange(n), [0, n]
        for _ in range(self.depth):
            halves = [0]
            for s, e in zip(cuts, cuts[1:]):
                part, mid = order[s:e], (e - s) // 2
                wide = x if np.ptp(x[part]) >= np.ptp(y[part]) else y
                order[s:e] = part[np.argpartition(wide[part], mid)]
                halves += [s + mid, e]
            cuts = halves
        # A leaf that is shorter than the longest repeats its first point.
        starts, sizes = np.array(cuts[:-1]), np.diff(cuts)
        at = np.arange(sizes.max())[None, :]
        self.points = np.sort(order[starts[:, None] + np.where(at < sizes[:, None], at, 0)], axis=1)
        self.x, self.y = x[self.points], y[self.points]
        boxes = np.stack([self.x.min(1), self.x.max(1), self.y.min(1), self.y.max(1)], axis=1)
        self.boxes = [boxes]
        for _ in range(self.depth):
            a, b = boxes[0::2], boxes[1::2]
            boxes = np.where([True, False, True, False], np.minimum(a, b), np.maximum(a, b))
            self.boxes.insert(0, boxes)

    def _apart(self, level: int, node: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """A square that none of a node's points is nearer than; rounding keeps the order, so this is exact."""
        b = self.boxes[level][node]
        dx = np.maximum(np.maximum(b[:, 0] - x, x - b[:, 1]), 0)
        dy = np.maximum(np.maximum(b[:, 2] - y, y - b[:, 3]), 0)
        return dx * dx + dy * dy

    def _leaf(self, node: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dx, dy = x[:, None] - self.x[node], y[:, None] - self.y[node]
        d2 = dx * dx + dy * dy
        best = d2.argmin(1)
        row = np.arange(len(node))
        return d2[row, best], self.points[node, best]

    def nearest(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance and number of the nearest point of each (x, y); the least number among equal squares."""
        m = len(x)
        if not m:
            return np.zeros(0), np.zeros(0, dtype=np.int64)
        node = np.zeros(m, dtype=np.int64)
        for level in range(1, self.depth + 1):
            left = self._apart(level, 2 * node, x, y)
            node = 2 * node + (self._apart(level, 2 * node + 1, x, y) < left)
        bound, _ = self._leaf(node, x, y)
        p, node = np.arange(m), np.zeros(m, dtype=np.int64)
        for level in range(1, self.depth + 1):
            p, node = np.repeat(p, 2), (2 * node[:, None] + np.array([0, 1])).ravel()
            stay = self._apart(level, node, x[p], y[p]) <= bound[p]
            p, node = p[stay], node[stay]
            if len(p) > PAIRS and m > 1:
                halves = [self.nearest(x[s], y[s]) for s in (slice(None, m // 2), slice(m // 2, None))]
                return tuple(np.concatenate(h) for h in zip(*halves))
        found = [self._leaf(node[s : s + PAIRS // 8], x[p[s : s + PAIRS // 8]], y[p[s : s + PAIRS // 8]]) for s in range(0, len(p), PAIRS // 8)]
        d2, number = (np.concatenate(f) for f in zip(*found))
        first = np.searchsorted(p, np.arange(m))  # a point keeps the leaf that gave its bound
        least = np.minimum.reduceat(d2, first)
        number = np.where(d2 == least[p], number, np.iinfo(np.int64).max)
        return least, np.minimum.reduceat(number, first)


def haversine_array(lat1, lon1, lat2, lon2, radius: float = 6371000.0):
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * radius * np.arcsin(np.sqrt(np.minimum(a, 1.0)))


class Sphere:
    """Places on a sphere with counts, and the least and median distance from one of them to the rest.

    Cosines, one product a pair, only sort the places into bins far wider than their rounding;
    the distances that decide are haversines of all places in the bins at stake.
    """

    NOISE = 1e-13

    def __init__(self, lat: np.ndarray, lon: np.ndarray, count: np.ndarray):
        self.lat, self.lon, self.count = lat, lon, count.astype(np.int64)
        a, o = np.radians(lat), np.radians(lon)
        self.unit = np.stack([np.cos(a) * np.cos(o), np.cos(a) * np.sin(o), np.sin(a)])
        self.total = int(self.count.sum())

    def _sorted(self, lat: float, lon: float, which: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = haversine_array(lat, lon, self.lat[which], self.lon[which])
        order = np.argsort(m, kind="stable")
        return m[order], np.cumsum(count[which][order])

    def spacing(self, i: int, own: int) -> tuple[float, float] | tuple[None, None]:
        """Least and median distance from place i to all rows but ``own`` of its own; None where there are no others."""
        count = self.count.copy()
        count[i] -= own
        n = self.total - own
        if n == 0:
            return None, None
        cosine = self.unit[:, i] @ self.unit
        low, high = cosine.min(), cosine.max()
        bins = int(min(max((high - low) / self.NOISE, 1), max(len(count) // 4, 1)))
        at = np.minimum(((high - cosine) * (bins / (high - low) if high > low else 0.0)).astype(np.int64), bins - 1)
        upto = np.cumsum(np.bincount(at, weights=count, minlength=bins)).astype(np.int64)

        def ranked(*ranks: int) -> list[float]:
            b = np.searchsorted(upto, ranks, side="right")
            b0, b1 = max(int(b.min()) - 1, 0), int(b.max()) + 1
            which = np.flatnonzero((at >= b0) & (at <= b1))
            m, here = self._sorted(self.lat[i], self.lon[i], which, count)
            before = int(upto[b0 - 1]) if b0 else 0
            return [float(m[np.searchsorted(here, r - before, side="right")]) for r in ranks]

        least = 0.0 if count[i] else ranked(0)[0]
        lower, upper = ranked((n - 1) // 2, n // 2)
        return least, 0.5 * lower + 0.5 * upper
