"""Exact searches and sums over pairs of points, in numpy, by boxes: points that lie together are cut into leaves, and a leaf meets only those leaves whose box it needs.

Points are matrices of numbers; a column is numeric or holds codes of categories, and NaN is a missing value. The squared difference of
two numbers counts as it is, that of categories is 0 or 1, and 1 where either side is missing. A box's bound is worked out by the
operations that give the distances, in their order, so it never exceeds a computed distance.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: Points of a leaf.
LEAF = 64

#: Lines (values of all columns but one) up to which least goes along lines instead of boxes.
LINES = 256


def leaves(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows of x and where leaves of at most `size` rows begin in it (the end included); equal rows keep their order."""
    order, cuts, stack = np.arange(len(x)), [0], [(0, len(x))]
    while stack:
        low, high = stack.pop()
        if high - low <= size:
            cuts.append(high)
            continue
        own = x[order[low:high]]
        widest = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if x.shape[1] else 0
        if x.shape[1] and own[:, widest].min() < own[:, widest].max():
            order[low:high] = order[low:high][np.argsort(own[:, widest], kind="stable")]
        middle = (low + high) // 2
        stack += [(middle, high), (low, middle)]
    return order, np.array(sorted(set(cuts)))


@dataclass
class Boxes:
    """Points in the order of their leaves, with the leaves' bounds."""

    points: np.ndarray
    order: np.ndarray
    begins: np.ndarray
    low: np.ndarray
    high: np.ndarray
    some: np.ndarray  # a missing value
    all: np.ndarray  # no other value

    @classmethod
    def of(cls, points: np.ndarray, codes: np.ndarray, size: int | None = None) -> Boxes:
        missing = np.isnan(points)
        placed = np.where(missing, 0.0, points)
        placed[:, codes] *= 1e-3  # to part by them after numbers that differ more
        order, begins = leaves(np.concatenate([missing * 1.0, placed], axis=1), size or LEAF)
        points, missing = points[order], missing[order]
        at = begins[:-1]
        if not len(points):
            none = np.zeros((0, points.shape[1]))
            return cls(points, order, np.zeros(1, np.int64), none, none, none.astype(bool), none.astype(bool))
        low = np.minimum.reduceat(np.where(missing, np.inf, points), at)
        high = np.maximum.reduceat(np.where(missing, -np.inf, points), at)
        return cls(points, order, begins, low, high, np.logical_or.reduceat(missing, at), np.logical_and.reduceat(missing, at))

    def __len__(self) -> int:
        return len(self.begins) - 1

    def rows(self, leaf: int) -> slice:
        return slice(self.begins[leaf], self.begins[leaf + 1])


def _added(parts: Sequence[np.ndarray], weights: Sequence[float | None]) -> np.ndarray:
    out = None
    for q, w in zip(parts, weights, strict=True):
        q = q if w is None else q * w
        out = q if out is None else out + q
    return out


def squares(a: np.ndarray, b: np.ndarray, codes: np.ndarray, weights: Sequence[float | None]) -> np.ndarray:
    """Squared distances of all rows of a to all of b: of each column its part, times its weight if it has one, in order."""
    parts = []
    for j in range(a.shape[1]):
        x, y = a[:, j][:, None], b[:, j][None]
        if codes[j]:
            parts.append((x != y).astype(float))
        else:
            gap = x - y
            gap *= gap
            parts.append(np.where(np.isnan(gap), 1.0, gap) if np.isnan(x).any() or np.isnan(y).any() else gap)
    return _added(parts, weights)


def bounds(a: Boxes, leaf: int, b: Boxes, codes: np.ndarray, weights: Sequence[float | None]) -> np.ndarray:
    """For each leaf of b the least that a squared distance to one leaf of a can be."""
    parts = []
    for j in range(a.points.shape[1]):
        gap = np.maximum(0.0, np.maximum(b.low[:, j] - a.high[leaf, j], a.low[leaf, j] - b.high[:, j]))
        part = (gap > 0).astype(float) if codes[j] else gap * gap
        part = np.where(a.some[leaf, j] | b.some[:, j], np.minimum(part, 1.0), part)
        parts.append(np.where(a.all[leaf, j] | b.all[:, j], 1.0, part))
    return _added(parts, weights)


def least(a: np.ndarray, b: np.ndarray, codes: np.ndarray, weights: Sequence[float | None]) -> np.ndarray:
    """For each row of a the least squared distance to a row of b (some), weights not negative. Where b lies on few lines these are searched, else boxes, with equal rows compared once."""
    if len(b) and (lines := _lines(b, codes)):
        return _least_on(lines, a, b, codes, weights)
    a, back = np.unique(a, axis=0, return_inverse=True)
    left, right = Boxes.of(a, codes), Boxes.of(np.unique(b, axis=0), codes)
    out = np.empty(len(a))
    for leaf in range(len(left)):
        bound = bounds(left, leaf, right, codes, weights)
        own = left.points[left.rows(leaf)]
        best = np.full(len(own), np.inf)
        for other in np.argsort(bound, kind="stable"):
            if bound[other] >= best.max():
                break
            np.minimum(best, squares(own, right.points[right.rows(other)], codes, weights).min(axis=1), out=best)
        out[left.order[left.rows(leaf)]] = best
    return out[back.reshape(-1)]


def _lines(b: np.ndarray, codes: np.ndarray) -> tuple[int, np.ndarray, np.ndarray] | None:
    """The column along which the lines run (a numeric one if there is one), an order of b's rows by line and then by that column (missing last), and where lines begin in it (the end included); None where there are too many."""
    values = [np.unique(b[:, j], return_inverse=True) for j in range(b.shape[1])]
    numeric = [j for j in range(b.shape[1]) if not codes[j]]
    along = max(numeric or range(b.shape[1]), key=lambda j: len(values[j][0]))
    line = np.zeros(len(b), np.int64)
    for j, (known, code) in enumerate(values):
        if j != along:
            if len(known) > LINES:
                return None
            line = np.unique(line * len(known) + code.reshape(-1), return_inverse=True)[1].reshape(-1)
    if line.max() >= LINES:
        return None
    order = np.lexsort((b[:, along], line))
    return along, order, np.searchsorted(line[order], np.arange(line.max() + 2))


def _least_on(lines: tuple[int, np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, codes: np.ndarray, weights: Sequence[float | None]) -> np.ndarray:
    along, order, begins = lines
    best, b = np.full(len(a), np.inf), b[order]
    by_value = np.argsort(a[:, along], kind="stable")  # questions in order are answered faster
    a = a[by_value]
    x = a[:, along]
    for low, high in zip(begins[:-1], begins[1:], strict=True):
        y = b[low:high, along]
        y = y[: len(y) - np.isnan(y).sum()]
        if not len(y):
            part = np.ones(len(x))
        elif codes[along]:
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            part = (y[at] != x).astype(float)
        else:
            at = np.searchsorted(y, x)
            under, over = x - y[np.maximum(at - 1, 0)], x - y[np.minimum(at, len(y) - 1)]
            part = np.minimum(under * under, over * over)
            part[np.isnan(part)] = 1.0
            if len(y) < high - low:
                np.minimum(part, 1.0, out=part)
        parts = [part if j == along else squares(a[:, [j]], b[low : low + 1, [j]], codes[[j]], [None])[:, 0] for j in range(a.shape[1])]
        np.minimum(best, _added(parts, weights), out=best)
    out = np.empty(len(a))
    out[by_value] = best
    return out


def nearest(a: np.ndarray, own: np.ndarray, b: np.ndarray, rank: np.ndarray, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of a, rows of b, distances): the k rows of b nearest to each row of a, of equal ones those of lower rank. own: the rank that a row of a leaves out (its own)."""
    by_rank = np.argsort(rank, kind="stable")
    weights = [None] * a.shape[1]
    left, right = Boxes.of(a, codes), Boxes.of(b[by_rank], codes)
    ranks = rank[by_rank][right.order]
    first = np.minimum.reduceat(ranks, right.begins[:-1]) if len(b) else np.zeros(0, np.int64)
    none = np.iinfo(np.int64).max
    found = []
    for leaf in range(len(left)):
        bound = np.sqrt(bounds(left, leaf, right, codes, weights))
        rows = left.order[left.rows(leaf)]
        d, r = np.full((len(rows), k), np.inf), np.full((len(rows), k), none)
        for other in np.lexsort((first, bound)):
            if bound[other] > d[:, -1].max():
                break
            open_ = np.flatnonzero((d[:, -1] > bound[other]) | ((d[:, -1] == bound[other]) & (r[:, -1] > first[other])))
            if not len(open_):
                continue
            spot = right.rows(other)
            new, theirs = np.sqrt(squares(a[rows[open_]], right.points[spot], codes, weights)), np.broadcast_to(ranks[spot], (len(open_), spot.stop - spot.start))
            new = np.where(theirs == own[rows[open_]][:, None], np.inf, new)
            last, after = d[open_, -1:], r[open_, -1:]
            better = np.flatnonzero(((new < last) | ((new == last) & (theirs < after))).any(axis=1))
            if not len(better):
                continue
            open_ = open_[better]
            new, theirs = np.concatenate([d[open_], new[better]], axis=1), np.concatenate([r[open_], theirs[better]], axis=1)
            theirs = np.where(np.isinf(new), none, theirs)
            kept = np.lexsort((theirs, new), axis=-1)[:, :k]
            d[open_], r[open_] = np.take_along_axis(new, kept, 1), np.take_along_axis(theirs, kept, 1)
        at, column = np.nonzero(r != none)
        found.append((rows[at], r[at, column], d[at, column]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    rows, theirs, d = (np.concatenate(f) for f in zip(*found, strict=True))
    return rows, by_rank[np.searchsorted(rank[by_rank], theirs)], d


def tent_sums(a: np.ndarray, b: np.ndarray, n: np.ndarray, scales: np.ndarray, reaches: np.ndarray) -> np.ndarray:
    """For each row of a, the sum over rows of b (n times each) of their similarity: the least 1 - |difference| / scale of a column, if all differences are within reach. A column with reach 0 tells apart what is not equal.

    Two leaves need no pairs where the same column decides for all, on one side and within reach: then count and sum of that column are enough.
    """
    part = np.where(reaches > 0, scales, 1e-3)  # what must be equal is parted first
    tents = np.flatnonzero(reaches > 0)
    none = np.zeros(a.shape[1], bool)
    left, right = Boxes.of(a / part, none), Boxes.of(b / part, none)
    for boxes, points in ((left, a), (right, b)):
        boxes.points = points[boxes.order]
        if len(points):
            boxes.low, boxes.high = np.minimum.reduceat(boxes.points, boxes.begins[:-1]), np.maximum.reduceat(boxes.points, boxes.begins[:-1])
    n = n[right.order]
    out = np.zeros(len(a))
    if not len(b):
        return out
    counts = np.add.reduceat(n, right.begins[:-1])
    sums = np.add.reduceat(n[:, None] * right.points, right.begins[:-1])
    for leaf in range(len(left)):
        x = left.points[left.rows(leaf)]
        above, below = right.low - left.high[leaf], left.low[leaf] - right.high  # gaps, if b lies above or below
        near, far = np.maximum(0.0, np.maximum(above, below)), np.maximum(right.high - left.low[leaf], left.high[leaf] - right.low)
        reached = ~(near > reaches).any(axis=1)
        within = reached & (far <= reaches).all(axis=1)
        total, mixed = np.zeros(len(x)), reached.copy()
        for j in tents:
            others = [i for i in tents if i != j]
            decides = within & (near[:, j] / scales[j] >= (far[:, others] / scales[others]).max(axis=1)) if others else within
            for gap, sign in ((above, 1.0), (below, -1.0)):
                whole = mixed & decides & (gap[:, j] >= 0)
                if whole.any():
                    mixed &= ~whole
                    count, of = counts[whole].sum(), sums[whole, j].sum()
                    total += count - sign * (of - count * x[:, j]) / scales[j]
        at = np.flatnonzero(mixed)
        for low in range(0, len(at), 256):
            which = np.concatenate([np.arange(right.begins[k], right.begins[k + 1]) for k in at[low : low + 256]])
            y, value = right.points[which], np.full((len(x), len(which)), 1.0)
            fits = np.ones(value.shape, bool)
            for j in range(x.shape[1]):
                gap = np.abs(x[:, j][:, None] - y[:, j][None])
                fits &= gap <= reaches[j]
                if reaches[j] > 0:
                    np.minimum(value, 1 - gap / scales[j], out=value)
            total += np.where(fits, np.maximum(value, 0.0), 0.0) @ n[which]
        out[left.order[left.rows(leaf)]] = total
    return out
