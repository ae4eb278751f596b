"""Flat column expressions for distances, memberships and arg-extrema; they stay in whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distances to centres are not smaller than this.
FLOOR = 1e-10


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def null_distance(a: Sequence[Column], b: Sequence[Column], scale: Sequence[Column] | None = None) -> Column:
    """Euclidean distance over the coordinates that both sides have; 0 if there is none. scale: divisors of the squares."""
    squares = []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        square = (x - y) * (x - y)
        squares.append(F.coalesce(square if scale is None else square / scale[k], F.lit(0.0)))
    return F.sqrt(total(squares))


def centre_distances(columns: Sequence[Column], centres: Sequence[Sequence[float]], sigma: Sequence[Sequence[float]] | None = None) -> list[Column]:
    """One distance for each centre; the centres are literals."""
    out = []
    for k, centre in enumerate(centres):
        scale = None if sigma is None else [F.lit(float(s) + FLOOR) for s in sigma[k]]
        out.append(null_distance(columns, [F.lit(float(v)) for v in centre], scale))
    return out


def memberships(distances: Sequence[Column], m: float) -> list[Column]:
    """Fuzzy memberships from distances, which are floored: 1 over the sum of (d_k / d_l) ** (2 / (m - 1))."""
    floored = [F.greatest(d, F.lit(FLOOR)) for d in distances]
    if len(floored) == 1:
        return [F.lit(1.0)]
    powers = [F.pow(d, F.lit(-2.0 / (m - 1))) for d in floored]
    whole = total(powers)
    return [p / whole for p in powers]


def arg_min(columns: Sequence[Column]) -> Column:
    """Position (from 0) of the smallest; the first of equal ones."""
    return _arg(columns, F.least)


def arg_max(columns: Sequence[Column]) -> Column:
    return _arg(columns, F.greatest)


def _arg(columns: Sequence[Column], best: object) -> Column:
    if len(columns) == 1:
        return F.lit(0)
    extreme = best(*columns)
    choice = F.when(columns[0] == extreme, 0)
    for k, c in enumerate(columns[1:], 1):
        choice = choice.when(c == extreme, k)
    return choice


def pick(index: Column, values: Sequence[Column]) -> Column:
    """The value at a position."""
    choice = F.when(index == 0, values[0])
    for k, v in enumerate(values[1:], 1):
        choice = choice.when(index == k, v)
    return choice


def mean_masked_change(new: Sequence[Column | str], old: Sequence[Column | str], masks: Sequence[Column | str]) -> Column:
    """An aggregate: the mean of |new - old| over all cells that a mask marks, whose difference is known; 0 if there are none."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    changes = [F.when(as_column(m), F.abs(as_column(a) - as_column(b))) for a, b, m in zip(new, old, masks, strict=True)]
    count = F.sum(total([c.isNotNull().cast("long") for c in changes]))
    return F.coalesce(F.sum(total([F.coalesce(c, F.lit(0.0)) for c in changes])) / F.nullif(count, F.lit(0)), F.lit(0.0))
