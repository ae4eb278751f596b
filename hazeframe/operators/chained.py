"""Adaptive nearest neighbours and chained regressions for the rows of one cluster, in numpy.

Chained equations after van Buuren & Groothuis-Oudshoorn (2011), each regression a Bayesian ridge (MacKay 1992, Tipping 2001).
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Sequence
from typing import Any

import numpy as np


def bayesian_ridge(x: np.ndarray, y: np.ndarray, rounds: int = 300, tol: float = 1e-3) -> tuple[np.ndarray, float]:
    """Coefficients and intercept; precisions of noise and weights maximise the evidence under vague gamma priors."""
    x_mean, y_mean = x.mean(axis=0), y.mean()
    xc, yc = x - x_mean, y - y_mean
    u, s, vt = np.linalg.svd(xc, full_matrices=False)
    eigen = s * s
    noise, prior, tiny = 1 / (y.var() + np.finfo(float).eps), 1.0, 1e-6
    before = None
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        w = vt.T @ ((s / (eigen + prior / noise)) * (u.T @ yc))
        kept = float((noise * eigen / (prior + noise * eigen)).sum())
        residual = float(((yc - xc @ w) ** 2).sum())
        prior = (kept + 2 * tiny) / (float(w @ w) + 2 * tiny)
        noise = (len(y) - kept + 2 * tiny) / (residual + 2 * tiny)
        if before is not None and np.abs(w - before).sum() < tol:
            break
        before = w
    return w, float(y_mean - x_mean @ w)


def chained_impute(x: np.ndarray, max_iter: int, bounds: Sequence[float], tol: float = 1e-3) -> np.ndarray:
    """Fills NaN: column means first, then each column by regression on the others, in ascending order of missing cells. A column without values is left out and takes the mean of the bounds' nearest: 0 within them."""
    missing = np.isnan(x)
    out = x.copy()
    known = ~missing.all(axis=0)
    means = np.array([x[~missing[:, j], j].mean() if known[j] else np.clip(0.0, *bounds) for j in range(x.shape[1])])
    out[missing] = np.take(means, np.nonzero(missing)[1])
    order = [j for j in np.argsort(missing.sum(axis=0), kind="stable") if missing[:, j].any() and known[j] and not missing[:, j].all()]
    others = {j: [i for i in range(x.shape[1]) if i != j and known[i]] for j in order}
    limit = tol * (np.abs(x[~missing]).max() if (~missing).any() else 1.0)
    settled: dict[int, tuple[np.ndarray, float]] = {}  # regressions on cells that were there from the start stay as they are
    for _ in range(max_iter):
        before = out.copy()
        for j in order:
            if not others[j]:
                continue
            own = missing[:, j]
            w, b = settled.get(j) or bayesian_ridge(out[~own][:, others[j]], out[~own, j])
            if j not in settled and not missing[~own][:, others[j]].any():
                settled[j] = w, b
            out[own, j] = np.clip(out[own][:, others[j]] @ w + b, *bounds)
        if not order or np.abs(out - before).max() < limit:
            break
    return out


def best_k(order_values: np.ndarray, true_value: float, max_k: int) -> int:
    """order_values: a column in order of distance. The k up to max_k whose mean of non-NaN among the first k is nearest the true value; the first of equal ones."""
    head = order_values[:max_k]
    present = ~np.isnan(head)
    counts = np.cumsum(present)
    sums = np.cumsum(np.where(present, head, 0.0))
    errors = np.full(len(head), np.inf)
    errors[counts > 0] = np.abs(sums[counts > 0] / counts[counts > 0] - true_value)
    return int(errors.argmin()) + 1


#: Solved systems that are remembered.
SOLVED = 1 << 16


def _first(distance: np.ndarray, k: int) -> np.ndarray:
    """The k smallest in order, of equal ones the first."""
    if len(distance) > k:
        near = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
        return near[np.argsort(distance[near], kind="stable")][:k]
    return np.argsort(distance, kind="stable")


def impute_rows(x: np.ndarray, train: np.ndarray | None, ids: np.ndarray, *, means: Sequence[float], bounds: Sequence[float], max_k: int, max_iter: int, seed: int, feedback: bool = True) -> np.ndarray:
    """x with its NaN filled, rows with fewer of them first; each filled row serves those after it. train: further rows of the pool. Without feedback, train (x if there is none) is the whole pool and stays as it is.

    A row's neighbours are compared by what it has besides one hidden value. Where it has no more than that, all are equally near and the
    first count: those are kept up as rows are filled. Where it has nothing, the whole pool regresses: lines through the means, which the
    means then satisfy, so count and sums are kept up. Equal systems are solved once.
    """
    if not feedback:
        pool = x.copy() if train is None else train
    else:
        pool = x.copy() if train is None or (train.shape == x.shape and np.array_equal(train, x, equal_nan=True)) else np.vstack([x, train])
    missing, absent = np.isnan(x), np.isnan(pool)
    out = x.copy()
    rows = np.flatnonzero(missing.any(axis=1))
    whole = ~absent.any(axis=1)
    count, sums = int(whole.sum()), pool[whole].sum(axis=0)
    firsts: dict[int, list[int]] = {}  # by the one column a row has: the first rows that have all others
    solved: dict[bytes, np.ndarray] = {}

    def solve(rows_for: np.ndarray) -> np.ndarray:
        key = rows_for.tobytes()
        if key not in solved:
            if len(solved) >= SOLVED:
                solved.clear()
            solved[key] = chained_impute(rows_for, max_iter, bounds)[-1]
        return solved[key]

    for i in rows[np.argsort(missing[rows].sum(axis=1), kind="stable")]:
        row = x[i]
        lacks = missing[i]
        observed = np.flatnonzero(~lacks)
        if len(observed) == 0:
            centre = sums / max(count, 1)
            if not count:
                out[i] = means
            elif (np.clip(centre, *bounds) == centre).all():
                out[i] = centre
            else:
                out[i] = chained_impute(np.vstack([pool[~absent.any(axis=1)], row]), max_iter, bounds)[-1]
        else:
            hidden = observed[_draw(ids[i], seed, len(observed))]
            if len(observed) == 1:
                if hidden not in firsts:
                    firsts[hidden] = np.flatnonzero(~absent[:, lacks].any(axis=1))[:max_k].tolist()
                near = np.array(firsts[hidden], np.int64)
            else:
                usable = np.flatnonzero(~absent[:, lacks].any(axis=1))
                shown = observed[observed != hidden]
                gaps = np.zeros((len(usable), x.shape[1]))  # sums of as many terms as there are columns
                gaps[:, shown] = np.where(absent[usable][:, shown], 0.0, pool[usable][:, shown] - row[shown])
                near = usable[_first(np.sqrt((gaps**2).sum(axis=1)), max_k)]
            if len(near):
                near = near[: best_k(pool[near, hidden], row[hidden], max_k)]
                out[i] = solve(np.vstack([pool[near], row]))
            else:
                out[i] = np.where(lacks, means, row)
        if feedback:
            pool[i], absent[i] = out[i], False
            count, sums = count + 1, sums + out[i]
            for column, first in firsts.items():
                if lacks.sum() > lacks[column] and (len(first) < max_k or i < first[-1]):
                    insort(first, int(i))
                    del first[max_k:]
    return out


def _draw(row_id: Any, seed: int, n: int) -> int:
    """A number below n from the row's id and the seed, whatever the order of rows."""
    value = int(row_id) if isinstance(row_id, (int, np.integer)) else int.from_bytes(str(row_id).encode(), "little")
    return (value * 2654435761 + seed * 40503 + 12345) % (2**61 - 1) % n
