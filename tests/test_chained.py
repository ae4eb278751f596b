"""Filled rows against the plain form, which compares each with the whole pool."""

from __future__ import annotations

import numpy as np
import pytest

from hazeframe.operators import chained


def plain(x, train, ids, means, bounds, max_k, max_iter, seed, feedback):
    pool = train.copy() if not feedback and train is not None else x.copy() if train is None else np.vstack([x, train])
    missing, out = np.isnan(x), x.copy()
    rows = np.flatnonzero(missing.any(axis=1))
    for i in rows[np.argsort(missing[rows].sum(axis=1), kind="stable")]:
        usable, observed = pool[~np.isnan(pool[:, missing[i]]).any(axis=1)], np.flatnonzero(~missing[i])
        if not len(usable):
            out[i] = np.where(missing[i], means, x[i])
        else:
            if len(observed):
                hidden = observed[chained._draw(ids[i], seed, len(observed))]
                gaps = np.delete(usable - x[i], hidden, axis=1)
                order = np.argsort(np.sqrt((np.where(np.isnan(gaps), 0.0, gaps) ** 2).sum(axis=1)), kind="stable")
                usable = usable[order][: chained.best_k(usable[order, hidden], x[i, hidden], max_k)]
            out[i] = chained.chained_impute(np.vstack([usable, x[i]]), max_iter, bounds)[-1]
        if feedback:
            pool[i] = out[i]
    return out


@pytest.mark.parametrize("seed", range(24))
def test_rows_are_filled_as_by_the_whole_pool(seed):
    rng = np.random.default_rng(seed)
    columns, n = 1 + seed % 4, int(rng.integers(2, 90))
    x, train = np.round(rng.normal(size=(n, columns)) * 5, int(rng.integers(0, 3))), rng.normal(size=(30, columns)) * 5
    x[rng.random(x.shape) < 0.35] = train[rng.random(train.shape) < 0.2] = np.nan
    options = {"means": [0.5] * columns, "bounds": [-1.0, 1.0] if seed % 5 == 0 else [-30.0, 30.0], "max_k": int(rng.integers(1, 12)), "max_iter": 5, "seed": seed, "feedback": seed % 3 > 0}
    pool = [None, train][seed // 4 % 2]
    assert chained.impute_rows(x, pool, np.arange(n), **options) == pytest.approx(plain(x, pool, np.arange(n), **options), rel=1e-9, abs=1e-9)


def test_no_row_regresses_on_the_whole_pool_and_equal_systems_are_solved_once(monkeypatch):
    sizes, ridge = [], chained.bayesian_ridge
    monkeypatch.setattr(chained, "bayesian_ridge", lambda x, y: sizes.append(len(y)) or ridge(x, y))
    i = np.arange(7700)
    x = np.stack([i % 50 + 1.0, i % 100 / 10], axis=1)
    x[i % 7 == 0, 0] = x[i % 11 == 3, 1] = np.nan
    filled = chained.impute_rows(x, x, i, means=[25.0, 5.0], bounds=[0.0, 50.0], max_k=10, max_iter=5, seed=1)
    assert not np.isnan(filled).any() and max(sizes) <= 10 and len(sizes) < 1000
