"""Box searches and sums against all pairs."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazeframe.operators import blocks, granules, hec, local, near, select
from hazeframe.sources import rows as R


def mixed(rng, n):
    """A number, a whole number and a category; missing values, many equal rows."""
    x, z, c = np.round(rng.normal(size=n) * 3, int(rng.integers(0, 3))), rng.integers(0, 13, n) * 1.0, rng.integers(0, 4, n) * 1.0
    x[rng.random(n) < 0.2] = c[rng.random(n) < 0.2] = np.nan
    return np.stack([x, z, c], axis=1)


CODES = np.array([False, False, True])


@pytest.mark.parametrize("seed", range(8))
def test_searches_equal_all_pairs(seed):
    rng = np.random.default_rng(seed)
    a, b = mixed(rng, int(rng.integers(1, 300))), mixed(rng, int(rng.integers(1, 400)))
    weights = [None, 0.3, 2.0]
    assert (near.least(a, b, CODES, weights) == near.squares(a, b, CODES, weights).min(axis=1)).all()
    d, rank, k = np.sqrt(near.squares(a, b, CODES, [None] * 3)), rng.permutation(len(b)), int(rng.integers(1, 9))
    own = np.where(np.arange(len(a)) < len(b), rank[np.minimum(np.arange(len(a)), len(b) - 1)], -1)
    want = [(i, int(j), d[i, j]) for i in range(len(a)) for j in [j for j in np.lexsort((rank, d[i])) if rank[j] != own[i]][:k]]
    assert sorted(zip(*(x.tolist() for x in near.nearest(a, own, b, rank, CODES, k)), strict=True)) == sorted(want)


def tents(a, b, n, scales, reaches):
    gaps = np.abs(a[:, None] - b[None])
    value = np.where(reaches > 0, np.maximum(0, 1 - gaps / scales), 1.0).min(axis=2)
    return np.where((gaps <= reaches).all(axis=2), value, 0.0) @ n


@pytest.mark.parametrize("seed", range(8))
def test_tent_sums_equal_all_pairs(seed):
    rng = np.random.default_rng(seed)
    columns = 1 + seed % 3
    a, b = rng.normal(size=(200, columns)) * 3, rng.normal(size=(300, columns)) * 3
    if seed > 3:
        a, b = np.round(a), np.round(b)
    scales = rng.uniform(0.5, 4, columns)
    reaches, n = scales * rng.choice([0, 0.5, 1, 1], columns), rng.integers(1, 5, 300) * 1.0
    assert near.tent_sums(a, b, n, scales, reaches) == pytest.approx(tents(a, b, n, scales, reaches))


def test_granules_of_sets_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PART", 16)
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"u": np.round(rng.normal(size=120) * 4, 1), "v": rng.normal(size=120), "w": 1.0, "c": rng.choice(["p", "q"], 120)})
    frame = pd.concat([frame, frame.iloc[:40]], ignore_index=True)
    df = R.ingest(spark, frame)
    for names in (["u", "v"], ["v", "u", "c", "w"], ["u", "c"], ["c"]):
        features = granules.describe(df, names, 0.5)
        x = np.stack([pd.factorize(frame[f.name])[0] if f.name == "c" else frame[f.name] for f in features], axis=1).astype(float)
        want = tents(x, x, np.ones(len(x)), np.array([f.scale for f in features]), np.array([f.reach for f in features]))
        got = {r.i: r["size"] for r in granules.set_sizes(df, features, "id").collect()}
        assert [got[i] for i in range(len(x))] == pytest.approx(want)


def test_last_feature_is_chosen_without_sizes_of_sets(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("one candidate is left, so no value decides")

    monkeypatch.setattr(granules, "set_sizes", refuse)
    rng = np.random.default_rng(4)
    df = R.ingest(spark, pd.DataFrame({"u": rng.normal(size=30), "v": rng.normal(size=30), "w": rng.normal(size=30), "label": rng.choice(["p", "q"], 30)}))
    model = select.FuzzyGranularitySelector(label_col="label", n_features=2).fit(df)
    assert sorted(model.fitted("ranking")) == ["u", "v", "w"]


def test_relevance_by_boxes_equals_all_pairs_in_parts(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PART", 16)
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"a": np.round(rng.normal(size=90), 1), "b": rng.choice(["u", "v", None], 90), "z": rng.integers(0, 4, 90) * 1.0, "label": rng.choice(["x", "y", "y", None], 90)})
    frame.loc[::7, "a"] = None
    df = R.ingest(spark, frame)
    columns, region = ["a", "b", "z"], df.filter("id % 3 = 0").select("id")
    sets = [[(0, None)], [(1, None), (2, None)], [(2, 0.25), (0, 2.0), (1, 0.5)]]
    got = hec.least_squares(df, region, columns, "id", "label", sets)
    pairs = hec.to_region(df, region, columns, "id", "label")
    square = [sum((F.col(f"q{k}") * (1.0 if w is None else w) for k, w in own[1:]), F.col(f"q{own[0][0]}") * (own[0][1] or 1.0)) for own in sets]
    want = pairs.groupBy("a_id", "b_label").agg(*(F.min(q).alias(f"s{k}") for k, q in enumerate(square)))
    key = lambda r: (r.a_id, r.b_label or "")
    assert sorted(map(tuple, sorted(got.collect(), key=key)), key=str) == sorted(map(tuple, sorted(want.collect(), key=key)), key=str)


def test_neighbours_in_parts_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PART", 8)
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"id": [f"r{k}" for k in rng.permutation(80)], "a": np.round(rng.normal(size=80), 1), "c": rng.choice(["u", "v", None], 80), "label": rng.choice(["x", "y", None], 80)})
    frame.loc[::5, "a"] = None
    df = R.ingest(spark, frame)
    pairs = hec.hybrid_distances(df, ["a", "c"], "id", "label").toPandas().sort_values(["a_id", "d", "b_id"]).groupby("a_id").head(4)
    got = hec.same_class_neighbours(df, ["a", "c"], "id", "label", 4).collect()
    assert sorted(map(tuple, got)) == sorted(pairs[["a_id", "b_id", "d"]].itertuples(index=False, name=None))


def test_large_leaf_needs_no_matrix_of_pairs():
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(300, 2)), 3, axis=0)
    us = [rng.dirichlet(np.ones(c), len(x)) for c in range(1, 5)]
    got = local.silhouettes(x, us, 1.0)
    for u, score in zip(us, got, strict=True):
        label, apart, two = u.argmax(axis=1), local.distances(x), np.sort(u, axis=1)[:, -2:]
        if u.shape[1] == 1:
            assert score == 0.0
            continue
        means = np.stack([apart[:, label == c].mean(axis=1) for c in range(u.shape[1])], axis=1)
        a = means[np.arange(len(x)), label]
        means[np.arange(len(x)), label] = np.inf
        weight = two[:, 1] - two[:, 0]
        assert score == pytest.approx((weight * (means.min(axis=1) - a) / np.maximum(a, means.min(axis=1))).sum() / weight.sum())
    tracemalloc.start()
    local.best_clusters(rng.normal(size=(6000, 2)), 2.0, 3, 1e-5, 1.0, 3, 1)
    assert tracemalloc.get_traced_memory()[1] < 120e6  # a matrix of all pairs has 288 MB
    tracemalloc.stop()


def test_partitions_of_a_leaf_go_together_over_distinct_rows():
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(90, 3)) * [30, 8000, 0.01], rng.integers(1, 5, 90), axis=0)
    for m, tol, turns in ((2, 1e-5, 60), (2, 0.5, 60), (3, 1e-2, 40), (2, 1e-5, 1)):
        for c, got in enumerate(local.c_means(x, range(1, 6), m, turns, tol, 1), 1):
            u = np.random.default_rng(1).random((len(x), c))
            u /= u.sum(axis=1, keepdims=True)
            for _ in range(turns):
                w, before = u**m, u
                centers = (w.T @ x) / w.sum(axis=0)[:, None]
                u = np.maximum(np.stack([np.linalg.norm(x - v, axis=1) for v in centers], axis=1), 1e-10) ** (-2 / (m - 1))
                u /= u.sum(axis=1, keepdims=True)
                if np.linalg.norm(u - before) < tol:
                    break
            assert np.allclose(got, centers, rtol=1e-6, atol=1e-6)
            assert np.allclose(local.memberships(x, got, m).T, u, atol=1e-6)


@pytest.mark.parametrize("seed", range(12))
def test_least_distances_along_lines_equal_all_pairs_without_boxes(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    a, b = mixed(rng, int(rng.integers(0, 200))), mixed(rng, int(rng.integers(1, 300)))
    b[rng.random(len(b)) < 0.05, 1] = np.nan
    monkeypatch.setattr(near, "Boxes", None)
    for which in ([0], [1], [2], [0, 1], [2, 0], [1, 2], [2, 1, 0]):
        weights = [[None, 0.3, 2.0][k] for k in which]
        assert (near.least(a[:, which], b[:, which], CODES[which], weights) == near.squares(a[:, which], b[:, which], CODES[which], weights).min(axis=1)).all()


def test_least_distances_of_many_lines_go_by_boxes(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = mixed(rng, 150), mixed(rng, 250)
    monkeypatch.setattr(near, "LINES", 4)
    monkeypatch.setattr(near, "_least_on", None)
    assert (near.least(a, b, CODES, [None] * 3) == near.squares(a, b, CODES, [None] * 3).min(axis=1)).all()
