"""The fuzzy engine: operators, estimators, persistence, streams, and the catalog against DuckDB."""

from __future__ import annotations

import glob
import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.linalg import DenseVector
from pyspark.sql import functions as F

from hazeframe.functions import distances as D
from hazeframe.functions.validation import NotFittedError, check_input, validate_params
from hazeframe.operators import chained, fcm, granules, hec, impute, local, rough, select
from hazeframe.plans import catalog
from hazeframe.sources import rows as R
from hazeframe.streaming.transform import impute_stream

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return con


def normal(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple("NULL" if pd.isna(v) else f"{v + 0.0:.9g}" if isinstance(v, (float, np.floating)) else str(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_catalog(spark, oracle, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.ORACLES:
        want = oracle.execute(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)
    else:
        assert len(got)


# --- validation and rows


@pytest.mark.parametrize(
    "params, error",
    [
        ({"max_clusters": 0}, ValueError), ({"max_clusters": 1.5}, TypeError), ({"max_iter": 1}, ValueError), ({"max_k": 0}, ValueError), ({"random_state": "a"}, TypeError), ({"m": 1.0}, ValueError), ({"m": "2"}, TypeError),
        ({"tol": 0}, ValueError), ({"wl": 0}, ValueError), ({"wl": 1.1}, ValueError), ({"wb": -0.1}, ValueError), ({"tau": -1}, ValueError), ({"k": 1}, ValueError), ({"n_features": 0}, ValueError), ({"stop_threshold": -1}, ValueError),
        ({"min_samples_leaf": 0}, ValueError), ({"learning_rate": 0}, ValueError), ({"eps": 0}, ValueError), ({"n_jobs": 0}, ValueError), ({"sigma": 1}, TypeError),
    ],
)
def test_bad_parameters(params, error):
    with pytest.raises(error, match=next(iter(params))):
        validate_params(params)


def test_good_parameters():
    validate_params({"max_clusters": 1, "m": 2, "wl": 1, "wb": 0, "tau": 0, "random_state": None, "unknown": object(), "sigma": True})


def test_ingest(spark):
    got = R.ingest(spark, [[1.0, None], [float("nan"), 4.0]]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(0, 1.0, None), (1, None, 4.0)]
    assert [f.dataType.simpleString() for f in R.ingest(spark, [["a", 1], ["b", 2]]).schema][1:] == ["string", "string"]
    assert R.ingest(spark, np.eye(3)).count() == 3
    for bad, error in ((5, TypeError), ("ab", TypeError), ([1, 2], ValueError), (np.zeros((2, 2, 2)), ValueError), ([[1, 2], [3]], TypeError), (pd.DataFrame({"a": []}), ValueError)):
        with pytest.raises(error):
            R.ingest(spark, bad)


def test_input_checks(spark):
    df = R.ingest(spark, pd.DataFrame({"a": [1.0, None], "b": [None, 2.0], "c": ["x", "y"], "e": [None, None]}).astype({"e": float}))
    with pytest.raises(TypeError, match="'c'"):
        check_input(df, ["a", "c"], require_numeric=True)
    with pytest.raises(ValueError, match="missing values"):
        check_input(df, ["a"], allow_nan=False)
    with pytest.raises(ValueError, match="at least one row with no missing"):
        check_input(df, ["a", "b"], require_complete_rows=True)
    with pytest.raises(ValueError, match="1 columns"):
        check_input(df, ["a", "e"], no_nan_columns=True)
    with pytest.raises(ValueError, match="at least one sample"):
        check_input(df.limit(0), ["a"])
    with pytest.raises(TypeError):
        check_input([[1]], ["a"])


def test_split_is_a_partition(spark):
    df = R.ingest(spark, pd.DataFrame({"a": [1.0, None, 3.0], "b": [1.0, 2.0, None]}))
    complete, incomplete = R.split_complete_incomplete(df, ["a", "b"])
    assert [r.id for r in complete.collect()] == [0] and sorted(r.id for r in incomplete.collect()) == [1, 2]


# --- fuzzy clustering


def plain_fcm(x, u, m, rounds):
    for _ in range(rounds):
        w = u**m
        v = w.T @ x / w.sum(axis=0)[:, None]
        d = np.maximum(np.linalg.norm(x[:, None] - v[None], axis=2), 1e-10)
        u = 1 / ((d[:, :, None] / d[:, None, :]) ** (2 / (m - 1))).sum(axis=2)
    return v, u


@pytest.mark.parametrize("m", [1.5, 2.0, 3.0])
def test_fcm_equals_dense_numpy(spark, m):
    x = np.random.default_rng(0).normal(size=(40, 3))
    df = R.ingest(spark, x)
    u0 = np.array([list(r)[1:] for r in df.select("id", *(u.alias(f"u{k}") for k, u in enumerate(fcm.start_memberships("id", 4, 9)))).orderBy("id").collect()])
    assert np.allclose(u0.sum(axis=1), 1)
    found = fcm.fuzzy_c_means(df, ["c0", "c1", "c2"], 4, m, max_iter=6, tol=1e-300, random_state=9)
    v, u = plain_fcm(x, u0, m, 6)
    assert np.allclose(found.centers, v)
    got = np.array([list(r) for r in fcm.fcm_predict(df, ["c0", "c1", "c2"], found.centers, m).orderBy("id").select("u0", "u1", "u2", "u3").collect()])
    assert np.allclose(got, u) and np.allclose(got.sum(axis=1), 1)
    assert fcm.fcm_objective(df, ["c0", "c1", "c2"], found.centers, m) == pytest.approx((u**m * np.linalg.norm(x[:, None] - v[None], axis=2) ** 2).sum())


def test_fcm_stops_and_one_cluster_is_the_mean(spark):
    df = R.ingest(spark, [[0.0], [1.0], [10.0], [11.0]])
    found = fcm.fuzzy_c_means(df, ["c0"], 2, tol=1e-4)
    assert found.iterations < 100 and np.allclose(np.sort(found.centers.ravel()), [0.5, 10.5], atol=0.1)
    assert fcm.fuzzy_c_means(df, ["c0"], 1).centers.tolist() == [[5.5]]


def test_knee():
    assert fcm.knee([1, 2, 3, 4, 5, 6, 7], [100, 40, 12, 10, 9, 8, 7]) == 3
    assert fcm.knee([1, 2], [2, 1]) is None and fcm.knee([1, 2, 3], [1, 1, 1]) is None


def test_null_distance(spark):
    df = R.ingest(spark, [[1.0, None, 3.0], [None, None, None]])
    d = D.null_distance([F.col(f"c{k}") for k in range(3)], [F.lit(4.0), F.lit(5.0), F.lit(7.0)])
    assert [r.d for r in df.orderBy("id").select(d.alias("d")).collect()] == [5.0, 0.0]


def test_arg_extrema_take_the_first(spark):
    row = spark.range(1).select(D.arg_min([F.lit(2), F.lit(1), F.lit(1)]).alias("a"), D.arg_max([F.lit(2), F.lit(2), F.lit(1)]).alias("b")).first()
    assert (row.a, row.b) == (1, 0)


# --- imputers

NUMBERS = pd.DataFrame({"num1": [1.0, 2.0, 3.0, 10.0, 11.0, 12.0, None, 2.5], "num2": [1.0, 2.0, 1.5, 10.0, None, 11.0, 10.5, None], "num3": [5.0, 5.5, 5.2, 50.0, 51.0, 49.0, 50.0, 5.1]})
ALL = [
    impute.FCMCentroidImputer(n_clusters=2, random_state=1), impute.FCMParameterImputer(n_clusters=2, random_state=1), impute.FCMRoughParameterImputer(n_clusters=2, random_state=1, nan_distance="observed"), impute.FCMKIterativeImputer(n_clusters=2, random_state=1, max_FCM_iter=10),
    impute.FCMInterpolationIterativeImputer(n_clusters=2, max_iter=4, random_state=1), impute.FCMInterpolationIterativeImputer(n_clusters=2, max_iter=4, sigma=True, random_state=1), impute.FCMDTIterativeImputer(min_samples_leaf=1, max_iter=2, max_FCM_iter=5, max_clusters=3, random_state=1),
]


@pytest.mark.parametrize("k", range(len(ALL)))
def test_imputers_fill_only_what_is_missing(spark, k):
    df = R.ingest(spark, NUMBERS)
    with pytest.raises(NotFittedError):
        ALL[k].transform(df)
    model = ALL[k].fit(df)
    got = model.transform(df).orderBy("id").toPandas()
    assert list(got.columns) == df.columns and len(got) == len(NUMBERS) and not got.isna().any().any()
    known = NUMBERS.notna()
    assert np.allclose(got[NUMBERS.columns].to_numpy()[known], NUMBERS.to_numpy()[known])
    assert np.allclose(got, ALL[k].fit(df).transform(df).orderBy("id").toPandas())
    if k != 2:
        assert got["num2"][4] > 5 > got["num2"][7]
    with pytest.raises(ValueError, match="columns"):
        model.transform(df.select("id", "num2", "num1", "num3"))


def test_tree_query_refines_like_brute_force(spark, monkeypatch):
    from hazeframe.operators import local
    from hazeframe.plans import catalog

    make, made, seen = impute.FCMDTIterativeImputer, [], []
    monkeypatch.setattr(impute, "FCMDTIterativeImputer", lambda **p: made.append(p) or make(**{**p, "max_iter": 2, "max_FCM_iter": 5, "max_clusters": 3}))
    fill = impute.FCMDTIterativeModel.first_fill
    monkeypatch.setattr(impute.FCMDTIterativeModel, "first_fill", lambda model, df: seen.append((model, fill(model, df))) or seen[-1][1])
    got = {r.id: r for r in catalog.tree_impute(spark, "/root/testdata/sf0.001").collect()}
    assert made[0].get("refine", True) and not {"max_iter", "max_FCM_iter", "max_clusters"} & set(made[0])
    model, first = seen[0]
    state = first.orderBy("__id").toPandas()
    train = model.train.toPandas()[model.columns].to_numpy(float)
    options = {k: model.get(k) for k in ("m", "max_FCM_iter", "tol", "alpha", "max_clusters", "random_state", "learning_rate")}
    x = state[["x0", "x1", "x2"]].to_numpy(float)
    start = x.copy()
    leaves = []
    for j, tree in enumerate(model.trees):
        features = [DenseVector(np.delete(row, j)) for row in train]
        leaves.append(np.array([tree.predictLeaf(f) for f in features]))
    for _ in range(2):
        for j in range(3):
            for leaf in state[f"l{j}"].dropna().unique():
                held = (state[f"l{j}"] == leaf).to_numpy()
                rows = train[leaves[j] == leaf]
                rows = np.concatenate([rows[np.lexsort(rows.T[::-1])], x[held]])
                x[held, j] = local.corrected(rows, np.arange(len(rows)) >= len(rows) - held.sum(), j, **options)
    assert np.abs(x - start).max() > 1
    want = dict(zip(state["__id"], x, strict=True))
    assert all(np.allclose([got[k].qty, got[k].price, got[k].disc], v, atol=2e-3) for k, v in want.items())


def test_nan_distance_rounds_like_its_sql(spark, tmp_path):
    from hazeframe.plans import catalog

    lines = [(14 + 77 * k, 1.0, 1.0, v, "N") for k, v in enumerate([0.10875, 0.01375, 0.1, 0.07])]  # 0.10875 - 0.08 is 0.028749999999999998
    spark.createDataFrame(lines, "l_orderkey long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES["nan_distance"]).fetchall()
    assert sorted(map(tuple, catalog.nan_distance(spark, str(tmp_path)).collect())) == sorted(want)


def test_trees_grow_until_leaves_are_small(spark):
    rows = [(3 * k + i, float(k), 3.0**k) for k in range(20) for i in range(3)]
    model = impute.FCMDTIterativeImputer(min_samples_leaf=3, random_state=1).fit(spark.createDataFrame(rows, "id long, a double, b double"))
    assert model.trees[1].depth > 12
    assert len({model.trees[1].predictLeaf(DenseVector([float(k)])) for k in range(20)}) == 20


def test_rows_without_values(spark):
    df = R.ingest(spark, pd.concat([NUMBERS, pd.DataFrame({c: [None] for c in NUMBERS}, dtype=float)]))
    centroid = impute.FCMCentroidImputer(n_clusters=2).fit(df)
    last = centroid.transform(df).orderBy("id").collect()[-1]
    assert list(last)[1:] == centroid.fitted("centers")[0]
    parameter = impute.FCMParameterImputer(n_clusters=2).fit(df)
    assert np.allclose(list(parameter.transform(df).orderBy("id").collect()[-1])[1:], np.mean(parameter.fitted("centers"), axis=0))


def test_rough_constant_fill(spark):
    df = R.ingest(spark, NUMBERS)
    model = impute.FCMRoughParameterImputer(n_clusters=2).fit(df)
    first = model.fitted("clusters")[0]
    assert model.transform(df).orderBy("id").collect()[4].num2 == pytest.approx((first["upper"] or first["lower"] or first["center"])[1])


def test_fit_errors(spark):
    df = R.ingest(spark, NUMBERS)
    with pytest.raises(ValueError, match="n_clusters"):
        impute.FCMCentroidImputer(n_clusters=6).fit(df)
    with pytest.raises(ValueError, match="two columns"):
        impute.FCMDTIterativeImputer().fit(df.select("id", "num3"))
    with pytest.raises(TypeError):
        impute.FCMCentroidImputer(feature_cols=["s"]).fit(df.withColumn("s", F.lit("a")))
    with pytest.raises(TypeError, match="unknown"):
        impute.FCMCentroidImputer(clusters=3)


def test_pipeline_and_persistence(spark, tmp_path):
    df = R.ingest(spark, NUMBERS)
    pipeline = Pipeline(stages=[impute.FCMCentroidImputer(n_clusters=2, random_state=3), impute.FCMParameterImputer(n_clusters=2)])
    model = pipeline.fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert model.transform(df).orderBy("id").collect() == again.transform(df).orderBy("id").collect()


@pytest.mark.parametrize("k", [3, 6])
def test_models_with_data_persist(spark, tmp_path, k):
    df = R.ingest(spark, NUMBERS)
    model = ALL[k].fit(df)
    model.save(str(tmp_path / "m"))
    again = type(model).load(str(tmp_path / "m"))
    assert model.transform(df).orderBy("id").collect() == again.transform(df).orderBy("id").collect()


def test_stream(spark, tmp_path):
    df = R.ingest(spark, NUMBERS)
    df.write.parquet(str(tmp_path / "in"))
    model = impute.FCMParameterImputer(n_clusters=2).fit(df)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = impute_stream(model, stream).writeStream.format("memory").queryName("imputed").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("imputed").orderBy("id").collect() == model.transform(df).orderBy("id").collect()
    with pytest.raises(TypeError):
        impute_stream(ALL[3].fit(df), stream)


@pytest.mark.parametrize("values", [[None, 1.0, None, 3.0, None], [1.0], [None, None, 2.0], [5.0, None, None, None, 1.0]])
def test_interpolation(spark, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, v double").repartition(3)
    want = pd.Series(values, dtype=float).interpolate(limit_direction="both").tolist()
    assert [r.v for r in impute.interpolate(df, ["v"], "id").orderBy("id").collect()] == pytest.approx(want)


def test_rough_clusters_of_clear_groups(spark):
    x = np.array([[0.0, 0], [0, 1], [1, 0], [10, 10], [10, 11], [11, 10], [5, 5.3]])
    found = rough.rough_clusters(R.ingest(spark, x), ["c0", "c1"], np.array([[0.3, 0.3], [10.3, 10.3]]), 2.0, 0.6, 0.4, 3.0, 20, 1e-6)
    assert np.allclose(found[0]["lower"], [1 / 3, 1 / 3]) and len(found) == 2


# --- nearest neighbours, regressions, silhouette


def test_best_k():
    assert chained.best_k(np.array([5.0, 3.0, 100.0]), 4.0, 3) == 2
    assert chained.best_k(np.array([np.nan, np.nan, 4.0]), 4.0, 3) == 3
    assert chained.best_k(np.array([4.0, 4.0]), 4.0, 2) == 1


def test_chained_regression_recovers_a_line():
    x = np.arange(30.0)
    data = np.stack([x, 2 * x + 1, 5 - x], axis=1)
    holes = data.copy()
    holes[3, 1] = holes[8, 2] = holes[20, 0] = np.nan
    assert np.allclose(chained.chained_impute(holes, 80, (-100, 100)), data, atol=0.05)
    assert chained.chained_impute(holes, 80, (0, 10)).max() <= data.max()


def test_silhouette_and_leaf_correction():
    x = np.array([[0.0, 0], [0.1, 0], [5, 5], [5.1, 5]])
    u = np.array([[0.9, 0.1], [0.9, 0.1], [0.1, 0.9], [0.1, 0.9]])
    assert local.fuzzy_silhouette(x, u, 1.0) > 0.9 and local.fuzzy_silhouette(x, np.ones((4, 1)), 1.0) == 0
    own = np.array([True, False, False, False])
    moved = local.corrected(np.array([[3.0, 0], [0.1, 0], [0.2, 0], [0.0, 0]]), own, 0, m=2.0, max_FCM_iter=30, tol=1e-6, alpha=1.0, max_clusters=1, random_state=0, learning_rate=0.5)
    assert moved[0] == pytest.approx(3 + 0.5 * (0.825 - 3))


# --- selectors


def dense_granule(x, deviation, radius):
    s = np.clip(1 - np.abs(x[:, None] - x[None]) / (1 + deviation), 0, 1)
    return np.where(np.abs(x[:, None] - x[None]) <= (1 + deviation) * min(1, radius), s, 0)


def test_granule_sizes_equal_the_dense_matrix(spark):
    rng = np.random.default_rng(4)
    x, z, label = rng.integers(0, 12, 60) / 3.0, rng.normal(size=60), rng.integers(0, 3, 60).astype(str)
    df = R.ingest(spark, pd.DataFrame({"x": x, "z": z, "label": label}))
    features = granules.describe(df, ["x", "z", "label"], 0.5)
    g = dense_granule(x, x.std(), x.std() / 0.5)
    rows = {(r.x, r.label): r for r in granules.single_sizes(df, features[0], "label").collect()}
    for i in range(60):
        r = rows[x[i], label[i]]
        same = label == label[i]
        own = x[same].std()
        near = np.abs(x[same] - x[i]) <= (1 + own) * min(1, x.std() / 0.5)
        assert (r.size, r.same, r.local) == (pytest.approx(g[i].sum()), pytest.approx(g[i][same].sum()), pytest.approx(np.where(near, np.maximum(0, 1 - np.abs(x[same] - x[i]) / (1 + own)), 0).sum()))
    both = np.minimum(g, dense_granule(z, z.std(), z.std() / 0.5))
    got = {r.i: r.size for r in granules.set_sizes(df, features[:2], "id").collect()}
    assert all(got[i] == pytest.approx(both[i].sum()) for i in range(60))
    t = label[:, None] == label[None]
    whole, within = granules.scores(df, features[0], "label", 60)
    assert whole == pytest.approx(np.mean(1 - np.abs(g - t).sum(axis=1) / 60)) and 0 <= within <= 2


def test_granularity_selector(spark):
    rng = np.random.default_rng(5)
    label = np.repeat(["a", "b"], 30)
    frame = pd.DataFrame({"noise": rng.normal(size=60), "signal": np.where(label == "a", 0.0, 10.0) + rng.normal(size=60) * 0.1, "kind": rng.choice(["u", "v"], 60), "label": label})
    df = R.ingest(spark, frame)
    model = select.FuzzyGranularitySelector(label_col="label", n_features=2, max_features=3).fit(df)
    assert len(model.fitted("ranking")) == 3 and "signal" in model.selected
    assert model.transform(df).columns == ["id", "label", *model.selected]
    assert model.fitted("ranking") == select.FuzzyGranularitySelector(label_col="label", max_features=3).fit(df).fitted("ranking")
    with pytest.raises(ValueError):
        select.FuzzyGranularitySelector(n_features=5, max_features=3)
    with pytest.raises(ValueError, match="missing"):
        select.FuzzyGranularitySelector(label_col="label").fit(df.withColumn("noise", F.lit(None).cast("double")))
    assert select.FuzzyGranularitySelector(n_features=1, max_features=1).fit(df.drop("label")).selected


def test_relevance_equals_the_dense_form(spark):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"a": rng.normal(size=20), "b": rng.choice(["u", "v", None], 20), "label": rng.choice(["x", "y", "z"], 20)})
    frame.loc[3, "a"] = None
    df = R.ingest(spark, frame)
    region = df.filter("id % 3 = 0").select("id")
    pairs = hec.to_region(df, region, ["a", "b"], "id", "label")
    got = hec.relevance(pairs, {"ab": F.col("q0") + F.col("q1")}, 0.5)["ab"]
    h = list(range(0, 20, 3))
    total = 0.0
    for i in range(20):
        r = []
        for j in h:
            x = frame.a[i] - frame.a[j]
            q = 1.0 if math.isnan(x) else x * x
            q += 0.0 if frame.b[i] is not None and frame.b[i] == frame.b[j] else 1.0
            r.append(math.exp(-q / 0.5))
        r = np.array(r)
        low, up = [], []
        for c in ["x", "y", "z"]:
            d = np.array([float(frame.label[j] == c) for j in h])
            low.append(np.min(np.maximum(1 - r, d)))
            up.append(np.max(np.minimum(r, d)))
        total += max(low) + max(up)
    assert got == pytest.approx(total / 20)


def test_weighted_selector(spark):
    rng = np.random.default_rng(7)
    label = np.repeat(["a", "b"], 15)
    df = R.ingest(spark, pd.DataFrame({"noise": rng.normal(size=30) / 5, "signal": np.where(label == "a", 0.0, 3.0) + rng.normal(size=30) * 0.1, "kind": rng.choice(["u", "v"], 30), "label": label}))
    for mode in ("reference", "weighted"):
        model = select.WeightedFuzzyRoughSelector(n_features=2, k=3, weight_mode=mode).fit(df)
        assert sorted(model.fitted("ranking")) == ["kind", "noise", "signal"] and model.fitted("ranking")[0] == "signal"
        assert model.transform(df).columns == ["id", "label", *model.selected]
        found = select.importances(model).collect()
        assert [r.importance for r in found] == sorted((r.importance for r in found), reverse=True)
    with pytest.raises(ValueError, match="n_features"):
        select.WeightedFuzzyRoughSelector(n_features=9).fit(df)
    with pytest.raises(ValueError, match="high density"):
        select.WeightedFuzzyRoughSelector(n_features=1).fit(df.withColumn("label", F.col("id").cast("string")))


def test_feature_weights():
    assert select.feature_weights([1.0, 3.0, 2.0], {(0, 1): 0.0, (0, 2): 2.0, (1, 2): 1.0}) == pytest.approx([0 - 0.5, 1 - 0.25, 0.5 - 0.75])
    assert select.feature_weights([2.0], {}) == [0.0]


def test_ids_must_be_unique(spark):
    rows = [(k % 9, float(k), None if k % 4 == 0 else float(k * k)) for k in range(10)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    for model in (impute.FCMKIterativeImputer(n_clusters=2, max_FCM_iter=2), impute.FCMDTIterativeImputer(min_samples_leaf=2)):
        with pytest.raises(ValueError, match="unique"):
            model.fit(df).transform(df)


@pytest.mark.parametrize(
    "new, old, mask, want",
    [([1.0, 2.0], [0.0, 4.0], [True, True], 1.5), ([1.0, 2.0], [0.0, 4.0], [True, False], 1.0), ([1.0, 2.0], [0.0, 4.0], [False, False], 0.0), ([None, 2.0], [0.0, 4.0], [True, True], 2.0), ([1.0, 1.0], [1.0, 1.0], [True, True], 0.0)],
)
def test_mean_masked_change(spark, new, old, mask, want):
    df = spark.createDataFrame([tuple(new + old + mask)], "a double, b double, c double, d double, m boolean, n boolean")
    assert df.agg(D.mean_masked_change(["a", "b"], ["c", "d"], ["m", "n"])).first()[0] == want


def test_granules_of_no_feature_and_without_reach(spark):
    df = spark.createDataFrame([(k, 1.0, "x") for k in range(3)], "id long, v double, c string")
    assert [r["size"] for r in granules.set_sizes(df, [], "id").collect()] == [0.0] * 3
    assert [r["size"] for r in granules.set_sizes(df, granules.describe(df, ["v"], 0.5), "id").collect()] == [3.0] * 3


def test_quadratic_form_equals_numpy(spark):
    w = [[1.0, 0.5], [0.5, 2.0]]
    df = spark.createDataFrame([(0, 1.0, 2.0, "a"), (1, 4.0, None, "a"), (2, 0.0, 0.0, "a")], "id long, u double, v double, y string")
    got = {(r.a_id, r.b_id): r.d for r in hec.hybrid_distances(df, ["u", "v"], "id", "y", w).collect()}
    x = {0: (1.0, 2.0), 1: (4.0, None), 2: (0.0, 0.0)}
    for (a, b), d in got.items():
        gap = np.array([1.0 if p is None or q is None else abs(p - q) for p, q in zip(x[a], x[b], strict=True)])
        assert d == pytest.approx(np.sqrt(gap @ np.array(w) @ gap))
    assert len(got) == 6


def test_blocks_meet_all_pairs(spark, monkeypatch):
    from hazeframe.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", 2)
    df = spark.createDataFrame([(k, float(k % 5), "ab"[k % 2]) for k in range(11)], "id long, u double, y string")
    pairs = hec.hybrid_distances(df, ["u"], "id", "y").collect()
    assert sorted((r.a_id, r.b_id) for r in pairs) == [(a, b) for a in range(11) for b in range(11) if a != b and a % 2 == b % 2]


@pytest.mark.parametrize("parts", [1, 7])
def test_interpolation_is_by_order_then_id(spark, parts):
    rows = [(k, float(k // 2), None if k % 3 else float(k)) for k in range(40)] + [(40, 99.0, None)]
    df = spark.createDataFrame(rows, "id long, t double, v double").repartition(parts)
    got = [r.v for r in impute.interpolate(df, ["v"], "t", "id").orderBy("id").collect()]
    want = pd.Series([r[2] for r in rows]).interpolate(limit_direction="both")
    assert np.allclose(got, want)
    both = impute.interpolate(df, ["t", "v"], "t", "id")
    assert both.columns == ["id", "t", "v"] and both.count() == 41


def test_samples_are_by_arithmetic_or_hash(spark):
    df = spark.range(100)
    assert {r.id for r in R.stable_sample(df, "id", 10, 3).collect()} == {r.id for r in R.stable_sample(df.repartition(5), "id", 10, 3).collect()}
    assert R.stable_sample(df.select(F.col("id").cast("string").alias("id")), "id", 10, 3).count() == 10


@pytest.mark.parametrize("rows_a_task", [10_000, 4])
def test_snapshot_fills_each_row_from_the_training_rows(spark, monkeypatch, rows_a_task):
    monkeypatch.setattr(impute, "SNAPSHOT_ROWS", rows_a_task)
    rng = np.random.default_rng(4)
    x = np.cumsum(rng.normal(size=(30, 3)), axis=1)
    holes = x.copy()
    holes[rng.random(x.shape) < 0.2] = np.nan
    holes[:5] = x[:5]
    df = R.ingest(spark, holes)
    model = impute.FCMKIterativeImputer(n_clusters=1, max_FCM_iter=3, max_II_iter=4, max_k=5, random_state=2, snapshot=True).fit(df)
    got = np.array([list(r)[1:] for r in model.transform(df).orderBy("id").collect()])
    options = {"means": model.fitted("means"), "bounds": model.fitted("bounds"), "max_k": 5, "max_iter": 4, "seed": 2}
    want = np.vstack([chained.impute_rows(holes[k : k + 1], holes, np.array([k]), feedback=False, **options) for k in range(30)])
    assert np.allclose(got, want) and not np.isnan(got).any()
    assert impute.FCMKIterativeModel.DEFAULTS["snapshot"] is False
