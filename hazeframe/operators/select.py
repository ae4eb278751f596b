"""Supervised feature selectors by fuzzy granularity and by weighted fuzzy-rough sets."""

from __future__ import annotations

import logging
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeframe.functions.validation import check_input
from hazeframe.operators import granules as G
from hazeframe.operators import hec
from hazeframe.operators.base import FuzzyEstimator, FuzzyModel, with_params

log = logging.getLogger(__name__)


@with_params(state="{}", label_col=None)
class SelectorModel(FuzzyModel):
    """Keeps the id, the label if it is there, and the first n_features of the ranking."""

    @property
    def selected(self) -> list[str]:
        return self.fitted("ranking")[: self.fitted("n_features")]

    def _transform(self, df: DataFrame) -> DataFrame:
        self.check_columns(df)
        kept = [c for c in (self.get("id_col"), self.get("label_col")) if c and c in df.columns]
        return df.select(*dict.fromkeys([*kept, *self.selected]))


@with_params(label_col=None, n_features=3, eps=0.5, max_features=10, random_state=None)
class FuzzyGranularitySelector(FuzzyEstimator):
    """Greedy: granularity consistency, weighted by implication entropy, less the mean redundancy with what is chosen. random_state has no effect."""

    def validate(self, params: dict) -> None:
        super().validate(params)
        if params["n_features"] > params["max_features"]:
            raise ValueError(f"n_features must be <= max_features, got {params['n_features']} and {params['max_features']} instead")

    def _fit(self, df: DataFrame) -> SelectorModel:
        id_col, label = self.get("id_col"), self.get("label_col")
        columns = self.features(df, *([label] if label else []))
        n = check_input(df, columns, allow_nan=False)["rows"]
        if label is None:
            label = "__label"
            df = df.withColumn(label, F.lit("all"))
        elif df.filter(F.col(f"`{label}`").isNull()).limit(1).count():
            raise ValueError("the label must not contain missing values")
        df = df.select(id_col, label, *columns).persist()
        try:
            features = {f.name: f for f in G.describe(df, columns, self.get("eps"))}
            score = {c: sum(G.scores(df, features[c], label, n)) for c in columns}
            sizes = self._sizes(df, features, label, id_col).persist()
            mutual = self._mutual(sizes, columns, n)
            chosen = [max(columns, key=score.__getitem__)]
            while len(chosen) < min(len(columns), self.get("max_features")):
                left = [c for c in columns if c not in chosen]
                if len(left) == 1:  # whatever its value
                    chosen += left
                    break
                given = self._conditional(df, sizes, [features[c] for c in chosen], columns, id_col, n)
                weight = 1 + given / (given + 0.01)  # more features never enlarge a granule, so the other entropy is 0
                value = {c: weight * score[c] - sum(mutual["label", c] + mutual[c, s] - mutual[c, "label", s] for s in chosen) / len(chosen) for c in left}
                chosen.append(max(left, key=value.__getitem__))
                log.info("chosen so far: %s", chosen)
            sizes.unpersist()
        finally:
            df.unpersist()
        return self.to_model(SelectorModel, columns=columns, ranking=chosen, scores=score, n_features=self.get("n_features"))

    @staticmethod
    def _sizes(df: DataFrame, features: dict[str, G.Feature], label: str, id_col: str) -> DataFrame:
        """id, of_label and for each feature its granule size a<k> and that within the label s<k>."""
        wide = df.select(F.col(id_col).alias("i"), F.col(f"`{label}`").cast("string").alias("label"), *(F.col(f"`{c}`").cast("double" if f.numeric else "string").alias(f"x{k}") for k, (c, f) in enumerate(features.items())))
        wide = wide.join(wide.groupBy("label").agg(F.count("*").cast("double").alias("of_label")), "label")
        for k, f in enumerate(features.values()):
            own = G.single_sizes(df, f, label).select(F.col("x").alias(f"x{k}"), "label", F.col("size").alias(f"a{k}"), F.col("same").alias(f"s{k}"))
            wide = wide.join(own, [f"x{k}", "label"])
        return wide

    @staticmethod
    def _mutual(sizes: DataFrame, columns: list[str], n: int) -> dict[tuple, float]:
        """All mutual entropies that the search needs, in one job."""
        wanted = {}
        for k, c in enumerate(columns):
            wanted["label", c] = (F.col("of_label"), F.col(f"a{k}"))
            for j, s in enumerate(columns):
                if j != k:
                    wanted[c, s] = (F.col(f"a{k}"), F.col(f"a{j}"))
                    wanted[c, "label", s] = (F.col(f"a{k}"), F.col(f"s{j}"))
        row = sizes.agg(*(G.entropy("mutual", b, t, n) for b, t in wanted.values())).first()
        return dict(zip(wanted, map(float, row), strict=True))

    @staticmethod
    def _conditional(df: DataFrame, sizes: DataFrame, chosen: list[G.Feature], columns: list[str], id_col: str, n: int) -> float:
        if len(chosen) == 1:
            b = sizes.select(F.col(f"a{columns.index(chosen[0].name)}").alias("size"), "of_label")
        else:
            b = G.set_sizes(df, chosen, id_col).join(sizes.select("i", "of_label"), "i")
        return float(b.agg(G.entropy("conditional", F.col("size"), F.col("of_label"), n)).first()[0])


def feature_weights(relevance: list[float], redundancy: dict[tuple[int, int], float]) -> list[float]:
    """Scaled relevance less the mean of scaled redundancies with the other features."""
    d = len(relevance)

    def scaled(values: list[float]) -> list[float]:
        low, span = min(values), max(values) - min(values)
        return [(v - low) / (span or 1.0) for v in values]

    sums = [0.0] * d  # the rows of the symmetric matrix of scaled redundancies
    for (a, b), value in zip(redundancy, scaled(list(redundancy.values())) if redundancy else [], strict=True):
        sums[a] += value
        sums[b] += value
    return [own - total / max(d - 1, 1) for own, total in zip(scaled(relevance), sums, strict=True)]


@with_params(label_col="label", n_features=1, alpha=0.5, k=5, weight_mode="reference")
class WeightedFuzzyRoughSelector(FuzzyEstimator):
    """Ranks features by how much each adds to fuzzy-rough relevance over a region of high density.

    weight_mode: 'weighted' weighs all distances; 'reference' leaves single features, pairs in column order and the whole set in
    column order unweighted, as executed. The ranking evaluates all candidates of a round in one job.
    """

    def validate(self, params: dict) -> None:
        super().validate(params)
        if not params["alpha"] <= 1:
            raise ValueError(f"alpha must be in (0, 1], got {params['alpha']} instead")
        if params["weight_mode"] not in ("reference", "weighted"):
            raise ValueError(f"weight_mode must be 'reference' or 'weighted', got {params['weight_mode']!r} instead")

    def _fit(self, df: DataFrame) -> SelectorModel:
        id_col, label, alpha = self.get("id_col"), self.get("label_col"), self.get("alpha")
        columns = self.features(df, label)
        rows = check_input(df, columns)["rows"]
        d = len(columns)
        if self.get("n_features") > d:
            raise ValueError(f"n_features must be <= the number of features ({d}), got {self.get('n_features')} instead")
        if df.filter(F.col(f"`{label}`").isNull()).limit(1).count():
            raise ValueError("the label must not contain missing values")
        region = hec.high_density(df, columns, id_col, label, min(self.get("k"), rows - 1)).persist()
        if not region.limit(1).count():
            raise ValueError("no region of high density was found: every class has a single row")
        try:
            plain = [[(a, None)] for a in range(d)] + [[(a, None), (b, None)] for a in range(d) for b in range(a + 1, d)]
            found = self._relevance(df, region, columns, plain)
            single = found[:d]
            redundancy = {(a, b): single[a] + single[b] - value for ((a, _), (b, _)), value in zip(plain[d:], found[d:], strict=True)}
            weights = [1 / (1 + math.exp(-w)) ** 2 for w in feature_weights(single, redundancy)]
            chosen: list[int] = []
            while len(chosen) < d:
                left = [a for a in range(d) if a not in chosen]
                if len(left) == 1:  # whatever its value
                    chosen += left
                    break
                value = dict(zip(left, self._relevance(df, region, columns, [self._weighted([*chosen, a], weights) for a in left]), strict=True))
                chosen.append(max(left, key=value.__getitem__))
        finally:
            region.unpersist()
        return self.to_model(SelectorModel, columns=columns, ranking=[columns[a] for a in chosen], weights=[weights[a] for a in chosen], relevance=single, n_features=self.get("n_features"))

    def _relevance(self, df: DataFrame, region: DataFrame, columns: list[str], sets: list) -> list[float]:
        least = hec.least_squares(df, region, columns, self.get("id_col"), self.get("label_col"), sets)
        return list(hec.relevance(least, {f"{k}": F.col(f"s{k}") for k in range(len(sets))}, self.get("alpha")).values())

    def _weighted(self, subset: list[int], weights: list[float]) -> list[tuple[int, float | None]]:
        plain = self.get("weight_mode") == "reference" and (len(subset) == 1 or (len(subset) == 2 or len(subset) == len(weights)) and subset == sorted(subset))
        return [(a, None if plain else weights[a]) for a in subset]


def importances(model: SelectorModel) -> DataFrame:
    """feature, importance: largest first."""
    from pyspark.sql import SparkSession

    rows = sorted(zip(model.fitted("ranking"), model.fitted("weights"), strict=True), key=lambda r: -r[1])
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")
