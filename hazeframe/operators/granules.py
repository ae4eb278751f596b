"""Fuzzy granules by sums over ranges.

The similarity of two numbers is 1 - |x - y| / (1 + sd), kept where it reaches 1 - radius. A row's granule size, the sum of its
similarities, then needs only counts and sums over a range, which are differences of running sums, so no matrix of pairs exists.
Rows are first counted by distinct value (and label).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeframe.functions.validation import is_numeric
from hazeframe.operators import near
from hazeframe.operators.blocks import meet, range_sums


@dataclass(frozen=True)
class Feature:
    """A column and, if numeric, its population deviation and radius (deviation / eps)."""

    name: str
    numeric: bool
    deviation: float = 0.0
    radius: float = 0.0

    @property
    def scale(self) -> float:
        return 1.0 + self.deviation

    @property
    def reach(self) -> float:
        """The largest difference that counts."""
        return self.scale * min(1.0, self.radius)


def describe(df: DataFrame, columns: list[str], eps: float) -> list[Feature]:
    numeric = [c for c in columns if is_numeric(df.schema[c].dataType)]
    row = df.agg(*(F.stddev_pop(F.col(f"`{c}`").cast("double")).alias(c) for c in numeric), F.lit(1)).first()
    return [Feature(c, True, float(row[c] or 0.0), float(row[c] or 0.0) / eps) if c in numeric else Feature(c, False) for c in columns]


def similarity(a: Column, b: Column, feature: Feature) -> Column:
    if not feature.numeric:
        return (a == b).cast("double")
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(a - b) / F.lit(feature.scale)))
    return F.when(F.abs(a - b) <= F.lit(feature.reach), value).otherwise(0.0)


def _frame_sizes(counts: DataFrame, by: list[str], reach: float, scale: float, to: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """counts (x, n, keep, and the columns of by) with the granule size of each x within by."""
    summed = range_sums(counts.withColumn("nx", F.col("n") * F.col("x")), by, reach, ["n", "nx"], keep)
    near = F.col("n_left") + F.col("n_right") - F.col("n")
    apart = (F.col("x") * F.col("n_left") - F.col("nx_left")) + (F.col("nx_right") - F.col("x") * F.col("n_right"))
    return summed.select(*by, "x", "n", *keep, (near - apart / F.lit(scale)).alias(to))


def single_sizes(df: DataFrame, feature: Feature, label: str) -> DataFrame:
    """By distinct value and label: x, label, n; size (over all rows), same (over rows of the label), local (of the label, with the label's own deviation)."""
    counts = df.groupBy(F.col(f"`{feature.name}`").cast("double" if feature.numeric else "string").alias("x"), F.col(f"`{label}`").cast("string").alias("label")).agg(F.count("*").cast("double").alias("n"))
    if not feature.numeric:
        return counts.join(counts.groupBy("x").agg(F.sum("n").alias("size")), "x").withColumns({"same": F.col("n"), "local": F.col("n")}).select("x", "label", "n", "size", "same", "local")
    whole = _frame_sizes(counts.groupBy("x").agg(F.sum("n").alias("n")), [], feature.reach, feature.scale, "size").drop("n")
    same = _frame_sizes(counts, ["label"], feature.reach, feature.scale, "same")
    deviation = counts.groupBy("label").agg((1 + F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("n") * F.col("x") * F.col("x")) / F.sum("n") - F.pow(F.sum(F.col("n") * F.col("x")) / F.sum("n"), F.lit(2.0))))).alias("s"))
    scaled = counts.join(deviation, "label").select("label", F.col("x").alias("value"), (F.col("x") / F.col("s")).alias("x"), "n")
    local = _frame_sizes(scaled, ["label"], min(1.0, feature.radius), 1.0, "local", ("value",)).select("label", F.col("value").alias("x"), "local")
    return same.join(whole, "x").join(local, ["x", "label"])


def set_sizes(df: DataFrame, features: list[Feature], id_col: str, nominal: str | None = None) -> DataFrame:
    """id and size of each row's granule under all features at once (the least similarity counts); nominal: a further column compared by equality. Without any feature all sizes are 0.

    Distinct points, with their counts, meet in parts, where boxes of points add what needs no pairs (near.tent_sums). Nominal
    features, and numeric ones without reach, tell apart what is not equal, so only parts of equal ones meet.
    """
    if not features and not nominal:
        return df.select(F.col(id_col).alias("i"), F.lit(0.0).alias("size"))
    base = df.select(F.col(id_col).alias("i"), *(F.col(f"`{f.name}`").cast("double" if f.numeric else "string").alias(f"x{k}") for k, f in enumerate(features)), *([F.col(f"`{nominal}`").cast("string").alias("c")] if nominal else []))
    columns = base.columns[1:]
    ranges = {f"x{k}": f for k, f in enumerate(features) if f.numeric and f.reach > 0}
    exact = [c for c in columns if c not in ranges]
    base = base.dropna(subset=[*exact, *list(ranges)[:1]])
    counts = base.dropna(subset=columns).groupBy(*columns).agg(F.count("*").cast("double").alias("n"))
    if not ranges:
        return base.join(counts, columns).select("i", F.col("n").alias("size"))
    if len(ranges) == 1:
        x, feature = next(iter(ranges.items()))
        sizes = _frame_sizes(counts.withColumnRenamed(x, "x"), exact, feature.reach, feature.scale, "size").withColumnRenamed("x", x)
    else:
        scales, reaches = (np.array([*(getattr(f, name) for f in ranges.values()), *[at] * len(exact)]) for name, at in (("scale", 1.0), ("reach", 0.0)))

        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            codes = [pd.factorize(pd.concat([a[c], b[c]]))[0].astype(float) for c in exact]
            x, y = (np.column_stack([*(df[c].to_numpy(float) for c in ranges), *(code[own] for code in codes)]) for df, own in ((a, slice(None, len(a))), (b, slice(len(a), None))))
            return a[columns].assign(size=near.tent_sums(x, y, b["n"].to_numpy(float), scales, reaches))

        digest = counts.withColumn("key", F.xxhash64(*columns))
        n = counts.count()
        sizes = meet(digest, digest, exact, ("key", "key"), (n, n), run, ", ".join(f"{c} {t}" for c, t in base.dtypes[1:]) + ", size double").groupBy(*columns).agg(F.sum("size").alias("size"))
    return base.join(sizes.select(*columns, "size"), columns, "left").select("i", F.coalesce("size", F.lit(0.0)).alias("size"))


def row_granule(df: DataFrame, features: list[Feature], id_col: str, row_id: object) -> DataFrame:
    """i, similarity: of every row that is in the granule of one row, under all features at once."""
    own = df.filter(F.col(id_col) == F.lit(row_id)).first()
    least = [similarity(F.col(f"`{f.name}`"), F.lit(own[f.name]), f) for f in features]
    return df.select(F.col(id_col).alias("i"), (F.least(*least) if len(least) > 1 else least[0]).alias("similarity")).filter("similarity > 0")


def scores(df: DataFrame, feature: Feature, label: str, n: int) -> tuple[float, float]:
    """Global and local granularity consistency of one feature."""
    sizes = single_sizes(df, feature, label)
    sizes = sizes.join(df.groupBy(F.col(f"`{label}`").cast("string").alias("label")).agg(F.count("*").cast("double").alias("of_label")), "label")
    ratio = F.when(F.col("size") == 0, 1.0).otherwise(F.col("local") / F.col("size"))
    by_label = sizes.groupBy("label").agg(F.sum(F.col("n") * (1 - (F.col("of_label") - 2 * F.col("same") + F.col("size")) / F.lit(float(n)))).alias("whole"), (F.sum(F.col("n") * ratio) / F.sum("n")).alias("local"))
    row = by_label.agg((F.sum("whole") / n).alias("whole"), F.avg("local").alias("local")).first()
    return float(row["whole"]), float(row["local"])


def entropy(kind: str, b: Column, t: Column, n: float) -> Column:
    """Aggregate of granule sizes b and t (0 if there is no t) over all rows: basic, conditional, joint or mutual implication entropy."""
    n_ = F.lit(float(n))
    if kind == "basic":
        return F.sum(1 - b / n_) / n_
    if kind == "conditional":
        return F.sum(F.greatest(b, t) - b) / (n_ * n_)
    if kind == "joint":
        return F.sum(1 + F.greatest(b, t) / n_ - (b + t) / n_) / n_
    return F.sum(1 - F.greatest(b, t) / n_) / n_
