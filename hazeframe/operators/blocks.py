"""Sums over value ranges and joins in blocks, so that no task holds a whole group."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeframe.sources.storage import cut_lineage


def range_sums(points: DataFrame, by: list[str], reach: float, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """points (by, x: distinct within by; names; keep, numbers that pass through) with, for each name, <name>_left and <name>_right: its sums over x - reach to x and over x to x + reach.

    Each point asks twice, below and above its reach, and a running sum over the sorted points and questions answers: linear, where
    a sliding frame would be summed anew for each row. The order is cut into range partitions; each starts from what stands before it.
    """
    order = [*by, "at", "kind"]
    asked = F.array(F.struct((F.col("x") - reach).alias("at"), F.lit(0).alias("kind")), F.struct(F.col("x").alias("at"), F.lit(1).alias("kind")), F.struct((F.col("x") + reach).alias("at"), F.lit(2).alias("kind")))
    events = points.select(*by, "x", *keep, *names, F.explode(asked).alias("event")).select(*by, "x", *keep, "event.*", *(F.when(F.col("event.kind") == 1, F.col(n)).otherwise(F.lit(0.0)).alias(n) for n in names))
    dealt = cut_lineage(events.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    own = dealt.groupBy("part", *by).agg(*(F.sum(n).alias(n) for n in names))  # a row for each partition and group
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.select("part", *by, *(F.coalesce(F.sum(n).over(before), F.lit(0.0)).alias(f"{n}_start") for n in names))
    running = Window.partitionBy("part", *by).orderBy("at", "kind", "x").rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({f"{n}_sum": F.sum(n).over(running) for n in names}).join(starts, ["part", *by])
    whole = {n: F.col(f"{n}_sum") + F.col(f"{n}_start") for n in names}
    found = summed.groupBy(*by, "x").agg(*(F.max(F.when(F.col("kind") == k, whole[n])).alias(f"{n}{k}") for n in names for k in (0, 1, 2)), *(F.max(F.when(F.col("kind") == 1, F.col(n))).alias(n) for n in (*names, *keep)))
    return found.select(*by, "x", *keep, *names, *(c for n in names for c in ((F.col(f"{n}1") - F.col(f"{n}0")).alias(f"{n}_left"), (F.col(f"{n}2") - F.col(f"{n}1") + F.col(n)).alias(f"{n}_right"))))


#: Rows of the smaller side that meet a row in one task.
BLOCK = 4096


def block_join(a: DataFrame, b: DataFrame, on: Column | None, rows: int, key: str) -> DataFrame:
    """Pairs of a and b (rows: of b, about) under `on`. b is dealt into blocks by its key and a goes to each block, so that one value of `on` doesn't meet in one task."""
    blocks = 1 + rows // BLOCK
    dealt = b.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    spread = a.withColumn("__a", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if blocks > 1:  # a small table is read by one task, which would then form all pairs
        spread = spread.repartition(4 * int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = F.col("__a") == F.col("__b")
    return spread.join(dealt, met if on is None else met & on).drop("__a", "__b")


#: Rows of each side that meet in one task, at most about; fewer of the first, down to LEAST, where there are tasks for them.
PART, LEAST = 1 << 16, 1 << 11


def meet(a: DataFrame, b: DataFrame, by: list[str], keys: tuple[str, str], rows: tuple[int, int], run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, fewest: int | None = None) -> DataFrame:
    """run on parts of a and of b, so that each row of a meets each row of b whose columns `by` are the same (null ones too). keys: columns that deal rows into parts; rows: of the largest groups of `by`, about; fewest: instead of LEAST, where run costs little beside the rows of b that each part of a is sent.

    run sees whole groups of neither side and may see several of them; a row of a has a result from each part of b.
    """
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts_a = max(-(-rows[0] // PART), min(4 * tasks, -(-rows[0] // (fewest or LEAST))), 1)
    parts_b = max(-(-rows[1] // PART), 1)
    group = F.pmod(F.xxhash64(*by), F.lit(4 * tasks)).cast("int") if by else F.lit(0)
    deal = lambda df, key, own, other, n_own, n_other: df.withColumns({"__g": group, own: F.pmod(F.xxhash64(F.col(key)), F.lit(n_own)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))})
    on = ["__g", "__a", "__b"]
    left, right = deal(a, keys[0], "__a", "__b", parts_a, parts_b), deal(b, keys[1], "__b", "__a", parts_b, parts_a)
    dealt = [df.repartition(4 * tasks, *on).groupBy(*on) for df in (left, right)]  # a number that is given, so that tasks, small in bytes but long in work, aren't put together
    return dealt[0].cogroup(dealt[1]).applyInPandas(lambda x, y: run(x.drop(columns=on), y.drop(columns=on)), schema)
