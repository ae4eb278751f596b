"""Ingest, missing values, complete and incomplete rows, the derived order profile, and samples."""

from __future__ import annotations

from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ingest(spark: SparkSession, data: Any, id_col: str = "id") -> DataFrame:
    """A list, array or pandas frame as a DataFrame with a row id; NaN and None become NULL. Columns without names are c0, c1, ..."""
    if isinstance(data, DataFrame):
        return nan_to_null(data)
    if not isinstance(data, pd.DataFrame):
        if isinstance(data, (str, bytes)) or not hasattr(data, "__len__"):
            raise TypeError("the input must be array-like or a DataFrame")
        try:
            array = np.asarray(data) if isinstance(data, np.ndarray) else np.asarray([list(row) if isinstance(row, (list, tuple)) else row for row in data], dtype=None)
        except (ValueError, TypeError) as error:
            raise TypeError("the input must be array-like or a DataFrame") from error
        if array.ndim != 2:
            raise ValueError("the input must be two-dimensional")
        data = pd.DataFrame(array, columns=[f"c{k}" for k in range(array.shape[1])])
        for c in data.columns:
            known = data[c].dropna()
            if array.dtype.kind not in "iufb" and all(isinstance(v, (int, float, np.number)) for v in known):
                data[c] = data[c].astype(float)
            elif array.dtype.kind not in "iufb":
                data[c] = data[c].map(lambda v: v if v is None else str(v))
    if not len(data):
        raise ValueError("the input must have at least one sample")
    frame = data.rename(columns=str).reset_index(drop=True)
    if id_col not in frame.columns:
        frame.insert(0, id_col, range(len(frame)))
    return nan_to_null(spark.createDataFrame(frame))


def nan_to_null(df: DataFrame) -> DataFrame:
    floating = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) for c in floating}) if floating else df


def any_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in columns])


def split_complete_incomplete(df: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows without and rows with a NULL among the columns; together they are df."""
    missing = any_null(columns or df.columns)
    return df.filter(~missing), df.filter(missing)


def missing_count(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("int") for c in columns])


#: A prime below 2**31: products of two numbers below it stay below 2**63.
MODULUS = 2**31 - 1


def sample_rank(id_col: str, seed: int | None = None) -> Column:
    """A number below MODULUS that scatters whole-number ids by plain arithmetic; ids of other types go through a hash first."""
    return F.pmod(F.pmod(F.pmod(F.col(f"`{id_col}`").cast("long"), F.lit(MODULUS)) + (seed or 0) % MODULUS, F.lit(MODULUS)) * pow(48271, 5, MODULUS) + 69621, F.lit(MODULUS))


def stable_sample(df: DataFrame, id_col: str, n: int = 10_000, seed: int | None = None) -> DataFrame:
    """min(rows, n) rows without replacement, the same on every run and partitioning."""
    whole = isinstance(df.schema[id_col].dataType, T.IntegralType)
    rank = sample_rank(id_col, seed) if whole else F.xxhash64(F.col(f"`{id_col}`"), F.lit(seed or 0))
    return df.orderBy(rank, f"`{id_col}`").limit(n)


def order_profile(spark: SparkSession, sf_dir: str, nulls: bool = True) -> DataFrame:
    """lineitem by order: id, qty, price, disc, flag. nulls: qty is NULL where id % 7 = 0 and price where id % 11 = 3."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = lines.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"), F.avg("l_discount").alias("disc"), F.max("l_returnflag").alias("flag")
    )
    return orders.withColumns({"qty": null_every("qty", 7, 0), "price": null_every("price", 11, 3)}) if nulls else orders


def null_every(column: str, divisor: int, remainder: int, id_col: str = "id") -> Column:
    return F.when(F.col(id_col) % divisor != remainder, F.col(column))
