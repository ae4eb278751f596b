"""Checks of parameters and of input tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class NotFittedError(ValueError, AttributeError):
    """A facade was used before it was fitted."""


_NUMBER = (int, float)
#: Parameter: accepted types, how they are named, the condition, how it is named.
RULES: dict[str, tuple[tuple[type, ...], str, Callable[[Any], bool], str]] = {
    **dict.fromkeys(("max_clusters", "max_k", "n_features", "max_features", "n_clusters"), ((int,), "int", lambda v: v >= 1, ">= 1")),
    **dict.fromkeys(("max_iter", "max_iter_rough_k", "max_FCM_iter", "max_II_iter", "k"), ((int,), "int", lambda v: v > 1, "> 1")),
    "random_state": ((int, type(None)), "int or None", lambda v: True, ""),
    "m": (_NUMBER, "int or float", lambda v: v > 1.0, "> 1.0"),
    **dict.fromkeys(("tol", "min_samples_leaf", "learning_rate", "eps", "alpha"), (_NUMBER, "int or float", lambda v: v > 0, "> 0")),
    "wl": (_NUMBER, "int or float", lambda v: 0 < v <= 1, "in (0, 1]"),
    "wb": (_NUMBER, "int or float", lambda v: 0 <= v <= 1, "in [0, 1]"),
    **dict.fromkeys(("tau", "stop_threshold"), (_NUMBER, "int or float", lambda v: v >= 0, ">= 0")),
    "n_jobs": ((int,), "int", lambda v: v != 0, "!= 0"),
    **dict.fromkeys(("sigma", "snapshot"), ((bool,), "bool", lambda v: True, "")),
}


def validate_params(params: Mapping[str, Any]) -> None:
    """TypeError or ValueError for the first known parameter that breaks its rule; unknown ones are ignored."""
    for name, value in params.items():
        if name not in RULES:
            continue
        kinds, called, holds, condition = RULES[name]
        if not isinstance(value, kinds):
            raise TypeError(f"{name} must be {called}, got {type(value).__name__} instead")
        if not holds(value):
            raise ValueError(f"{name} must be {condition}, got {value} instead")


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def numeric_columns(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if is_numeric(df.schema[c].dataType)]


def profile(df: DataFrame, columns: list[str]) -> dict[str, Any]:
    """Rows, complete rows and non-null cells by column, in one job."""
    complete = F.lit(True)
    for c in columns:
        complete &= F.col(f"`{c}`").isNotNull()
    row = df.agg(F.count("*").alias("rows"), F.count(F.when(complete, 1)).alias("complete"), *(F.count(f"`{c}`").alias(f"n{k}") for k, c in enumerate(columns))).first()
    return {"rows": row["rows"], "complete": row["complete"], "present": {c: row[f"n{k}"] for k, c in enumerate(columns)}}


def check_input(df: Any, columns: list[str], *, require_numeric: bool = False, allow_nan: bool = True, require_complete_rows: bool = False, no_nan_columns: bool = False) -> dict[str, Any]:
    """The table's profile, or the first error. Types are read from the schema; counts take one job."""
    if not isinstance(df, DataFrame):
        raise TypeError(f"expected a DataFrame, got {type(df).__name__}; see hazeframe.sources.rows.ingest")
    missing = [c for c in columns if c not in df.columns]
    if missing or not columns:
        raise ValueError(f"columns are missing: {missing}" if missing else "there must be at least one feature column")
    nested = [c for c in columns if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))]
    if nested:
        raise TypeError(f"nested columns are not supported: {nested}")
    if require_numeric and (other := [c for c in columns if not is_numeric(df.schema[c].dataType)]):
        raise TypeError(f"all columns must be numeric; these are not: {other}")
    found = profile(df, columns)
    if not found["rows"]:
        raise ValueError("the input must have at least one sample")
    if not allow_nan and found["complete"] < found["rows"]:
        raise ValueError("the input must not contain missing values")
    if require_complete_rows and not found["complete"]:
        raise ValueError("the input must have at least one row with no missing values")
    if no_nan_columns and (empty := [c for c, n in found["present"].items() if not n]):
        raise ValueError(f"{len(empty)} columns have only missing values")
    return found


def check_unique(df: DataFrame, id_col: str) -> None:
    """A ValueError if an id is NULL or repeats: results are joined back by id, and such rows would multiply or be lost."""
    bad = df.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.count("*").alias("n")).filter("n > 1 OR id IS NULL").first()
    if bad is not None:
        raise ValueError(f"{id_col} must be unique and not NULL, got {bad['id']!r} in {bad['n']} rows")
