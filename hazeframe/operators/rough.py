"""Rough k-means from fuzzy clusters: lower and upper approximations as conditions on distances, their means as aggregates."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeframe.functions import distances as D
from hazeframe.operators.fcm import membership_columns


def approximations(columns: list[str], centers: np.ndarray, tau: float) -> tuple[list[Column], list[Column]]:
    """For each cluster whether a row is in its lower and in its upper approximation: upper within tau of the nearest centre, lower if in one upper only."""
    apart = D.centre_distances([F.col(f"`{c}`").cast("double") for c in columns], centers)
    nearest = F.least(*apart) if len(apart) > 1 else apart[0]
    upper = [(d - nearest) <= F.lit(float(tau)) for d in apart]
    only = D.total([u.cast("int") for u in upper]) == 1
    return [u & only for u in upper], upper


def _means(df: DataFrame, columns: list[str], lower: list[Column], upper: list[Column]) -> list[tuple[Any, Any, Any]]:
    """For each cluster the means of lower, upper and boundary; None for an empty one."""
    flags = {f"l{k}": x for k, x in enumerate(lower)} | {f"p{k}": x for k, x in enumerate(upper)}
    staged = df.select(*(F.col(f"`{c}`").cast("double").alias(f"x{j}") for j, c in enumerate(columns)), *(v.alias(n) for n, v in flags.items()))
    kinds = [(f"l{k}", F.col(f"l{k}")) for k in range(len(lower))] + [(f"p{k}", F.col(f"p{k}")) for k in range(len(lower))] + [(f"b{k}", F.col(f"p{k}") & ~F.col(f"l{k}")) for k in range(len(lower))]
    row = staged.agg(*(F.avg(F.when(flag, F.col(f"x{j}"))).alias(f"{name}_{j}") for name, flag in kinds for j in range(len(columns)))).first()
    get = lambda name: None if row[f"{name}_0"] is None else [row[f"{name}_{j}"] for j in range(len(columns))]
    return [(get(f"l{k}"), get(f"p{k}"), get(f"b{k}")) for k in range(len(lower))]


def rough_clusters(df: DataFrame, columns: list[str], centers: np.ndarray, m: float, wl: float, wb: float, tau: float, max_iter: int, tol: float) -> list[dict[str, Any]]:
    """For each cluster: means of the lower and upper approximations (None if empty) and the refined centre. One aggregate job a round.

    The approximations are those of the centres that were accepted last; when a round moves the centres by less than tol, it is not accepted.
    """
    label = D.arg_max(membership_columns(columns, centers, m))
    lower = upper = [label == k for k in range(len(centers))]
    centers = np.asarray(centers, float)
    found = _means(df, columns, lower, upper)
    for _ in range(max_iter):
        new = centers.copy()
        for k, (low, _, edge) in enumerate(found):
            if low is not None:
                new[k] = np.array(low) if edge is None else wl * np.array(low) + wb * np.array(edge)
        if np.linalg.norm(new - centers) < tol:
            break
        centers = new
        found = _means(df, columns, *approximations(columns, centers, tau))
    return [{"lower": low, "upper": up, "center": centers[k].tolist()} for k, (low, up, _) in enumerate(found)]
