"""Builders of DuckDB SQL that states the operators independently of the Spark code."""

from __future__ import annotations

from collections.abc import Sequence

PROFILE = """profile AS (SELECT l_orderkey AS id, sum(l_quantity) AS qty, sum(l_extendedprice) AS price, avg(l_discount) AS disc, max(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey),
holes AS (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE qty END AS qty, CASE WHEN id % 11 = 3 THEN NULL ELSE price END AS price, disc, flag FROM profile)"""


def distance(columns: Sequence[str], centre: str, names: Sequence[str]) -> str:
    """Over the coordinates that are there; centre: prefix of the centre's columns."""
    return "sqrt(" + " + ".join(f"coalesce(power({c} - {centre}{n}, 2), 0)" for c, n in zip(columns, names, strict=True)) + ")"


def start(clusters: int, seed: int = 0) -> str:
    """The raw start membership of id in cluster k."""
    p = 2147483647
    powers = [str(pow(48271, k + 3, p)) for k in range(clusters)]
    return f"(((id % {p}) * list_extract(CAST([{', '.join(powers)}] AS BIGINT[]), CAST(k + 1 AS INTEGER)) + (69621 * ({seed} + k + 1)) % {p}) % {p} + 1) / CAST({p} AS DOUBLE)"


def fcm(source: str, columns: Sequence[str], clusters: int, rounds: int, m: float = 2.0, seed: int = 0, name: str = "fcm") -> str:
    """CTEs that end in {name}(k, v0, v1, ...): centres after so many rounds from hashed memberships. source: a relation with id and the columns."""
    d = range(len(columns))
    picked = ", ".join(f"CAST({c} AS DOUBLE) AS x{j}" for j, c in enumerate(columns))
    raw = start(clusters, seed)
    parts = [
        f"{name}_rows AS (SELECT id, {picked} FROM {source})",
        f"{name}_u0 AS (SELECT r.*, k, {raw} / sum({raw}) OVER (PARTITION BY id) AS u FROM {name}_rows r, range({clusters}) AS t(k))",
    ]
    for i in range(1, rounds + 1):
        sums = ", ".join(f"sum(power(u, {m}) * x{j}) / sum(power(u, {m})) AS v{j}" for j in d)
        parts.append(f"{name}_c{i} AS (SELECT k, {sums} FROM {name}_u{i - 1} GROUP BY k)")
        if i < rounds:
            parts.append(f"{name}_u{i} AS ({members(f'{name}_rows', f'{name}_c{i}', [f'x{j}' for j in d], m)})")
    parts.append(f"{name} AS (SELECT * FROM {name}_c{rounds})")
    return ",\n".join(parts)


def members(rows: str, centres: str, columns: Sequence[str], m: float = 2.0) -> str:
    """rows x centres with the distance d and the membership u."""
    apart = f"greatest({distance(columns, 'c.v', range(len(columns)))}, 1e-10)"
    return f"SELECT *, power(d, {-2.0 / (m - 1)}) / sum(power(d, {-2.0 / (m - 1)})) OVER (PARTITION BY id) AS u FROM (SELECT r.*, c.k, {apart} AS d{''.join(f', c.v{j}' for j in range(len(columns)))} FROM {rows} r, {centres} c) AS x"


def similarity(column: str, a: str = "a", b: str = "b") -> str:
    """Of pairs under statistics s (sd, radius)."""
    gap = f"abs({a}.{column} - {b}.{column})"
    return f"CASE WHEN {gap} <= (1 + sd_{column}) * least(1, r_{column}) THEN greatest(0, least(1, 1 - {gap} / (1 + sd_{column}))) ELSE 0 END"
