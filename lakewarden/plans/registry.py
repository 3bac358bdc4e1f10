"""Registered queries: a Spark function and, where SQL can state it, an independent oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _rewrite(sql: str, call: str, build) -> str:
    """Replaces every ``call(x, n)`` by ``build(x, n)``; ``call(x)`` stays."""
    out, at = [], 0
    while (start := sql.find(call + "(", at)) >= 0:
        body = start + len(call) + 1
        depth, comma, end = 1, -1, body
        while depth:
            depth += (sql[end] == "(") - (sql[end] == ")")
            if depth == 1 and sql[end] == ",":
                comma = end
            end += 1
        cut = comma if comma >= 0 else end - 1
        inner = _rewrite(sql[body:cut], call, build)
        out += [sql[at:start], build(inner, sql[comma + 1:end - 1].strip()) if comma >= 0 else f"{call}({inner})"]
        at = end
    return "".join([*out, sql[at:]])


def portable(sql: str) -> str:
    """Oracle text with both roundings spelled out.

    ``round(x, n)`` goes up at a printed half, as Spark rounds doubles; ``nearest(x, n)``
    is the decimal nearest to the stored number, as formatted output gives it.
    """
    sql = _rewrite(sql, "round", lambda x, n: f"CAST(round(CAST(CAST(CAST({x} AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 18)), {n}) AS DOUBLE)")
    return _rewrite(sql, "nearest", lambda x, n: f"CAST(format('{{:.{n}f}}', CAST({x} AS DOUBLE)) AS DOUBLE)")


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = portable(sql)
        return fn

    return register
