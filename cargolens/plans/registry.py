"""Registered queries: one column specification serves the Spark plan and its SQL twin.

A specification such as ``"date:d sku:i IQ:f"`` fixes column names and published types:
``d`` date as ISO text, ``t`` timestamp as text to the second, ``s`` text, ``i`` 64-bit
integer, ``f`` double rounded to the six decimals of the result files, ``b`` boolean.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Query:
    spec: str
    plan: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}
VIEWS: dict[str, str] = {}


def register(name: str, spec: str, plan, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} registered twice")
    QUERIES[name] = Query(spec, plan, sql)


def view(name: str, sql: str) -> None:
    """A named SQL step (common table expression) for the comparison queries."""
    if name in VIEWS:
        raise ValueError(f"view {name} defined twice")
    VIEWS[name] = sql


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in spec.split()]


def publish(df: DataFrame, spec: str) -> DataFrame:
    out: list[Column] = []
    for name, kind in _columns(spec):
        c = F.col(name)
        if kind == "f":
            c = F.round(c.cast("double"), 6) + F.lit(0.0)  # turns -0.0 into 0.0
        elif kind == "i":
            c = c.cast("bigint")
        elif kind == "d":
            c = c.cast("date").cast("string")
        elif kind == "t":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "b":
            c = c.cast("boolean")
        else:
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def _published_sql(spec: str) -> str:
    parts = []
    for name, kind in _columns(spec):
        q = f'"{name}"'
        if kind == "f":
            r = f"round(CAST({q} AS DOUBLE), 6)"
            parts.append(f"CASE WHEN {r} = 0 THEN CAST(0 AS DOUBLE) ELSE {r} END AS {q}")
        elif kind == "i":
            parts.append(f"CAST({q} AS BIGINT) AS {q}")
        elif kind == "d":
            parts.append(f"CAST(CAST({q} AS DATE) AS VARCHAR) AS {q}")
        elif kind == "t":
            parts.append(f"strftime({q}, '%Y-%m-%d %H:%M:%S') AS {q}")
        elif kind == "b":
            parts.append(f"CAST({q} AS BOOLEAN) AS {q}")
        else:
            parts.append(f"CAST({q} AS VARCHAR) AS {q}")
    return ", ".join(parts)


def full_sql(query: Query) -> str:
    """Prefix the query with exactly the views it needs, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z][a-z0-9_]*\b", text)):
            if word in VIEWS and word not in needed:
                visit(VIEWS[word])
                if word not in needed:
                    needed.append(word)

    visit(query.sql)
    body = query.sql if " " in query.sql.strip() else f"SELECT * FROM {query.sql}"
    read = Counter(w for text in [body, *(VIEWS[n] for n in needed)] for w in re.findall(r"\b[a-z][a-z0-9_]*\b", text))
    steps = ",\n".join(f"{n} AS {'MATERIALIZED ' if read[n] > 1 else ''}({VIEWS[n]})" for n in needed)
    prefix = f"WITH {steps}\n" if needed else ""
    return f"{prefix}SELECT {_published_sql(query.spec)}\nFROM ({body}) AS answer"
