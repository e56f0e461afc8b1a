"""Named queries and the SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.plans.views import VIEW_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


SCALE = 1e6
# Sums of doubles differ in the last bits between engines. The small surplus over one half makes an
# exact tie at the seventh place round up in both, instead of either way.
HALF_UP = 0.5001
# Beyond it a double has no sixth place to round, and floor would leave the range of a long.
LARGEST = 9e9


def rounded(df: DataFrame) -> DataFrame:
    """Round doubles below LARGEST to 6 places; larger ones, infinities and NaN stay as they are."""

    def place(name: str) -> Column:
        x = F.col(f"`{name}`")
        return F.when(F.abs(x) < LARGEST, F.floor(x * F.lit(SCALE) + F.lit(HALF_UP)) / F.lit(SCALE)).otherwise(x).alias(name)

    return df.select(*[place(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def rounded_sql(column: str) -> str:
    x = f"CAST({column} AS DOUBLE)"
    floor = f"floor({x} * CAST({SCALE} AS DOUBLE) + CAST({HALF_UP} AS DOUBLE)) / CAST({SCALE} AS DOUBLE)"
    return f"CASE WHEN abs({x}) < CAST({LARGEST} AS DOUBLE) THEN {floor} ELSE {x} END AS {column}"


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the definitions of the views it names."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEW_SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{name} AS ({VIEW_SQL[name].strip()})" for name in needed)
    body = sql.strip()
    recursive = ""
    if body.upper().startswith("WITH RECURSIVE "):
        recursive, body = "RECURSIVE ", "WITH " + body[len("WITH RECURSIVE "):]
    if body.upper().startswith("WITH "):
        return f"WITH {recursive}{head},\n{body[5:]}"
    return f"WITH {recursive}{head}\n{body}"


def query(name: str, sql: str | None = None, doubles: str = "", exact: bool = False) -> Callable[[Query], Query]:
    """Register a query; ``doubles`` names the columns of ``sql`` to round to 6 places, ``exact`` leaves all as they are."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn if exact else lambda spark, sf: rounded(fn(spark, sf))
        if sql is not None:
            body = sql.strip()
            if doubles:
                repl = ", ".join(rounded_sql(c) for c in doubles.split())
                body = f"SELECT * REPLACE ({repl}) FROM (\n{with_views(body)}\n) AS result"
            else:
                body = with_views(body)
            ORACLES[name] = body
        return fn

    return register
