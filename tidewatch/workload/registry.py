"""Registration of a query next to the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import ship

# Both sides add this before rounding, so that exact ties go the same way in both engines.
TIE = "1e-12"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @wraps(function)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(ship(spark), sf_dir)

        QUERIES[name] = shipped
        if sql is not None:
            ORACLES[name] = tie_safe(sql)
        return function

    return register


def tie_safe(sql: str) -> str:
    """``round(x, n)`` to ``round(x + 1e-12, n)`` throughout the text."""
    out, i = [], 0
    while (start := sql.find("round(", i)) >= 0:
        depth, j, comma = 1, start + 6, None
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            if sql[j] == "," and depth == 1:
                comma = j
            j += 1
        if comma is None:
            out.append(sql[i : start + 6])
            i = start + 6
            continue
        out.append(sql[i:start] + f"round({tie_safe(sql[start + 6 : comma])} + {TIE}{sql[comma:j]}")
        i = j
    return "".join(out) + sql[i:]


def number(column: Column | str, places: int = 8) -> Column:
    """Decimal result as a rounded double, the form both engines print alike."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double") + float(TIE), places)


def numbers(df: DataFrame, *names: str, places: int = 8) -> DataFrame:
    return df.withColumns({n: number(n, places) for n in names})
