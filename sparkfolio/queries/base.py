"""How queries are declared: a function of (spark, sf_dir) with its SQL; doubles are rounded alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def query(name: str, sql: str | None = None, doubles: str = "", ctes: str = "", digits: int = DIGITS):
    """Registers a query. sql: a SELECT over the views and the ctes; doubles: its columns to round."""

    def add(f):
        QUERIES[name] = lambda spark, sf: rounded(f(spark, sf), digits)
        if sql:
            cols = ", ".join(f"round({c}, {digits}) + 0.0::DOUBLE AS {c}" for c in doubles.split())
            SQL[name] = (f"WITH {ctes}\n" if ctes else "") + (f"SELECT * REPLACE ({cols}) FROM ({sql})" if cols else sql)
        return f

    return add
