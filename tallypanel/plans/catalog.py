"""Registry of the queries over the given tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallypanel.sinks.files import labelled

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}
DECIMALS = 6
# The columns with fractions; all others hold whole numbers or text.
FRACTIONS = ("growthRate", "movingAvg", "ratio", "magnitude", "quantity")


def day_text(column: str = "timestamp") -> str:
    """SQL for a day as its label."""
    return f"strftime({column}, '%m-%d-%Y') AS {column}"


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query. Its days are shown as labels and its fractions with 6 decimals,
    so both engines print the same values."""

    def register(build: Build) -> Build:
        def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(spark, sf_dir)
            rounded = {c: F.round(c, DECIMALS) for c in FRACTIONS if c in df.columns}
            return labelled(df.withColumns(rounded) if rounded else df)

        QUERIES[name] = shown
        if sql is not None:
            SQL[name] = sql
        return build

    return register
