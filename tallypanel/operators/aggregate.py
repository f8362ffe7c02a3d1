"""Aggregations. All have a map-side part, so a hot group ships one row per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aggregate(df: DataFrame, keys: Sequence[str], ts: str, metrics: Sequence[str]) -> DataFrame:
    """Sum ``metrics`` per key and day. Rows without a key or day are dropped and a
    group with only missing values sums to 0."""
    by = [*keys, ts]
    sums = [F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in metrics]
    return df.dropna(subset=by).groupBy(*by).agg(*sums)


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def bounds(df: DataFrame, ts: str, metrics: Sequence[str] = ()) -> DataFrame:
    """First day, last day and the sum of each metric, as one row."""
    return df.agg(
        F.min(ts).alias("first_day"),
        F.max(ts).alias("last_day"),
        *[F.sum(m).alias(f"sum_{m}") for m in metrics],
    )


def latest_rows(df: DataFrame, ts: str) -> DataFrame:
    """Rows of the latest day; the maximum is a scalar subquery, not a join."""
    return df.where(F.col(ts) == df.agg(F.max(ts)).scalar())


def hot_groups(df: DataFrame, keys: Sequence[str], max_rows: int) -> DataFrame:
    """Groups of more than ``max_rows`` rows with their ``_rows``. There are fewer of them
    than rows over ``max_rows``."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    return counts.where(F.col("_rows") > max_rows)
