"""Lookups and dimension joins that hold at any size of the small side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024


def measured_bytes(df: DataFrame) -> int:
    """Upper estimate of the in-memory size, from one distributed aggregate."""
    sized = []
    for field in df.schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            sized.append(F.sum(F.octet_length(field.name)))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            sized.append(F.sum(F.octet_length(F.to_json(F.struct(field.name)))))
    row = df.agg(F.count("*"), *sized).first()
    return row[0] * 16 * (len(df.columns) + 1) + sum(v or 0 for v in row[1:])


def fits(dim: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``dim`` may be broadcast."""
    return measured_bytes(dim) <= max_bytes


def left_join(
    df: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    max_bytes: int = BROADCAST_BYTES,
    small: bool | None = None,
) -> DataFrame:
    """``df`` left join ``dim``, which has at most one row per ``on``.

    A dimension measured below ``max_bytes`` is broadcast. A larger one is joined by
    shuffle and merge, where adaptive execution splits the parts of keys with many rows,
    also of equal rows and of rows without a key. ``small`` is the answer of ``fits``, if
    already known.
    """
    on = list(on)
    near = fits(dim, max_bytes) if small is None else small
    joined = df.join(F.broadcast(dim) if near else dim.hint("merge"), on, "left")
    return joined.select(*df.columns, *[c for c in dim.columns if c not in on])


def unique_lookup(
    df: DataFrame, key: str, value: str, order: Sequence[str | Column]
) -> DataFrame:
    """One row per key, the last in ``order`` winning, as when filling a dictionary."""
    last = F.max_by(value, F.struct(*order))
    return df.dropna(subset=[key]).groupBy(key).agg(last.alias(value))


def standardize(
    df: DataFrame,
    column: str,
    lookup: DataFrame,
    current: str = "current",
    subs: str = "subs",
    max_bytes: int = BROADCAST_BYTES,
    small: bool | None = None,
) -> DataFrame:
    """Replace names found in ``lookup``; other names stay. ``lookup`` must hold one row
    per ``current`` (see ``unique_lookup``)."""
    names = lookup.select(F.col(current).alias(column), F.col(subs).alias("_subs"))
    joined = left_join(df, names, [column], max_bytes, small)
    return joined.withColumn(column, F.coalesce("_subs", column)).select(*df.columns)


def add_dimension(
    df: DataFrame, dim: DataFrame, on: Sequence[str], max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Attributes of ``dim`` by key; NULL where the key is unknown."""
    return left_join(df, dim, on, max_bytes)
