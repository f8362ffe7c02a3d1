"""Column shape: renames, strict drops, fills and the balance column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def drop_strict(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop columns that must exist; ``DataFrame.drop`` alone ignores absent ones."""
    require_columns(df, columns)
    return df.drop(*columns)


def fill_zero(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """0 for missing numbers, in ``columns`` or in every numeric column."""
    if columns is None:
        columns = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return df.fillna(0, subset=list(columns)) if columns else df


def fill_blank(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Empty text for missing text."""
    if columns is None:
        columns = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.fillna("", subset=list(columns)) if columns else df


def null_token(df: DataFrame, token: str = "NULL") -> DataFrame:
    """NULL for a text that stands for a missing value, in every text column."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.replace(token, None, subset=texts) if texts else df


def balance(
    df: DataFrame,
    total: str = "confirmed",
    parts: Sequence[str] = ("deaths", "recovered"),
    out: str = "active",
) -> DataFrame:
    """``total`` less all ``parts``."""
    rest = F.col(total)
    for part in parts:
        rest = rest - F.col(part)
    return df.withColumn(out, rest)


def as_double(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})
