"""CSV and JSON tables. Both replace what the folder held and are written in parallel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallypanel.functions.days import day_label

JSON_DECIMALS = 10


def labelled(df: DataFrame) -> DataFrame:
    """Dates as ``MM-dd-yyyy`` text, as both sinks show them."""
    days = [f.name for f in df.schema if isinstance(f.dataType, T.DateType)]
    return df.withColumns({d: day_label(F.col(d)) for d in days}) if days else df


def _ordered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    # Sorted before the labels are made, as those do not sort by time.
    return labelled(df.orderBy(*order) if order else df)


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """A folder of CSV files with headers; NULL is empty. Blanks and line breaks in
    texts stay; ``read_csv`` reads the latter with ``multi_line``."""
    options = {"header": True, "escape": '"', "emptyValue": ""}
    options |= {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    _ordered(df, order).write.mode("overwrite").options(**options).csv(path)


def _rounded(df: DataFrame) -> list[Column]:
    return [
        F.round(f.name, JSON_DECIMALS).alias(f.name)
        if isinstance(f.dataType, T.DoubleType)
        else F.col(f.name)
        for f in df.schema
    ]


def write_json(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """A folder of JSON lines, one record per row, floats with 10 decimals."""
    shown = _ordered(df, order)
    shown.select(*_rounded(shown)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def json_records(df: DataFrame) -> DataFrame:
    """Column ``record``: each row as the JSON text that ``write_json`` writes."""
    shown = labelled(df)
    record = F.to_json(F.struct(*_rounded(shown)), {"ignoreNullFields": "false"})
    return shown.select(record.alias("record"))
