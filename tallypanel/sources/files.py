"""Header CSV files with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallypanel.operators.lookup import unique_lookup

LOOKUP = "current string, subs string"
COORDINATES = "countryCode string, lat double, long double, country string"


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """UTF-8 CSV with a header, quoted text as usual (``""`` inside quotes), empty as NULL.
    With ``multi_line`` texts may hold line breaks, and a file is read by one task."""
    return spark.read.csv(
        path,
        schema=schema,
        header=True,
        encoding="UTF-8",
        quote='"',
        escape='"',
        mode="FAILFAST",
        enforceSchema=False,
        multiLine=multi_line,
    )


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """``current, subs``, one row per ``current``: the last one in file order."""
    rows = read_csv(spark, path, LOOKUP, multi_line=True)
    placed = rows.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return unique_lookup(placed, "current", "subs", ["_file", "_block", "_row"])


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """``country, lat, long``."""
    return read_csv(spark, path, COORDINATES, multi_line=True).select("country", "lat", "long")
