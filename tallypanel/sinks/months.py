"""Tables in a folder per month, of which single months are replaced and read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONTH = "month"


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def write_months(df: DataFrame, path: str, ts: str, order: Sequence[str] = ()) -> None:
    """Replace the months that ``df`` has rows of; the files of all others stay. Rows are dealt by
    range of month and order, so a large month is written by several tasks, sorted."""
    marked = df.withColumn(MONTH, month_of(F.col(ts)))
    keys = [MONTH, *order, ts]
    dealt = marked.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt.write.partitionBy(MONTH).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_months(spark: SparkSession, path: str, schema: str, months: Sequence[str] | None = None) -> DataFrame:
    """The rows of the given months (all by default); other months' folders are not opened."""
    rows = spark.read.schema(f"{schema}, {MONTH} string").parquet(path)
    return rows if months is None else rows.where(F.col(MONTH).isin(list(months)))
