"""Global order as a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallypanel.session import materialize


def same(left: str, right: str, names: Sequence[str]) -> Column:
    """Null-safe equality of the columns ``names`` of two aliased sides."""
    match = F.lit(True)
    for name in names:
        match = match & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return match


def ranked(
    df: DataFrame,
    order: Sequence[Column | str],
    within: Sequence[str] = (),
    out: str = "rank",
    weight: str | None = None,
) -> DataFrame:
    """Position from 0 of each row in ``order`` within its group, however large the group; with the
    whole number ``weight`` (never null, ``order`` without ties) the sum of it over the rows before.

    Rows are dealt by range of (group, order) and fixed with the number of their part. A
    part's first group alone can continue an earlier part's, so at most one row per part
    is broadcast.
    """
    cut = df.repartitionByRange(*within, *order).withColumn("_part", F.spark_partition_id())
    fixed = materialize(cut, "ranked")
    amount = F.sum(weight) if weight else F.count("*")
    counts = fixed.groupBy("_part", *within).agg(amount.alias("_n"))
    earlier = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.sum("_n").over(earlier)).where("_before > 0").drop("_n")
    joined = fixed.alias("r").join(
        F.broadcast(before.alias("b")), same("r", "b", ["_part", *within]), "left"
    )
    local = Window.partitionBy("_part", *within).orderBy(*order)
    rows = joined.select("r.*", F.coalesce("b._before", F.lit(0)).alias("_before"))
    if weight:
        upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        position = F.col("_before") + F.sum(weight).over(upto) - F.col(weight)
    else:
        position = F.col("_before") + F.row_number().over(local) - 1
    return rows.withColumn(out, position.cast("long")).drop("_part", "_before")


def file_order(df: DataFrame, out: str = "position") -> DataFrame:
    """Position from 0 of each row of files that are read (``df`` must be a plain scan): by the
    name of the file and the place in it."""
    placed = df.select(
        "*",
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    fixed = materialize(placed, "placed")
    return ranked(fixed, ["_file", "_block", "_row"], out=out).drop("_file", "_block", "_row")
