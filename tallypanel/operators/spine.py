"""Panel completion on the observed days, onset trim and day numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallypanel.operators.series import day_window



def observed_days(df: DataFrame, ts: str, seed_days: int = 1) -> DataFrame:
    """The distinct days of ``df`` and the day ``seed_days`` before the first, each with
    its position from 0 (``_slot``), the number of days (``_slots``) and the day before it
    in this list (``_prev``).

    Its size is bounded by the calendar, not by the data: dates span at most 3.7
    million days. That is why it may be numbered in one task and broadcast.
    """
    if not isinstance(df.schema[ts].dataType, T.DateType):
        raise TypeError(f"{ts} must be a date")
    by_day = Window.orderBy(ts)
    seed_day = F.date_sub(ts, seed_days)
    numbered = df.select(ts).dropna().distinct().select(
        ts,
        F.row_number().over(by_day).alias("_slot"),
        (F.count("*").over(Window.partitionBy()) + 1).cast("int").alias("_slots"),
        F.coalesce(F.lag(ts).over(by_day), seed_day).alias("_prev"),
    )
    own = F.struct(F.col(ts), F.col("_slot"), F.col("_prev"))
    no_day = F.lit(None).cast("date").alias("_prev")
    seed = F.struct(seed_day.alias(ts), F.lit(0).alias("_slot"), no_day)
    with_seed = F.when(F.col("_slot") == 1, F.array(seed, own)).otherwise(F.array(own))
    return numbered.select("_slots", F.inline(with_seed)).select(ts, "_slot", "_slots", "_prev")


def seeded_days(df: DataFrame, ts: str, seed_days: int = 1) -> DataFrame:
    """The distinct days and one seed day before the first."""
    return observed_days(df, ts, seed_days).select(ts)


def _own_or_fill(df: DataFrame, columns: Sequence[str], fixed: Sequence[str]) -> list[Column]:
    """The ``columns`` of an own row; on added rows 0 for numbers and NULL for the rest."""
    out = []
    for name in columns:
        kind = df.schema[name].dataType
        if name in fixed:
            out.append(F.col(name))
        elif isinstance(kind, T.NumericType):
            zero = f"CAST(0 AS {kind.simpleString()})"
            out.append(F.expr(f"coalesce(if(_own, `{name}`, NULL), {zero}) AS `{name}`"))
        else:
            out.append(F.expr(f"if(_own, `{name}`, NULL) AS `{name}`"))
    return out


def complete_series(df: DataFrame, ts: str, seed_days: int = 1) -> DataFrame:
    """A key-less series plus the seed day before its first; missing numbers become 0.

    A series is complete on its own days, so only the seed row is added.
    """
    numbered = df.withColumn("_row", F.row_number().over(Window.orderBy(ts)))
    back = F.when(F.col("_row") == 1, F.array(F.lit(seed_days), F.lit(0)))
    wide = numbered.withColumn("_back", F.explode(back.otherwise(F.array(F.lit(0)))))
    wide = wide.withColumn("_own", F.col("_back") == 0)
    seeded = wide.withColumn(ts, F.date_sub(ts, F.col("_back")))
    return seeded.select(*_own_or_fill(seeded, df.columns, [ts])).select(*df.columns)


def complete_panel(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    seed_days: int = 1,
    tie: Sequence[str] = (),
    days: DataFrame | None = None,
) -> DataFrame:
    """Every key on every observed day plus the seed day; numbers are 0 where absent.

    Each present row writes out the absent days up to the next present one, inside the
    key's own task. So only present rows are shuffled, never the completed panel, and
    no product of keys and days is joined. ``days`` takes a ready ``observed_days``.
    """
    if not keys:
        return complete_series(df, ts, seed_days)
    days = observed_days(df, ts, seed_days) if days is None else days
    placed = df.join(F.broadcast(days.drop("_prev")), ts)
    w = day_window(keys, ts, tie)
    gaps = placed.withColumns(
        {
            "_first": F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(F.col("_slot")),
            "_next": F.lead("_slot").over(w),
        }
    )
    until = F.greatest(F.col("_slot"), F.coalesce(F.col("_next"), F.col("_slots")) - 1)
    wide = gaps.withColumn("_at", F.explode(F.sequence(F.col("_first"), until)))
    wide = wide.withColumn("_own", F.col("_at") == F.col("_slot")).drop(ts, "_slot", "_slots")
    dated = wide.join(F.broadcast(days.select(ts, F.col("_slot").alias("_at"))), "_at")
    return dated.select(*_own_or_fill(dated, df.columns, [*keys, ts])).select(*df.columns)


def spine(df: DataFrame, keys: Sequence[str], ts: str, seed_days: int = 1) -> DataFrame:
    """The bare frame of the completed panel: each key with each observed day."""
    return complete_panel(df.select(*keys, ts).distinct(), keys, ts, seed_days)


def onset_flag(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    metric: str = "confirmed",
    out: str = "onset",
    tie: Sequence[str] = (),
) -> DataFrame:
    """True on a 0 row whose next row of the same key is positive."""
    upcoming = F.lead(metric).over(day_window(keys, ts, tie))
    flag = (F.col(metric) == 0) & (upcoming > 0)
    return df.withColumn(out, F.coalesce(flag, F.lit(False)))


def day_number(
    df: DataFrame, keys: Sequence[str], ts: str, out: str = "Days", tie: Sequence[str] = ()
) -> DataFrame:
    """Position of the row within its key, from 0."""
    return df.withColumn(out, F.row_number().over(day_window(keys, ts, tie)) - 1)


def onset_trim(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    metric: str = "confirmed",
    out: str = "Days",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Keep positive rows and the 0 row right before each positive run, then number them."""
    flagged = onset_flag(df, keys, ts, metric, "_onset", tie)
    kept = flagged.where(F.col("_onset") | (F.col(metric) > 0)).drop("_onset")
    return day_number(kept, keys, ts, out, tie)


def with_previous_day(df: DataFrame, ts: str, days: DataFrame, out: str) -> DataFrame:
    """The observed day before the row's own one; ``days`` comes from ``observed_days``."""
    before = days.select(ts, F.col("_prev").alias(out))
    return df.join(F.broadcast(before), ts).select(*df.columns, out)


def trim_rows(near: DataFrame, ts: str, metric: str, previous: str) -> DataFrame:
    """The kept rows of a panel that is not completed, with ``_lead_in`` 1 where the absent
    day before is kept as well. ``near`` has the key's previous day as ``_before`` and of
    the next row the value as ``_upcoming`` and the observed day before it as
    ``_before_next``."""
    positive = F.coalesce(F.col(metric) > 0, F.lit(False))
    # A missing value counts as 0; the next row counts only if no day lies between.
    zero = F.coalesce(F.col(metric) == 0, F.lit(True))
    onset = zero & (F.col("_upcoming") > 0) & (F.col("_before_next") <= F.col(ts))
    absent_before = F.coalesce(F.col("_before") < F.col(previous), F.lit(True))
    kept = near.withColumn("_lead_in", (positive & absent_before).cast("int"))
    return kept.where(positive | F.coalesce(onset, F.lit(False)))


def write_lead_ins(
    numbered: DataFrame, ts: str, out: str, previous: str, columns: Sequence[str], fixed: Sequence[str]
) -> DataFrame:
    """``columns`` of the kept rows, each after its lead-in row if it has one. ``out`` is
    the number of the row itself."""
    both = F.when(F.col("_lead_in") == 1, F.array(previous, ts)).otherwise(F.array(ts))
    wide = numbered.withColumn("_day", F.explode(both))
    wide = wide.withColumn("_own", F.col("_day") == F.col(ts)).withColumn(ts, F.col("_day"))
    number = F.when(F.col("_own"), F.col(out)).otherwise(F.col(out) - 1).alias(out)
    return wide.select(*_own_or_fill(wide, columns, [*fixed, ts]), number).select(*columns, out)


def complete_and_trim(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    metric: str = "confirmed",
    out: str = "Days",
    seed_days: int = 1,
    tie: Sequence[str] = (),
    previous: str | None = None,
) -> DataFrame:
    """``complete_panel`` then ``onset_trim`` without building the completed panel.

    Of the absent days the trim keeps just the one right before a positive row. So a
    positive row whose day before is absent writes out that one 0 row, and the result
    has at most two rows per present row instead of keys times days. ``previous`` names
    a column from ``with_previous_day``, if the rows have it; it is dropped.
    """
    if not keys:
        return onset_trim(complete_series(df, ts, seed_days), keys, ts, metric, out, tie)
    if previous is None:
        previous = "_prev"
        df = with_previous_day(df, ts, observed_days(df, ts, seed_days), previous)
    columns = [c for c in df.columns if c != previous]
    w = day_window(keys, ts, tie)
    near = df.withColumns(
        {
            "_before": F.lag(ts).over(w),
            "_before_next": F.lead(previous).over(w),
            "_upcoming": F.lead(metric).over(w),
        }
    )
    kept = trim_rows(near, ts, metric, previous)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = kept.withColumn(out, F.sum(F.col("_lead_in") + 1).over(so_far).cast("int") - 1)
    return write_lead_ins(numbered, ts, out, previous, columns, keys)
