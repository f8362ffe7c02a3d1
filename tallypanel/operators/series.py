"""Row-to-row metrics along the days of each key.

Every operator orders by the same ``(keys, day, tie)`` window, so a chain of them
costs one shuffle and one sort. The panel holds one row per key and day, which bounds
a window by the number of days, however many raw rows the key had before
``aggregate``. Series of raw rows go through ``segmented`` instead. An empty ``keys``
makes one series of all rows, to be used on daily totals only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallypanel.functions.numbers import delta_name, doubling_periods, safe_ratio


def day_window(keys: Sequence[str], ts: str, tie: Sequence[str] = ()) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(ts, *tie)


def _up_to_now(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def add_deltas(
    df: DataFrame, keys: Sequence[str], ts: str, metrics: Sequence[str], tie: Sequence[str] = ()
) -> DataFrame:
    """``new<Metric>`` = value less the previous row's; the value itself where that is missing."""
    w = day_window(keys, ts, tie)
    return df.withColumns(
        {delta_name(m): F.coalesce(F.col(m) - F.lag(m).over(w), F.col(m)) for m in metrics}
    )


def growth_rate(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    metric: str = "confirmed",
    out: str = "growthRate",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Delta over the previous row's value, 0 where that is missing or 0."""
    previous = F.lag(metric).over(day_window(keys, ts, tie))
    return df.withColumn(out, safe_ratio(F.col(delta_name(metric)), previous))


def mean_of(values: str, n: int) -> Column:
    """Mean of the ``n`` known values in the array, added up in its order; 0 if there are
    fewer. The one account of an average for plain and segmented series alike."""
    total = F.aggregate(F.col(values).cast("array<double>"), F.lit(0.0), lambda sum_, v: sum_ + v)
    return F.when(F.size(values) == n, total / n).otherwise(0.0)


def moving_average(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    column: str = "growthRate",
    n: int = 7,
    out: str = "movingAvg",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Mean of the last ``n`` rows, 0 until there are ``n`` values."""
    last_n = day_window(keys, ts, tie).rowsBetween(1 - n, Window.currentRow)
    values = df.withColumn("_values", F.collect_list(column).over(last_n))
    return values.withColumn(out, mean_of("_values", n)).drop("_values")


def doubling_time(
    df: DataFrame, column: str = "movingAvg", out: str = "doublingTime"
) -> DataFrame:
    return df.withColumn(out, doubling_periods(F.col(column)))


def neighbours(
    df: DataFrame, keys: Sequence[str], ts: str, metric: str, tie: Sequence[str] = ()
) -> DataFrame:
    """Previous and next value, and whether a previous row of the same key exists."""
    w = day_window(keys, ts, tie)
    return df.withColumns(
        {
            "previous": F.lag(metric).over(w),
            "next": F.lead(metric).over(w),
            "same_key": F.lag(F.lit(True), 1, False).over(w),
        }
    )


def forward_fill(
    df: DataFrame, keys: Sequence[str], ts: str, metrics: Sequence[str], tie: Sequence[str] = ()
) -> DataFrame:
    """The last known value for a missing one; missing before the first known value."""
    w = _up_to_now(day_window(keys, ts, tie))
    return df.withColumns({m: F.last(m, ignorenulls=True).over(w) for m in metrics})


def repair_once(
    df: DataFrame, keys: Sequence[str], ts: str, metrics: Sequence[str], tie: Sequence[str] = ()
) -> DataFrame:
    """One repair pass: a value not at least the previous row's is taken from the last
    row that was. A comparison with a missing value counts as a failure."""
    w = day_window(keys, ts, tie)
    later = F.lag(F.lit(True)).over(w).isNotNull()
    kept = {m: F.coalesce(F.col(m) >= F.lag(m).over(w), ~later) for m in metrics}
    marked = df.withColumns({f"_kept_{m}": F.when(kept[m], F.col(m)) for m in metrics})
    filled = forward_fill(marked, keys, ts, [f"_kept_{m}" for m in metrics], tie)
    return filled.withColumns(
        {m: F.coalesce(f"_kept_{m}", m) for m in metrics}
    ).drop(*[f"_kept_{m}" for m in metrics])


def repair_monotone(
    df: DataFrame, keys: Sequence[str], ts: str, metrics: Sequence[str], tie: Sequence[str] = ()
) -> DataFrame:
    """The running maximum, which is where repeated ``repair_once`` passes end: a pass
    only raises values, never above the running maximum, which it leaves unchanged."""
    w = _up_to_now(day_window(keys, ts, tie))
    return df.withColumns({m: F.max(m).over(w) for m in metrics})


def repair_and_diff(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    metrics: Sequence[str],
    tie: Sequence[str] = (),
    growth_of: str | None = None,
    growth: str = "growthRate",
) -> DataFrame:
    """``repair_monotone`` then ``add_deltas``, and ``growth_rate`` of the metric
    ``growth_of``, in a single window pass: the previous repaired value is the running
    maximum up to the row before."""
    w = day_window(keys, ts, tie)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns(
        {
            **{f"_now_{m}": F.max(m).over(_up_to_now(w)) for m in metrics},
            **{f"_before_{m}": F.max(m).over(before) for m in metrics},
        }
    )
    out = {m: F.col(f"_now_{m}") for m in metrics}
    for m in metrics:
        delta = F.col(f"_now_{m}") - F.col(f"_before_{m}")
        out[delta_name(m)] = F.coalesce(delta, F.col(f"_now_{m}"))
    if growth_of is not None:
        out[growth] = safe_ratio(out[delta_name(growth_of)], F.col(f"_before_{growth_of}"))
    return df.withColumns(out).drop(*[f"_{t}_{m}" for m in metrics for t in ("now", "before")])
