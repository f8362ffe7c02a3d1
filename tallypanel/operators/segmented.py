"""Series of raw rows, where one key (or no key) may hold any share of the table.

``segment`` cuts the rows, in key and time order, into segments of similar size, so a
hot key spans many segments. Each operator then works inside the segments and adds
what earlier segments of the same key pass on. A key continues from one segment to the
next at most once per segment border, so the passed-on rows number fewer than twice the
segments. They are broadcast while the segments are few enough, else joined by shuffle.

``metrics_and_trim`` takes a chain of such operators at once: one summary row per segment
holds all that is passed on, and one further pass over the rows does the rest.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tallypanel.functions.numbers import delta_name, safe_ratio
from tallypanel.operators import spine
from tallypanel.operators.series import mean_of
from tallypanel.session import materialize

ROWS_PER_SEGMENT = 4_000_000
# Passed-on rows hold a few values for each metric and row of an average, below 1 KB.
BROADCAST_SEGMENTS = 50_000


@dataclass(frozen=True)
class Segments:
    """Rows with their ``_segment``, one of ``number``; ``order`` must be unique within ``keys``."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    number: int

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, "_segment").orderBy(*self.order)

    def with_rows(self, df: DataFrame) -> Segments:
        return replace(self, df=df)

    def fixed(self) -> Segments:
        """The rows written out. Each operator reads its rows twice, so a chain of
        operators fixes them in between."""
        return self.with_rows(materialize(self.df, "segments"))

    def position(self) -> Column:
        """The order columns as one comparable value."""
        return F.struct(*self.order)

    def passed_on(self, per_segment: list[Column], carried: dict[str, Column]) -> DataFrame:
        """Columns ``carried``, computed over the other segments of each key, for the
        segments that are not alone. Their number is below twice the segments'."""
        summary = self.df.groupBy(*self.keys, "_segment").agg(*per_segment)
        by_key = self.by_segment()
        shared = {
            "_behind": F.lag(F.lit(True), 1, False).over(by_key),
            "_ahead": F.lead(F.lit(True), 1, False).over(by_key),
        }
        rows = summary.withColumns({**carried, **shared}).where("_behind OR _ahead")
        return rows.select(*self.keys, "_segment", *carried)

    def by_segment(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy("_segment")

    def earlier(self) -> WindowSpec:
        return self.by_segment().rowsBetween(Window.unboundedPreceding, -1)

    def attach(self, passed: DataFrame) -> DataFrame:
        """The rows with the passed-on columns; NULL in a key's first segment."""
        mine = self.df.alias("r")
        theirs = passed.hint("broadcast" if self.number <= BROADCAST_SEGMENTS else "merge").alias("p")
        match = F.col("r._segment") == F.col("p._segment")
        for key in self.keys:
            match = match & F.col(f"r.{key}").eqNullSafe(F.col(f"p.{key}"))
        extra = [c for c in passed.columns if c not in (*self.keys, "_segment")]
        return mine.join(theirs, match, "left").select("r.*", *[f"p.{c}" for c in extra])


def segments_for(spark: SparkSession, rows: int) -> int:
    """Enough segments for the rows and for all tasks of a shuffle."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(-(-rows // ROWS_PER_SEGMENT), tasks)


def segment(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], segments: int | None = None
) -> Segments:
    """Range-partition by keys and order, and fix the partition number as the segment.

    The result is written to shared scratch: a segment number that changed when a lost
    task ran again would give wrong results.
    """
    if segments is None:
        segments = segments_for(df.sparkSession, df.count())
    ranged = df.repartitionByRange(segments, *keys, *order)
    numbered = ranged.withColumn("_segment", F.spark_partition_id())
    return Segments(materialize(numbered, "segments"), tuple(keys), tuple(order), segments)


def deltas_and_growth(s: Segments, metric: str, out: str = "growthRate") -> Segments:
    """``new<Metric>`` and growth against the previous row of the key."""
    passed = s.passed_on(
        [F.max_by(F.struct(metric), s.position()).alias("_last")],
        {"_carry": F.lag(F.col(f"_last.{metric}")).over(s.by_segment())},
    )
    first = F.row_number().over(s.window()) == 1
    previous = F.when(first, F.col("_carry")).otherwise(F.lag(metric).over(s.window()))
    rows = s.attach(passed).withColumn("_previous", previous)
    delta = F.coalesce(F.col(metric) - F.col("_previous"), F.col(metric))
    rows = rows.withColumns({delta_name(metric): delta, out: safe_ratio(delta, F.col("_previous"))})
    return s.with_rows(rows.drop("_carry", "_previous"))


def repair_and_diff(
    s: Segments,
    metrics: Sequence[str],
    growth_of: str | None = None,
    growth: str = "growthRate",
) -> Segments:
    """Running maximum per key, its deltas, and the growth of the metric ``growth_of``."""
    passed = s.passed_on(
        [F.max(m).alias(f"_top_{m}") for m in metrics],
        {f"_carry_{m}": F.max(f"_top_{m}").over(s.earlier()) for m in metrics},
    )
    return s.with_rows(_repaired(s, s.attach(passed), metrics, growth_of, growth))


def _repaired(
    s: Segments, rows: DataFrame, metrics: Sequence[str], growth_of: str | None, growth: str
) -> DataFrame:
    """``repair_and_diff`` of rows that have the maxima before their segment as ``_carry_<metric>``."""
    so_far = s.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = s.window().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            **{f"_now_{m}": F.max(m).over(so_far) for m in metrics},
            **{f"_before_{m}": F.max(m).over(before) for m in metrics},
        }
    )
    out = {}
    for m in metrics:
        carry = F.col(f"_carry_{m}")
        now = F.greatest(F.col(f"_now_{m}"), carry)
        previous = F.greatest(F.col(f"_before_{m}"), carry)
        out[m] = now
        out[delta_name(m)] = F.coalesce(now - previous, now)
        if m == growth_of:
            out[growth] = safe_ratio(out[delta_name(m)], previous)
    rows = rows.withColumns(out)
    return rows.drop(*[f"_{t}_{m}" for m in metrics for t in ("now", "before", "carry")])


def repair_monotone(s: Segments, metric: str) -> Segments:
    """Running maximum per key."""
    fixed = repair_and_diff(s, [metric])
    return s.with_rows(fixed.df.drop(delta_name(metric)))


def forward_fill(s: Segments, metric: str) -> Segments:
    """Last known value per key."""
    known = F.max_by(metric, F.when(F.col(metric).isNotNull(), s.position()))
    passed = s.passed_on(
        [known.alias("_last")], {"_carry": F.last("_last", ignorenulls=True).over(s.earlier())}
    )
    so_far = s.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = s.attach(passed)
    value = F.coalesce(F.last(metric, ignorenulls=True).over(so_far), F.col("_carry"))
    return s.with_rows(rows.withColumn(metric, value).drop("_carry"))


def running_sum(s: Segments, amount: Column, out: str) -> Segments:
    """Sum of ``amount`` over the key's rows so far."""
    passed = s.passed_on(
        [F.sum(amount).alias("_part")], {"_carry": F.sum("_part").over(s.earlier())}
    )
    so_far = s.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(amount).over(so_far) + F.coalesce("_carry", F.lit(0))
    return s.with_rows(s.attach(passed).withColumn(out, total).drop("_carry"))


def day_number(s: Segments, out: str = "Days") -> Segments:
    """Position of the row within its key, from 0."""
    counted = running_sum(s, F.lit(1), out)
    return s.with_rows(counted.df.withColumn(out, F.col(out) - 1))


def complete_and_trim(
    s: Segments, ts: str, previous: str, metric: str = "confirmed", out: str = "Days"
) -> DataFrame:
    """``spine.complete_and_trim`` of rows that have ``spine.with_previous_day``; the day
    number is long, as the rows per key have no bound."""
    columns = [c for c in s.df.columns if c not in (previous, "_segment")]
    edge = F.struct(ts, previous, metric)
    passed = s.passed_on(
        [F.min_by(edge, s.position()).alias("_first"), F.max_by(edge, s.position()).alias("_last")],
        {
            "_left": F.lag("_last").over(s.by_segment()),
            "_right": F.lead("_first").over(s.by_segment()),
        },
    )
    w = s.window()
    inside = s.attach(passed).withColumns({"_a": F.lag(edge).over(w), "_b": F.lead(edge).over(w)})
    left, right = F.coalesce("_a", "_left"), F.coalesce("_b", "_right")
    near = inside.withColumns(
        {"_before": left[ts], "_before_next": right[previous], "_upcoming": right[metric]}
    )
    kept = s.with_rows(spine.trim_rows(near, ts, metric, previous)).fixed()
    numbered = running_sum(kept, F.col("_lead_in") + 1, out).df
    numbered = numbered.withColumn(out, F.col(out) - 1)
    return spine.write_lead_ins(numbered, ts, out, previous, columns, s.keys)


def moving_average(
    s: Segments, column: str = "growthRate", n: int = 7, out: str = "movingAvg"
) -> Segments:
    """Mean of the key's last ``n`` rows, 0 until there are ``n`` values.

    A segment passes on its last ``n - 1`` values; they are reached by keeping the rows
    whose distance from the segment's end is below ``n``, not by sorting whole groups.
    """
    backwards = Window.partitionBy(*s.keys, "_segment").orderBy(*[F.desc(c) for c in s.order])
    from_end = F.row_number().over(backwards)
    tails = s.with_rows(s.df.withColumn("_from_end", from_end).where(F.col("_from_end") < n))
    entry = F.struct(F.negative("_from_end").alias("at"), F.col(column).alias("value"))
    tail = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["value"])
    # Each earlier segment of the key has a row, so n - 1 of them reach far enough.
    reach = s.by_segment().rowsBetween(1 - n, -1)
    gathered = F.flatten(F.collect_list("_tail").over(reach))
    passed = tails.passed_on(
        [tail.alias("_tail")],
        {"_carry": F.slice(gathered, F.greatest(F.size(gathered) - n + 2, F.lit(1)), n - 1)},
    )
    return s.with_rows(_averaged(s, s.attach(passed), column, n, out))


def _averaged(s: Segments, rows: DataFrame, column: str, n: int, out: str) -> DataFrame:
    """``moving_average`` of rows that have the last ``n - 1`` values before their segment as
    ``_carry``."""
    rows = rows.withColumn("_at", F.row_number().over(s.window()))
    last_n = s.window().rowsBetween(1 - n, Window.currentRow)
    carry = F.coalesce("_carry", F.array().cast("array<double>"))
    # The row at position p of its segment still needs n - p carried values.
    need = F.greatest(n - F.col("_at"), F.lit(0))
    used = F.slice(carry, F.greatest(F.size(carry) - need + 1, F.lit(1)), need)
    known = F.filter(used, lambda v: v.isNotNull())
    rows = rows.withColumn("_values", F.concat(known, F.collect_list(column).over(last_n)))
    return rows.withColumn(out, mean_of("_values", n)).drop("_carry", "_at", "_values")


def metrics_and_trim(
    s: Segments,
    ts: str,
    previous: str,
    metrics: Sequence[str],
    main: str = "confirmed",
    n: int = 7,
    growth: str = "growthRate",
    average: str = "movingAvg",
    out: str = "Days",
) -> DataFrame:
    """``repair_and_diff``, ``moving_average`` of the growth of ``main`` and
    ``complete_and_trim``, fused: one summary of the segments, one pass over the rows.

    The rows have ``spine.with_previous_day``. Nulls are absent values: a missing ``main`` before
    the first known one counts as 0 for the trim; an empty table gives an empty one. The day
    number is long.
    """
    columns = [c for c in s.df.columns if c not in (previous, "_segment")]
    derived = [*[delta_name(m) for m in metrics], growth, average]
    rows = s.attach(_carries(s, ts, previous, metrics, main, n))
    # The next segment's first value, as repaired there: above 0 only if this or an earlier one is.
    rows = rows.withColumn("_right_value", F.greatest(F.col("_right.value"), f"_carry_{main}"))
    rows = _repaired(s, rows, metrics, main, growth)
    rows = _averaged(s, rows, growth, n, average)
    w = s.window()
    near = rows.withColumns(
        {
            "_before": F.coalesce(F.lag(ts).over(w), "_left"),
            "_before_next": F.coalesce(F.lead(previous).over(w), "_right.previous"),
            "_upcoming": F.when(F.lead(F.lit(True)).over(w), F.lead(main).over(w)).otherwise(
                F.col("_right_value")
            ),
        }
    )
    kept = spine.trim_rows(near, ts, main, previous)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.sum(F.col("_lead_in") + 1).over(so_far) + F.coalesce("_days", F.lit(0)) - 1
    return spine.write_lead_ins(
        kept.withColumn(out, number), ts, out, previous, [*columns, *derived], s.keys
    )


def _carries(
    s: Segments, ts: str, previous: str, metrics: Sequence[str], main: str, n: int
) -> DataFrame:
    """What ``metrics_and_trim`` needs from other segments, from one row per segment.

    A segment knows its rows but not what earlier ones reached. As the repaired ``main`` is a
    running maximum, all rows are kept if an earlier segment was above 0, else those
    from the segment's first positive value on, and at most one before it. So both numbers of
    written rows are counted, and the maximum before the segment chooses. The last values
    are passed on as local maxima, from which the maximum before it makes the repaired ones.
    """
    w = s.window()
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = s.df.withColumns(
        {
            "_at": F.row_number().over(w),
            "_top": F.max(main).over(so_far),
            "_gap": F.coalesce(F.lag(ts).over(w) < F.col(previous), F.lit(False)),
            "_before_next": F.lead(previous).over(w),
            "_tail": F.lead(F.lit(True), n).over(w).isNull(),
        }
    ).withColumn("_next_top", F.lead("_top").over(w))
    positive = F.coalesce(F.col("_top") > 0, F.lit(False))
    turns = ~positive & (F.col("_next_top") > 0) & (F.col("_before_next") <= F.col(ts))
    edge = F.struct(
        F.col(ts).alias("ts"), F.col(previous).alias("previous"), F.col(main).alias("value")
    )
    summary = placed.groupBy(*s.keys, "_segment").agg(
        *[F.max(m).alias(f"_top_{m}") for m in metrics],
        F.min_by(edge, "_at").alias("_first"),
        F.max_by(ts, "_at").alias("_last"),
        F.sort_array(F.collect_list(F.when(F.col("_tail"), F.struct("_at", "_top")))).alias("_tops"),
        (F.count("*") + F.count_if("_gap")).alias("_all"),
        (F.count_if(positive) + F.count_if(positive & F.col("_gap"))).alias("_positive"),
        # The row before the first positive one: at most one, so any aggregate takes it.
        F.max(F.when(turns, F.struct("_top"))).alias("_turn"),
    )
    by_key = s.by_segment()
    known = summary.withColumns(
        {
            **{f"_carry_{m}": F.max(f"_top_{m}").over(s.earlier()) for m in metrics},
            "_left": F.lag("_last").over(by_key),
            "_right": F.lead("_first").over(by_key),
        }
    )
    carry = F.col(f"_carry_{main}")

    def is_zero(value: Column) -> Column:
        return F.coalesce(F.greatest(value, carry) == 0, F.lit(True))

    def one(condition: Column) -> Column:
        return F.coalesce(condition.cast("int"), F.lit(0))

    lead_in = F.coalesce(F.col("_left") < F.col("_first.previous"), F.lit(True))
    inner = F.col("_turn").isNotNull() & is_zero(F.col("_turn._top"))
    at_end = (
        is_zero(F.col(f"_top_{main}"))
        & (F.col("_right.value") > 0)
        & (F.col("_right.previous") <= F.col("_last"))
    )
    starts = F.coalesce(F.col("_first.value") > 0, F.lit(False)) & lead_in
    written = F.when(carry > 0, F.col("_all") + one(lead_in)).otherwise(
        F.col("_positive") + one(starts) + one(inner) + one(at_end)
    )
    values = F.transform("_tops", lambda e: F.greatest(e["_top"], carry))
    # Each earlier segment of the key has a row, so n of them reach far enough.
    reach = by_key.rowsBetween(-n, -1)
    counted = known.withColumns({"_written": written, "_values": values})
    passed = counted.withColumns(
        {
            "_days": F.sum("_written").over(s.earlier()),
            "_reached": F.flatten(F.collect_list("_values").over(reach)),
            "_behind": F.lag(F.lit(True), 1, False).over(by_key),
        }
    ).where(F.col("_behind") | F.col("_right").isNotNull())
    last = F.slice("_reached", F.greatest(F.size("_reached") - n + 1, F.lit(1)), n)
    passed = passed.withColumn("_reached", last)

    def growth_at(value: Column, i: Column) -> Column:
        before = F.get("_reached", i - 1)
        return safe_ratio(F.coalesce(value - before, value), before)

    # The first of n values only serves the second; the first of fewer begins the key and grows by 0.
    growths = F.transform("_reached", growth_at)
    begun = F.size("_reached") < n
    return passed.select(
        *s.keys,
        "_segment",
        *[f"_carry_{m}" for m in metrics],
        "_left",
        "_right",
        "_days",
        F.when(begun, growths).otherwise(F.slice(growths, 2, n)).alias("_carry"),
    )
