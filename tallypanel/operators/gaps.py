"""Panels completed on the observed days, with absent days kept as stretches.

``with_gaps`` has one row per present row and one per stretch of days between two of them, before
the first and after the last of a key; so at most two rows per present row and one per key, however
many days are absent. Operators work on these rows, and ``expand`` writes the cells out at the
end, where the observed days are broadcast once.

A stretch is a range of the calendar and may hold no observed day; then it writes nothing. Its
values are NULL. Same-day rows of a key are told apart by ``tie``. Rows without a day are
dropped; an empty table gives an empty panel.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallypanel.operators import spine
from tallypanel.operators.series import day_window


@dataclass(frozen=True)
class Gaps:
    """Rows from day ``_from`` to day ``_to``; ``late`` are columns that only cells have."""

    df: DataFrame
    keys: tuple[str, ...]
    ts: str
    tie: tuple[str, ...]
    days: DataFrame
    late: Mapping[str, Column] = field(default_factory=dict)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy("_from", *self.tie)


def with_gaps(
    df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = (), seed_days: int = 1
) -> Gaps:
    """The panel of ``spine.complete_panel`` with its absent cells as stretches. One shuffle by
    ``keys``. ``df`` is read for its days and for its rows."""
    days = spine.observed_days(df, ts, seed_days)
    following = F.lead(ts).over(Window.orderBy(ts))
    days = days.select(ts, "_slot", following.alias("_following"))
    first, last = df.agg(F.min(ts), F.max(ts)).first()
    seed = F.date_sub(F.lit(first).cast("date"), seed_days)
    end = F.lit(last).cast("date")
    w = day_window(keys, ts, tie)
    row = df.dropna(subset=[ts]).withColumns(
        {"_at": F.row_number().over(w), "_next": F.coalesce(F.lead(ts).over(w), F.date_add(end, 1))}
    )

    def piece(start: Column, stop: Column, present: bool) -> Column:
        return F.struct(start.alias("_from"), stop.alias("_to"), F.lit(present).alias("_present"))

    day = F.col(ts)
    before = piece(seed, F.date_sub(day, 1), False)
    after = piece(F.date_add(day, 1), F.date_sub("_next", 1), False)
    pieces = F.array(F.when(F.col("_at") == 1, before), piece(day, day, True), after)
    # Same-day rows and rows of successive days have nothing between them.
    some = F.filter(pieces, lambda p: p["_from"] <= p["_to"])
    wide = row.withColumn("_piece", F.explode(some)).select(*df.columns, "_piece.*")
    own = [
        F.col(c) if c in keys else F.when(F.col("_present"), F.col(c)).alias(c)
        for c in df.columns
        if c != ts
    ]
    return Gaps(wide.select(*own, "_from", "_to", "_present"), tuple(keys), ts, tuple(tie), days)


def fill_zero(g: Gaps, metrics: Sequence[str]) -> Gaps:
    """0 where absent or missing."""
    return replace(g, df=g.df.withColumns({m: F.coalesce(m, F.lit(0)) for m in metrics}))


def forward_fill(g: Gaps, metrics: Sequence[str]) -> Gaps:
    """The last known value where absent or missing; NULL before the first known one."""
    so_far = g.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = {m: F.last(m, ignorenulls=True).over(so_far) for m in metrics}
    return replace(g, df=g.df.withColumns(filled))


def onset_flag(g: Gaps, metric: str = "confirmed", out: str = "onset") -> Gaps:
    """True on a 0 cell right before a positive one of the key; absent and missing count as 0."""
    w = g.window()
    present = F.when(F.col("_present"), F.struct(F.col("_from"), F.col(metric).alias("value")))
    # Two stretches never follow each other.
    upcoming = F.coalesce(F.lead(present).over(w), F.lead(present, 2).over(w))
    zero = F.coalesce(F.col(metric), F.lit(0)) == 0
    rise, held = f"_rise_{out}", f"_upcoming_{out}"
    rows = g.df.withColumn(held, upcoming)
    rows = rows.withColumn(
        rise, F.when(zero & (F.col(held)["value"] > 0), F.col(held)["_from"])
    ).drop(held)
    # The next positive row is of the next observed day, or of the same day.
    flag = F.coalesce(F.col(rise).isin(F.col("_following"), F.col(g.ts)), F.lit(False))
    return replace(g, df=rows, late={**g.late, out: flag})


def day_number(g: Gaps, out: str = "Days") -> Gaps:
    """Position of the cell within its key, from 0: the place of its day, and further same-day
    rows before it."""
    w = g.window()
    again = F.coalesce((F.lag("_from").over(w) == F.col("_from")).cast("int"), F.lit(0))
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    extra = f"_extra_{out}"
    rows = g.df.withColumn("_again", again).withColumn(extra, F.sum("_again").over(so_far))
    number = (F.col("_slot") + F.col(extra)).cast("int")
    return replace(g, df=rows.drop("_again"), late={**g.late, out: number})


def expand(g: Gaps) -> DataFrame:
    """One row per key and observed day (and tie), the seed day included."""
    kept = [c for c in g.df.columns if not c.startswith("_")]
    cells = g.df.withColumn(g.ts, F.explode(F.sequence("_from", "_to")))
    dated = cells.join(F.broadcast(g.days), g.ts)
    return dated.select(*kept, g.ts, *[c.alias(name) for name, c in g.late.items()])


def stretches(g: Gaps, first: str = "first_day", last: str = "last_day") -> DataFrame:
    """The ranges of the calendar without a row of the key."""
    absent = g.df.where(~F.col("_present"))
    return absent.select(*g.keys, F.col("_from").alias(first), F.col("_to").alias(last))
