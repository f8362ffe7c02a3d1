import random

import pytest
from helpers import panel, random_series
from pyspark.sql import functions as F

from tallypanel.operators import gaps, series, spine

KEYS = ["key"]


def ordered(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def rows_of(spark, seed):
    """Gaps, some days that nobody has, missing values, a NULL key, same-day rows."""
    rng = random.Random(seed)
    one = panel(spark, random_series(seed, days=25)).withColumn("tie", F.lit(1))
    two = panel(spark, random_series(seed + 9, days=25)).where("key = 'k1'").withColumn("tie", F.lit(2))
    rows = one.union(two).where(~F.dayofmonth("ts").isin(rng.sample(range(1, 32), 8)))
    rows = rows.withColumn("key", F.when(F.col("key") != "k2", F.col("key")))
    return rows.withColumn("confirmed", F.when(F.col("confirmed") != 3, F.col("confirmed")))


@pytest.mark.parametrize("seed", range(4))
def test_cells_equal_the_completed_panel(spark, seed):
    rows = rows_of(spark, seed)
    full = spine.complete_panel(rows, KEYS, "ts", tie=["tie"])
    full = spine.onset_flag(full, KEYS, "ts", "confirmed", tie=["tie"])
    want = spine.day_number(full, KEYS, "ts", tie=["tie"])
    g = gaps.with_gaps(rows, KEYS, "ts", ["tie"])
    g = gaps.day_number(gaps.onset_flag(g))
    g = gaps.fill_zero(g, ["confirmed", "recovered", "deaths", "tie"])
    assert ordered(gaps.expand(g).select(*want.columns)) == ordered(want)


def test_absent_days_carry_the_last_value(spark):
    rows = rows_of(spark, 1)
    bare = spine.spine(rows.select("key", "ts"), KEYS, "ts").alias("d")
    same = F.col("d.key").eqNullSafe(F.col("r.key")) & (F.col("d.ts") == F.col("r.ts"))
    cells = bare.join(rows.alias("r"), same, "left").select("d.key", "d.ts", "tie", "confirmed")
    want = series.forward_fill(cells, KEYS, "ts", ["confirmed"], tie=["tie"])
    g = gaps.forward_fill(gaps.with_gaps(rows, KEYS, "ts", ["tie"]), ["confirmed"])
    assert ordered(gaps.expand(g).select(*want.columns)) == ordered(want)


def test_at_most_two_rows_per_present_row_and_one_per_key(spark):
    rows = panel(spark, {"a": [1, *["absent"] * 900, 2], "b": [0, *["absent"] * 5, 3, 4]})
    g = gaps.with_gaps(rows, KEYS, "ts")
    assert g.df.count() <= 2 * rows.count() + 2
    want = {("a", "2020-01-21", "2020-01-21"), ("a", "2020-01-23", "2022-07-10"), ("b", "2020-01-21", "2020-01-21")}
    found = {tuple(map(str, r)) for r in gaps.stretches(g).collect()}
    assert want <= found and len(found) == 5


def test_cells_are_written_last_and_days_broadcast_once(spark):
    g = gaps.onset_flag(gaps.with_gaps(rows_of(spark, 2), KEYS, "ts", ["tie"]))
    plan = gaps.expand(gaps.forward_fill(g, ["confirmed"]))._jdf.queryExecution().executedPlan()
    lines = plan.toString().splitlines()
    assert sum("BroadcastExchange" in line for line in lines) == 1
    sequence = next(i for i, line in enumerate(lines) if "Generate explode(sequence" in line)
    windows = [i for i, line in enumerate(lines) if "Window [" in line and "key" in line]
    assert windows and all(i > sequence for i in windows)


def test_no_rows(spark):
    none = panel(spark, {"a": [1]}).where("false")
    g = gaps.day_number(gaps.onset_flag(gaps.with_gaps(none, KEYS, "ts")))
    assert gaps.expand(g).collect() == []
