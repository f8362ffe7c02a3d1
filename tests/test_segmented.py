import random

import pytest
from helpers import panel, random_series
from pyspark.sql import functions as F

from tallypanel.operators import segmented, series, spine

ORDER = ["t", "id"]


def events(spark, seed=5, rows=600):
    """One key has most rows, some keys have one, one key is missing; ties in ``t``."""
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        r = rng.random()
        key = "hot" if r < 0.6 else None if r < 0.65 else f"k{rng.randint(0, 40)}"
        value = None if rng.random() < 0.1 else float(rng.randint(0, 50))
        data.append((key, rng.randint(0, 60), i, value))
    return spark.createDataFrame(data, "key string, t int, id int, confirmed double")


def by_id(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in df.select("id", *columns).collect()}


CASES = [(keys, n) for keys in ([], ["key"]) for n in (1, 4, 40)]


@pytest.fixture(params=CASES, ids=lambda c: f"{'keyed' if c[0] else 'keyless'}-{c[1]}")
def case(request, spark):
    keys, n = request.param
    return events(spark), keys, segmented.segment(events(spark), keys, ORDER, segments=n)


def test_segments_are_balanced(spark):
    s = segmented.segment(events(spark, rows=4000), ["key"], ORDER, segments=8)
    sizes = [r["count"] for r in s.df.groupBy("_segment").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * 4000 / 8


def test_deltas_and_growth(case):
    df, keys, s = case
    plain = series.add_deltas(df, keys, "t", ["confirmed"], tie=["id"])
    plain = series.growth_rate(plain, keys, "t", tie=["id"])
    got = segmented.deltas_and_growth(s, "confirmed").df
    assert by_id(got, "newConfirmed", "growthRate") == by_id(plain, "newConfirmed", "growthRate")


def test_repair(case):
    df, keys, s = case
    plain = series.repair_monotone(df, keys, "t", ["confirmed"], tie=["id"])
    assert by_id(segmented.repair_monotone(s, "confirmed").df, "confirmed") == by_id(plain, "confirmed")


def test_forward_fill(case):
    df, keys, s = case
    plain = series.forward_fill(df, keys, "t", ["confirmed"], tie=["id"])
    assert by_id(segmented.forward_fill(s, "confirmed").df, "confirmed") == by_id(plain, "confirmed")


def test_day_number(case):
    df, keys, s = case
    plain = spine.day_number(df, keys, "t", tie=["id"])
    assert by_id(segmented.day_number(s).df, "Days") == by_id(plain, "Days")


@pytest.mark.parametrize("n", [2, 7, 30])
def test_moving_average(case, n):
    df, keys, s = case
    plain = series.moving_average(df, keys, "t", "confirmed", n=n, tie=["id"])
    got = by_id(segmented.moving_average(s, "confirmed", n=n).df, "movingAvg")
    want = by_id(plain, "movingAvg")
    assert got.keys() == want.keys()
    assert got == want


def test_segments_grow_with_the_rows(spark):
    per = segmented.ROWS_PER_SEGMENT
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert segmented.segments_for(spark, 0) == segmented.segments_for(spark, per) == tasks
    assert [segmented.segments_for(spark, per * n) for n in (100, 10**6)] == [100, 10**6]


@pytest.mark.parametrize("n", [1, 3, 25])
@pytest.mark.parametrize("seed", range(3))
def test_trim_across_segments(spark, n, seed):
    one = panel(spark, random_series(seed, days=25)).withColumn("tie", F.lit(1))
    two = panel(spark, random_series(seed + 50, days=25)).withColumn("tie", F.lit(2))
    rows = one.union(two.where("key IN ('k1', 'k2')"))
    placed = spine.with_previous_day(rows, "ts", spine.observed_days(rows, "ts"), "prev")
    want = spine.complete_and_trim(placed, ["key"], "ts", tie=["tie"], previous="prev")
    s = segmented.segment(placed, ["key"], ["ts", "tie"], segments=n)
    got = segmented.complete_and_trim(s, "ts", "prev")
    assert dict(got.dtypes)["Days"] == "bigint"
    got = got.withColumn("Days", F.col("Days").cast("int"))
    assert got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_repair_of_several_metrics(case):
    df, keys, s = case
    df = df.withColumn("deaths", F.floor(F.col("confirmed") / 3))
    s = s.with_rows(s.df.withColumn("deaths", F.floor(F.col("confirmed") / 3)))
    metrics = ["confirmed", "deaths"]
    plain = series.repair_and_diff(df, keys, "t", metrics, ["id"], growth_of="confirmed")
    got = segmented.repair_and_diff(s, metrics, growth_of="confirmed").df
    columns = [*metrics, "newConfirmed", "newDeaths", "growthRate"]
    assert by_id(got, *columns) == by_id(plain, *columns)


def test_chain_over_fixed_rows(spark):
    df = events(spark)
    s = segmented.segment(df, ["key"], ORDER, segments=6)
    s = segmented.repair_monotone(s, "confirmed").fixed()
    s = segmented.moving_average(segmented.deltas_and_growth(s, "confirmed").fixed())
    plain = series.repair_and_diff(df, ["key"], "t", ["confirmed"], tie=["id"])
    plain = series.growth_rate(plain, ["key"], "t", tie=["id"])
    plain = series.moving_average(plain, ["key"], "t", tie=["id"])
    want, got = by_id(plain, "movingAvg"), by_id(s.df, "movingAvg")
    assert got == want


def test_passed_on_rows_are_fewer_than_segments(spark):
    s = segmented.segment(events(spark), ["key"], ORDER, segments=10)
    passed = s.passed_on([F.count("*").alias("_n")], {"_carry": F.sum("_n").over(s.earlier())})
    assert 0 < passed.count() < 2 * 10


def long_series(seed, missing):
    """Late onsets, gaps and decreases; with ``missing`` also unknown and negative values."""
    rng = random.Random(seed)
    choices = [0, 0, 0, 1, 2, 5, 9] + ([None, None, -1, -3] if missing else [])
    series_of = {}
    for k in range(7):
        late = rng.randint(0, 25)
        values = [
            "absent" if rng.random() < 0.3 else (rng.choice(choices[:3] + choices[7:]) if d < late else rng.choice(choices))
            for d in range(30)
        ]
        series_of[f"k{k}"] = values if any(v != "absent" for v in values) else [0]
    return series_of


METRICS = ["confirmed", "recovered", "deaths"]


def plain_metrics(placed, n):
    df = series.repair_and_diff(placed, ["key"], "ts", METRICS, ["tie"], growth_of="confirmed")
    df = series.moving_average(df, ["key"], "ts", n=n, tie=["tie"])
    return spine.complete_and_trim(df, ["key"], "ts", tie=["tie"], previous="prev")


def ordered(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("missing", [False, True])
@pytest.mark.parametrize("segments,n", [(1, 7), (5, 3), (60, 7)])
@pytest.mark.parametrize("seed", range(2))
def test_fused_metrics_equal_the_plain_chain(spark, seed, segments, n, missing):
    """60 segments leave each about three rows, so carries reach over many."""
    one = panel(spark, long_series(seed, missing)).withColumn("tie", F.lit(1))
    two = panel(spark, long_series(seed + 50, missing)).withColumn("tie", F.lit(2))
    rows = one.union(two.where("key IN ('k1', 'k2')"))
    rows = rows.withColumn("key", F.when(F.col("key") != "k3", F.col("key")))
    placed = spine.with_previous_day(rows, "ts", spine.observed_days(rows, "ts"), "prev")
    s = segmented.segment(placed, ["key"], ["ts", "tie"], segments=segments)
    got = segmented.metrics_and_trim(s, "ts", "prev", METRICS, n=n)
    got = got.withColumn("Days", F.col("Days").cast("int"))
    assert ordered(got) == ordered(plain_metrics(placed, n).select(*got.columns))


def test_fused_metrics_of_no_rows(spark):
    none = panel(spark, {"a": [1]}).where("false").withColumn("prev", F.col("ts"))
    s = segmented.segment(none, ["key"], ["ts"], segments=3)
    assert segmented.metrics_and_trim(s, "ts", "prev", METRICS).collect() == []


def test_carries_of_many_segments_are_joined_by_shuffle(spark, monkeypatch):
    rows = panel(spark, long_series(3, True)).withColumn("tie", F.lit(1))
    placed = spine.with_previous_day(rows, "ts", spine.observed_days(rows, "ts"), "prev")
    s = segmented.segment(placed, ["key"], ["ts", "tie"], segments=9)
    want = ordered(segmented.metrics_and_trim(s, "ts", "prev", METRICS))
    monkeypatch.setattr(segmented, "BROADCAST_SEGMENTS", 8)
    got = segmented.metrics_and_trim(s, "ts", "prev", METRICS)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert ordered(got) == want
