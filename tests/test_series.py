import pytest
from helpers import (
    METRICS,
    SERIES,
    average,
    column,
    deltas,
    doubling,
    growth,
    panel,
    random_series,
    repair_pass,
)
from pyspark.sql import functions as F

from tallypanel.operators import quality, series

KEY = ["key"]


def present(values):
    return [None if v is None else float(v) for v in values if v != "absent"]


def repaired(values):
    """Passes until no value decreases, as the iterated repair runs."""
    values = present(values)
    while any(d < 0 for d in deltas(values)[1:]):
        values = repair_pass(values)
    return values


def test_deltas(spark):
    df = series.add_deltas(panel(spark), KEY, "ts", METRICS)
    for key, values in SERIES.items():
        assert column(df, key, "newConfirmed") == deltas(present(values)), key


def test_repair_once_follows_the_pass(spark):
    df = series.repair_once(panel(spark), KEY, "ts", METRICS)
    for key, values in SERIES.items():
        assert column(df, key, "confirmed") == repair_pass(present(values)), key
    assert column(df, "d", "confirmed") == [5, 5, 5, 5, 8]
    assert df.columns == ["key", "ts", *METRICS]


def test_repair_monotone_by_hand(spark):
    df = series.repair_monotone(panel(spark), KEY, "ts", METRICS)
    assert column(df, "b", "confirmed") == [10, 10, 10, 12]
    # Missing values are passed over (the iterated form would also lose the 7).
    assert column(df, "d", "confirmed") == [5, 5, 7, 7, 8]
    # A negative start ends here, where the iterated form would run forever.
    assert column(df, "e", "confirmed") == [-1, 0]


@pytest.mark.parametrize("seed", range(4))
def test_repair_monotone_is_the_end_of_the_passes(spark, seed):
    data = random_series(seed, keys=30, days=20)
    df = series.repair_monotone(panel(spark, data), KEY, "ts", ["confirmed"]).orderBy("key", "ts")
    got = {}
    for r in df.collect():
        got.setdefault(r["key"], []).append(r["confirmed"])
    assert got == {k: repaired(v) for k, v in data.items()}


def test_repair_and_diff_is_both_steps(spark):
    data = panel(spark)
    both = series.repair_and_diff(data, KEY, "ts", METRICS, growth_of="confirmed")
    steps = series.add_deltas(series.repair_monotone(data, KEY, "ts", METRICS), KEY, "ts", METRICS)
    steps = series.growth_rate(steps, KEY, "ts")
    assert sorted(both.collect(), key=repr) == sorted(steps.select(both.columns).collect(), key=repr)


def test_growth_average_and_doubling(spark):
    df = series.repair_and_diff(panel(spark), KEY, "ts", METRICS)
    df = series.doubling_time(series.moving_average(series.growth_rate(df, KEY, "ts"), KEY, "ts"))
    for key in "abcg":
        values = repaired(SERIES[key])
        rates = average(growth(values))
        assert column(df, key, "growthRate") == growth(values), key
        assert column(df, key, "movingAvg") == pytest.approx(rates, abs=1e-12), key
        assert column(df, key, "doublingTime") == [doubling(r) for r in rates], key
    assert column(df, "g", "doublingTime") == [0] * 8


def test_moving_average_needs_n_values(spark):
    data = panel(spark, {"a": [1, 2, 3, None, 5, 6, 7]})
    df = series.moving_average(data, KEY, "ts", "confirmed", n=3)
    assert column(df, "a", "movingAvg") == [0, 0, 2, 0, 0, 0, 6]


def test_forward_fill(spark):
    data = panel(spark, {"a": [None, 1, None, None, 2, None], "b": [None, None]})
    df = series.forward_fill(data, KEY, "ts", ["confirmed"])
    assert column(df, "a", "confirmed") == [None, 1, 1, 1, 2, 2]
    assert column(df, "b", "confirmed") == [None, None]


def test_neighbours(spark):
    df = series.neighbours(panel(spark, {"a": [1, 2, 3], "b": [4]}), KEY, "ts", "confirmed")
    assert column(df, "a", "previous") == [None, 1, 2]
    assert column(df, "a", "next") == [2, 3, None]
    assert column(df, "a", "same_key") == [False, True, True]
    assert column(df, "b", "same_key") == [False]


def test_negative_deltas_and_reconcile(spark):
    raw = series.add_deltas(panel(spark, {"b": [10, 8, 9, 12], "e": [-1, 0, 0, 0]}), KEY, "ts", METRICS)
    counts = {r["metric"]: r["rows"] for r in quality.negative_deltas(raw, METRICS).collect()}
    assert counts == {"confirmed": 2, "recovered": 2, "deaths": 2, "all": 6}
    assert quality.negative_rows(raw, METRICS).count() == 2

    fixed = series.repair_and_diff(raw.select("key", "ts", *METRICS), KEY, "ts", METRICS)
    again = {r["metric"]: r["rows"] for r in quality.negative_deltas(fixed, METRICS).collect()}
    assert again["confirmed"] == 1  # the negative start stays visible
    report = {r["metric"]: r for r in quality.reconcile(fixed, "ts", METRICS).collect()}
    assert report["confirmed"]["matched"] and report["confirmed"]["last_total"] == 12

    broken = fixed.withColumn("newDeaths", F.col("newDeaths") + 1)
    report = {r["metric"]: r["matched"] for r in quality.reconcile(broken, "ts", METRICS).collect()}
    assert report == {"confirmed": True, "recovered": True, "deaths": False}


@pytest.mark.parametrize("seed", range(3))
def test_no_negative_delta_after_repair(spark, seed):
    df = series.repair_and_diff(panel(spark, random_series(seed)), KEY, "ts", METRICS)
    counts = {r["metric"]: r["rows"] for r in quality.negative_deltas(df, METRICS).collect()}
    assert counts["all"] == 0


def test_duplicate_days_and_summary(spark):
    data = panel(spark, {"a": [1, 2], "b": [3]})
    twice = data.union(data.where("key = 'b'"))
    assert [(r["key"], r["rows"]) for r in quality.duplicate_days(twice, KEY, "ts").collect()] == [("b", 2)]
    summary = quality.run_summary({"one": data, "two": twice}, "ts").orderBy("dataset").collect()
    assert [(r["dataset"], r["lines"], r["lines_text"]) for r in summary] == [("one", 3, "3"), ("two", 4, "4")]
    assert str(summary[0]["max_day"]) == "2020-01-23"
