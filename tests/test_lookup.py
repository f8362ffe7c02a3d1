import random

import pytest
from pyspark.sql import functions as F

from tallypanel.operators import aggregate, lookup


def fact(spark, rows=4000, seed=3):
    """A third of the rows has one key, a tenth has none."""
    rng = random.Random(seed)
    data = []
    for i in range(rows):
        r = rng.random()
        key = "hot" if r < 1 / 3 else None if r < 0.43 else f"k{rng.randint(0, 300)}"
        data.append((key, i, float(i % 7)))
    return spark.createDataFrame(data, "key string, id long, value double")


def dimension(spark):
    rows = [(f"k{i}", i, f"name {i}") for i in range(0, 300, 2)] + [("hot", -1, "hot name")]
    return spark.createDataFrame(rows, "key string, number long, name string")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_both_ways_of_the_join_agree(spark):
    small = lookup.add_dimension(fact(spark), dimension(spark), ["key"])
    large = lookup.add_dimension(fact(spark), dimension(spark), ["key"], max_bytes=0)
    plain = fact(spark).join(dimension(spark), "key", "left")
    assert small.columns == large.columns == plain.columns
    assert rows_of(small) == rows_of(large) == rows_of(plain)


def test_large_join_is_a_shuffled_one(spark):
    joined = lookup.left_join(fact(spark), dimension(spark), ["key"], max_bytes=0)
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_equal_rows_of_a_hot_key_are_spread(spark):
    settings = {
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k) for k in settings}
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 100 == 0, F.concat(F.lit("k"), F.col("id") % 7)).otherwise("hot").alias("key"),
        F.lit(1).alias("flag"),
    )
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = lookup.left_join(rows.repartition(16), dimension(spark), ["key"], max_bytes=0)
        joined = joined.withColumn("part", F.spark_partition_id())
        parts = {r["part"] for r in joined.collect() if r["key"] == "hot"}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(parts) > 4


def test_measured_bytes_grow_with_text(spark):
    short = spark.createDataFrame([("a",)] * 10, "v string")
    long = spark.createDataFrame([("a" * 1000,)] * 10, "v string")
    assert lookup.measured_bytes(long) - lookup.measured_bytes(short) == 9990
    nested = spark.createDataFrame([(["a" * 1000],)], "v array<string>")
    assert lookup.measured_bytes(nested) > 1000


@pytest.mark.parametrize("max_bytes", [0, lookup.BROADCAST_BYTES])
def test_standardize_falls_back_to_the_name(spark, max_bytes):
    names = spark.createDataFrame([("f#", "f"), ("x", "y")], "current string, subs string")
    rows = spark.createDataFrame(
        [("f#", 1, 3), ("f", 1, 4), ("g", 1, 5), (None, 1, 6)], "state string, day int, confirmed long"
    )
    named = lookup.standardize(rows, "state", names, max_bytes=max_bytes)
    assert named.columns == rows.columns
    assert rows_of(named) == sorted([("f", 1, 3), ("f", 1, 4), ("g", 1, 5), (None, 1, 6)], key=repr)
    totals = aggregate.aggregate(named, ["state"], "day", ["confirmed"])
    assert rows_of(totals) == [("f", 1, 7), ("g", 1, 5)]


def test_last_row_wins(spark):
    rows = spark.createDataFrame(
        [("a", "first", 1), ("a", "second", 2), ("b", "only", 1), (None, "x", 1)],
        "current string, subs string, at int",
    )
    assert rows_of(lookup.unique_lookup(rows, "current", "subs", ["at"])) == [("a", "second"), ("b", "only")]


def test_sum_of_missing_values_is_zero(spark):
    rows = spark.createDataFrame(
        [("a", 1, None), ("a", 1, None), ("b", None, 5)], "key string, day int, m long"
    )
    assert rows_of(aggregate.aggregate(rows, ["key"], "day", ["m"])) == [("a", 1, 0)]


def test_bounds_and_latest(spark):
    rows = spark.createDataFrame([(1, 5), (3, 7), (3, 8)], "day int, m long")
    assert tuple(aggregate.bounds(rows, "day", ["m"]).first()) == (1, 3, 20)
    assert rows_of(aggregate.latest_rows(rows, "day")) == [(3, 7), (3, 8)]


def test_hot_groups(spark):
    assert rows_of(aggregate.hot_groups(fact(spark), ["key"], 1000)) == [("hot", 1335)]
    assert aggregate.hot_groups(fact(spark), ["key"], 4000).count() == 0
