"""Data-quality tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallypanel.functions.days import run_time_label
from tallypanel.functions.numbers import delta_name
from tallypanel.functions.text import thousands


def negative_deltas(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Rows with a negative delta, per metric and in all: the value of the repair's exit test."""
    counts = df.agg(*[F.count_if(F.col(delta_name(m)) < 0).alias(m) for m in metrics])
    total = reduce(lambda a, b: a + b, [F.col(m) for m in metrics])
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("rows")) for m in metrics]
    rows.append(F.struct(F.lit("all").alias("metric"), total.alias("rows")))
    return counts.select(F.inline(F.array(*rows)))


def negative_rows(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The rows with any negative delta."""
    return df.where(reduce(lambda a, b: a | b, [F.col(delta_name(m)) < 0 for m in metrics]))


def reconcile(
    df: DataFrame, ts: str, metrics: Sequence[str], tolerance: float = 0.0
) -> DataFrame:
    """Per metric, the cumulative total of the last day against the total of all deltas.

    Sums per day first, so the last day is found among daily totals in the same pass.
    """
    daily = df.groupBy(ts).agg(
        *[F.sum(m).alias(m) for m in metrics],
        *[F.sum(delta_name(m)).alias(delta_name(m)) for m in metrics],
    )
    totals = daily.agg(
        *[F.coalesce(F.max_by(m, ts), F.lit(0)).alias(m) for m in metrics],
        *[F.coalesce(F.sum(delta_name(m)), F.lit(0)).alias(delta_name(m)) for m in metrics],
    )
    rows = []
    for m in metrics:
        last, deltas = F.col(m).cast("double"), F.col(delta_name(m)).cast("double")
        rows.append(
            F.struct(
                F.lit(m).alias("metric"),
                last.alias("last_total"),
                deltas.alias("delta_total"),
                (F.abs(last - deltas) <= tolerance).alias("matched"),
            )
        )
    return totals.select(F.inline(F.array(*rows)))


def duplicate_days(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Keys and days with more than one row, and how many."""
    counts = df.groupBy(*keys, ts).agg(F.count("*").alias("rows"))
    return counts.where(F.col("rows") > 1)


def one_row_per_day(df: DataFrame, ts: str) -> DataFrame:
    """``df`` itself, failing the job if a day has two rows."""
    others = [c for c in df.columns if c != ts]
    daily = df.groupBy(ts).agg(F.count("*").alias("_rows"), *[F.max(c).alias(c) for c in others])
    text = F.concat(F.lit("two rows for the day "), F.coalesce(F.col(ts).cast("string"), F.lit("NULL")))
    checked = F.when(F.col("_rows") == 1, F.col(ts)).otherwise(F.raise_error(text).cast("date"))
    return daily.select(checked.alias(ts), *others).select(*df.columns)


def run_summary(
    tables: Mapping[str, DataFrame], ts: str, stamp: bool = False, metrics: Sequence[str] = ()
) -> DataFrame:
    """Per table, the line count (also as text), the last day and, with ``metrics``, the
    number of their negative deltas, with ``stamp`` the time of the run."""
    below = [F.count_if(F.col(delta_name(m)) < 0) for m in metrics]
    counts = [reduce(lambda a, b: a + b, below).alias("negative_deltas")] if below else []
    parts = [
        df.agg(F.count("*").alias("lines"), F.max(ts).alias("max_day"), *counts).select(
            F.lit(name).alias("dataset"),
            "lines",
            thousands(F.col("lines")).alias("lines_text"),
            "max_day",
            *["negative_deltas" for _ in counts],
        )
        for name, df in tables.items()
    ]
    summary = reduce(DataFrame.unionByName, parts)
    return summary.withColumn("run_at", run_time_label()) if stamp else summary


def observed(df: DataFrame, ts: str, metrics: Sequence[str] = ()) -> tuple[DataFrame, Observation]:
    """``df`` and the figures of a run's summary, taken while ``df`` is written: ``lines``,
    ``min_day``, ``max_day`` and, with ``metrics``, ``negative_deltas``. They are there once an
    action has run, and they are exact if nothing is shuffled between ``df`` and the sink."""
    below = [F.count_if(F.col(delta_name(m)) < 0) for m in metrics]
    counts = [reduce(lambda a, b: a + b, below).alias("negative_deltas")] if below else []
    seen = Observation()
    figures = [F.count(F.lit(1)).alias("lines"), F.min(ts).alias("min_day"), F.max(ts).alias("max_day")]
    return df.observe(seen, *figures, *counts), seen


def observed_summary(spark: SparkSession, figures: Mapping[str, Mapping], stamp: bool = False) -> DataFrame:
    """``run_summary`` from the figures of each table, which are a row per table; with what else
    they hold of whole numbers, such as rows set aside."""
    others = sorted({k for f in figures.values() for k in f} - {"lines", "min_day", "max_day"})
    rows = [(name, f["lines"], f["min_day"], f["max_day"], *[f.get(k) for k in others]) for name, f in figures.items()]
    schema = "dataset string, lines long, min_day date, max_day date" + "".join(f", {k} long" for k in others)
    told = spark.createDataFrame(rows, schema)
    summary = told.select("dataset", "lines", thousands(F.col("lines")).alias("lines_text"), "min_day", "max_day", *others)
    return summary.withColumn("run_at", run_time_label()) if stamp else summary
