"""Series of single events, where one key or none holds most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallypanel.operators import segmented
from tallypanel.plans.catalog import query
from tallypanel.plans.panels import table

ORDER = ["ts", "event_id"]
CENTS = "CAST(round(value * 100) AS BIGINT)"
BY_TYPE = "PARTITION BY event_type ORDER BY ts, event_id"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "event_type", F.round(F.col("value") * 100).cast("long").alias("confirmed")
    )


def _segments(spark: SparkSession, sf_dir: str, keys: list[str]) -> segmented.Segments:
    return segmented.segment(_events(spark, sf_dir), keys, ORDER)


@query(
    "raw_deltas",
    f"""SELECT event_id, c AS confirmed, coalesce(c - lag(c) OVER w, c) AS newConfirmed,
  round(coalesce(CAST(c - lag(c) OVER w AS DOUBLE) / nullif(lag(c) OVER w, 0), 0.0), 6) AS growthRate
FROM (SELECT *, {CENTS} AS c FROM events) WINDOW w AS (ORDER BY ts, event_id)""",
)
def raw_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = segmented.deltas_and_growth(_segments(spark, sf_dir, []), "confirmed").df
    return df.select("event_id", "confirmed", "newConfirmed", "growthRate")


@query(
    "raw_repair",
    f"SELECT event_id, event_type, max({CENTS}) OVER ({BY_TYPE} ROWS UNBOUNDED PRECEDING) AS confirmed FROM events",
)
def raw_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = segmented.repair_monotone(_segments(spark, sf_dir, ["event_type"]), "confirmed").df
    return df.select("event_id", "event_type", "confirmed")


@query(
    "raw_forward_fill",
    f"""WITH marked AS (SELECT event_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE {CENTS} END AS c FROM events),
filled AS (SELECT event_id, last_value(c IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS c FROM marked)
SELECT event_id, coalesce(c, -1) AS confirmed FROM filled""",
)
def raw_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors have no value of their own."""
    value = F.when(F.col("event_type") != "error", F.col("confirmed"))
    marked = _events(spark, sf_dir).withColumn("confirmed", value)
    filled = segmented.forward_fill(segmented.segment(marked, [], ORDER), "confirmed")
    return filled.df.select("event_id", F.coalesce("confirmed", F.lit(-1)).alias("confirmed"))


@query(
    "raw_day_number",
    f"""SELECT event_id, event_type, row_number() OVER ({BY_TYPE}) - 1 AS "Days" FROM events""",
)
def raw_day_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = segmented.day_number(_segments(spark, sf_dir, ["event_type"])).df
    return df.select("event_id", "event_type", "Days")


@query(
    "raw_moving_average",
    f"""WITH prices AS (SELECT event_id, event_type, ts, CAST({CENTS} AS DOUBLE) AS c FROM events)
SELECT event_id, event_type, round(CASE WHEN count(*) OVER w7 = 7 THEN sum(c) OVER w7 / 7 ELSE 0.0 END, 6) AS "movingAvg"
FROM prices WINDOW w7 AS ({BY_TYPE} ROWS 6 PRECEDING)""",
)
def raw_moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _events(spark, sf_dir).withColumn("confirmed", F.col("confirmed").cast("double"))
    segments = segmented.segment(values, ["event_type"], ORDER)
    df = segmented.moving_average(segments, "confirmed").df
    return df.select("event_id", "event_type", "movingAvg")
