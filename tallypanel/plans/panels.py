"""Panels made from the given tables, and the same panels as SQL common table expressions.

Money is counted in whole cents, so sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallypanel.operators.lookup import add_dimension

TS = "timestamp"
METRICS = ["confirmed", "recovered", "deaths"]


# The columns of the given tables.
SCHEMAS = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "labels": "doc_id long, quality int, toxic int",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
    "l_linestatus string, l_shipdate timestamp_ntz",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is declared, so no file is opened to plan a query."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with its day and counters."""
    return table(spark, sf_dir, "events").select(
        "event_type",
        "user_id",
        F.to_date("ts").alias(TS),
        F.round(F.col("value") * 100).cast("long").alias("confirmed"),
        F.lit(1).cast("long").alias("recovered"),
        F.floor("value").alias("deaths"),
    )


EVENT_ROWS = """event_rows AS (
  SELECT event_type, user_id, CAST(ts AS DATE) AS timestamp,
         CAST(round(value * 100) AS BIGINT) AS confirmed, CAST(1 AS BIGINT) AS recovered,
         CAST(floor(value) AS BIGINT) AS deaths
  FROM events)"""

SUMS = """CAST(sum(confirmed) AS BIGINT) AS confirmed, CAST(sum(recovered) AS BIGINT) AS recovered,
         CAST(sum(deaths) AS BIGINT) AS deaths"""


def event_panel(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    """Events by ``key`` and day; daily sums, so they also decrease."""
    sums = [F.sum(m).alias(m) for m in METRICS]
    return event_rows(spark, sf_dir).groupBy(key, TS).agg(*sums)


def event_panel_sql(name: str = "panel", key: str = "event_type") -> str:
    return f"""{EVENT_ROWS},
{name} AS (SELECT {key}, timestamp, {SUMS} FROM event_rows GROUP BY 1, 2)"""


def cumulative_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of ``event_panel``: true cumulative counters."""
    w = Window.partitionBy("event_type").orderBy(TS)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return event_panel(spark, sf_dir).withColumns({m: F.sum(m).over(so_far) for m in METRICS})


CUMULATIVE = f"""{event_panel_sql("daily")},
panel AS (
  SELECT event_type, timestamp, CAST(sum(confirmed) OVER w AS BIGINT) AS confirmed,
         CAST(sum(recovered) OVER w AS BIGINT) AS recovered,
         CAST(sum(deaths) OVER w AS BIGINT) AS deaths
  FROM daily
  WINDOW w AS (PARTITION BY event_type ORDER BY timestamp ROWS UNBOUNDED PRECEDING))"""


def day_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day."""
    sums = [F.sum(m).alias(m) for m in METRICS]
    return event_rows(spark, sf_dir).groupBy(TS).agg(*sums)


DAY_SERIES = f"""{EVENT_ROWS},
series AS (SELECT timestamp, {SUMS} FROM event_rows GROUP BY 1)"""


def nation_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the customer's nation and day: all, finished and pending ones."""
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    homes = customer.join(nation, "n_nationkey", "left").drop("n_nationkey")
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias(TS)
    )
    named = add_dimension(orders, homes, ["o_custkey"])
    return named.groupBy("n_name", TS).agg(
        F.count("*").alias("confirmed"),
        F.count_if(F.col("o_orderstatus") == "F").alias("recovered"),
        F.count_if(F.col("o_orderstatus") == "P").alias("deaths"),
    )


NATION_ORDERS = """nation_orders AS (
  SELECT n_name, CAST(o_orderdate AS DATE) AS timestamp, count(*) AS confirmed,
         count(*) FILTER (WHERE o_orderstatus = 'F') AS recovered,
         count(*) FILTER (WHERE o_orderstatus = 'P') AS deaths
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2)"""
