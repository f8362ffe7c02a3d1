"""Queries on aggregations, windows and derived metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallypanel.functions.numbers import delta_name
from tallypanel.operators import aggregate as agg
from tallypanel.operators import quality, series, shape
from tallypanel.operators.spine import day_number
from tallypanel.plans.catalog import day_text, query
from tallypanel.plans.panels import (
    CUMULATIVE,
    DAY_SERIES,
    EVENT_ROWS,
    METRICS,
    SUMS,
    TS,
    cumulative_panel,
    day_series,
    event_panel,
    event_panel_sql,
    event_rows,
    table,
)
from tallypanel.session import materialize

KEY = ["event_type"]
W = "WINDOW w AS (PARTITION BY event_type ORDER BY timestamp)"
PANEL = event_panel_sql()


def _deltas_sql(window: str = "w") -> str:
    return ", ".join(f"coalesce({m} - lag({m}) OVER {window}, {m}) AS {delta_name(m)}" for m in METRICS)


@query("daily_totals", f"WITH {DAY_SERIES} SELECT {day_text()}, confirmed, recovered, deaths FROM series")
def daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.aggregate(event_rows(spark, sf_dir), [], TS, METRICS).orderBy(TS)


@query(
    "panel_bounds",
    f"""WITH {EVENT_ROWS} SELECT strftime(min(timestamp), '%m-%d-%Y') AS first_day,
  strftime(max(timestamp), '%m-%d-%Y') AS last_day,
  CAST(sum(confirmed) AS BIGINT) AS sum_confirmed, CAST(sum(recovered) AS BIGINT) AS sum_recovered,
  CAST(sum(deaths) AS BIGINT) AS sum_deaths FROM event_rows""",
)
def panel_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.bounds(event_rows(spark, sf_dir), TS, METRICS)


@query(
    "distinct_user_days",
    f"WITH {EVENT_ROWS} SELECT DISTINCT user_id, {day_text()} FROM event_rows",
)
def distinct_user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.distinct_values(event_rows(spark, sf_dir), "user_id", TS)


@query(
    "latest_day",
    f"""WITH {event_panel_sql(key="user_id")} SELECT user_id, {day_text()}, confirmed, recovered, deaths
FROM panel WHERE panel.timestamp = (SELECT max(timestamp) FROM event_rows)""",
)
def latest_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = agg.latest_rows(event_rows(spark, sf_dir), TS)
    return agg.aggregate(rows, ["user_id"], TS, METRICS)


@query(
    "deltas",
    f"""WITH {DAY_SERIES} SELECT {day_text()}, {_deltas_sql("w")} FROM series
WINDOW w AS (ORDER BY series.timestamp)""",
)
def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = series.add_deltas(day_series(spark, sf_dir), [], TS, METRICS)
    return df.select(TS, *[delta_name(m) for m in METRICS])


DELTAS = f"""{PANEL}, deltas AS (SELECT *, {_deltas_sql()} FROM panel {W})"""


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.add_deltas(event_panel(spark, sf_dir), KEY, TS, METRICS)


@query(
    "deltas_by_key",
    f"""WITH {DELTAS} SELECT event_type, {day_text()}, newConfirmed, newRecovered, newDeaths FROM deltas""",
)
def deltas_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deltas(spark, sf_dir).drop(*METRICS)


@query(
    "delta_direction",
    f"""WITH {DELTAS} SELECT event_type, {day_text()}, CASE WHEN newConfirmed < 0 THEN 'down'
  WHEN newConfirmed > 0 THEN 'up' ELSE 'same' END AS direction FROM deltas""",
)
def delta_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.col("newConfirmed")
    direction = F.when(new < 0, "down").when(new > 0, "up").otherwise("same")
    return _deltas(spark, sf_dir).select(*KEY, TS, direction.alias("direction"))


@query(
    "negative_rows",
    f"""WITH {DELTAS} SELECT event_type, {day_text()}, newConfirmed, newRecovered, newDeaths FROM deltas
WHERE newConfirmed < 0 OR newRecovered < 0 OR newDeaths < 0""",
)
def negative_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.negative_rows(_deltas(spark, sf_dir), METRICS).drop(*METRICS)


@query(
    "negative_deltas",
    f"""WITH {DELTAS}, counts AS (SELECT count(*) FILTER (WHERE newConfirmed < 0) AS c,
  count(*) FILTER (WHERE newRecovered < 0) AS r, count(*) FILTER (WHERE newDeaths < 0) AS d FROM deltas)
SELECT 'confirmed' AS metric, c AS rows FROM counts UNION ALL SELECT 'recovered', r FROM counts
UNION ALL SELECT 'deaths', d FROM counts UNION ALL SELECT 'all', c + r + d FROM counts""",
)
def negative_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.negative_deltas(_deltas(spark, sf_dir), METRICS)


@query(
    "neighbours",
    f"""WITH {PANEL} SELECT event_type, {day_text()}, lag(confirmed) OVER w AS previous,
  lead(confirmed) OVER w AS next, row_number() OVER w > 1 AS same_key
FROM panel WINDOW w AS (PARTITION BY event_type ORDER BY panel.timestamp)""",
)
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.neighbours(event_panel(spark, sf_dir), KEY, TS, "confirmed").drop(*METRICS)


def _growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = series.add_deltas(cumulative_panel(spark, sf_dir), KEY, TS, METRICS)
    return series.growth_rate(df, KEY, TS)


GROWTH = f"""{CUMULATIVE},
growth AS (SELECT event_type, timestamp, coalesce(confirmed - lag(confirmed) OVER w, confirmed) AS newConfirmed,
  coalesce(CAST(confirmed - lag(confirmed) OVER w AS DOUBLE) / nullif(lag(confirmed) OVER w, 0), 0.0) AS growthRate
  FROM panel {W}),
average AS (SELECT *, CASE WHEN count(*) OVER w7 = 7 THEN avg(growthRate) OVER w7 ELSE 0.0 END AS movingAvg
  FROM growth WINDOW w7 AS (PARTITION BY event_type ORDER BY timestamp ROWS 6 PRECEDING))"""

DOUBLING = """CASE WHEN movingAvg + 1 > 0 AND log10(movingAvg + 1) <> 0
  THEN CAST(round_even(log10(2) / log10(movingAvg + 1), 0) AS BIGINT) ELSE 0 END"""


@query(
    "growth_rate",
    f"WITH {GROWTH} SELECT event_type, {day_text()}, newConfirmed, round(growthRate, 6) AS growthRate FROM growth",
)
def growth_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _growth(spark, sf_dir).select(*KEY, TS, "newConfirmed", "growthRate")


@query(
    "moving_average",
    f"WITH {GROWTH} SELECT event_type, {day_text()}, round(movingAvg, 6) AS movingAvg FROM average",
)
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.moving_average(_growth(spark, sf_dir), KEY, TS).select(*KEY, TS, "movingAvg")


@query(
    "doubling_time",
    f"WITH {GROWTH} SELECT event_type, {day_text()}, {DOUBLING} AS doublingTime FROM average",
)
def doubling_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = series.moving_average(_growth(spark, sf_dir), KEY, TS)
    return series.doubling_time(df).select(*KEY, TS, "doublingTime")


@query(
    "repair_once",
    f"""WITH {PANEL}, marked AS (SELECT event_type, timestamp,
  CASE WHEN confirmed < lag(confirmed) OVER w THEN NULL ELSE confirmed END AS c,
  CASE WHEN recovered < lag(recovered) OVER w THEN NULL ELSE recovered END AS r,
  CASE WHEN deaths < lag(deaths) OVER w THEN NULL ELSE deaths END AS d FROM panel {W})
SELECT event_type, {day_text()}, last_value(c IGNORE NULLS) OVER u AS confirmed,
  last_value(r IGNORE NULLS) OVER u AS recovered, last_value(d IGNORE NULLS) OVER u AS deaths FROM marked
WINDOW u AS (PARTITION BY event_type ORDER BY marked.timestamp ROWS UNBOUNDED PRECEDING)""",
)
def repair_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.repair_once(event_panel(spark, sf_dir), KEY, TS, METRICS)


REPAIRED = f"""{PANEL},
repaired AS (SELECT event_type, timestamp, max(confirmed) OVER u AS confirmed, max(recovered) OVER u AS recovered,
  max(deaths) OVER u AS deaths FROM panel
  WINDOW u AS (PARTITION BY event_type ORDER BY timestamp ROWS UNBOUNDED PRECEDING))"""


@query(
    "repair_monotone",
    f"WITH {REPAIRED} SELECT event_type, {day_text()}, confirmed, recovered, deaths FROM repaired",
)
def repair_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.repair_monotone(event_panel(spark, sf_dir), KEY, TS, METRICS)


@query(
    "repaired_deltas",
    f"""WITH {REPAIRED}, deltas AS (SELECT *, {_deltas_sql()} FROM repaired {W})
SELECT event_type, {day_text()}, confirmed, recovered, deaths, newConfirmed, newRecovered, newDeaths FROM deltas""",
)
def repaired_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.repair_and_diff(event_panel(spark, sf_dir), KEY, TS, METRICS)


@query(
    "reconcile",
    f"""WITH {REPAIRED}, deltas AS (SELECT *, {_deltas_sql()} FROM repaired {W}),
last_day AS (SELECT CAST(sum(confirmed) AS DOUBLE) AS c, CAST(sum(recovered) AS DOUBLE) AS r,
  CAST(sum(deaths) AS DOUBLE) AS d FROM deltas WHERE timestamp = (SELECT max(timestamp) FROM deltas)),
total AS (SELECT CAST(sum(newConfirmed) AS DOUBLE) AS c, CAST(sum(newRecovered) AS DOUBLE) AS r,
  CAST(sum(newDeaths) AS DOUBLE) AS d FROM deltas),
pair AS (SELECT l.c AS lc, l.r AS lr, l.d AS ld, t.c AS tc, t.r AS tr, t.d AS td FROM last_day l, total t)
SELECT 'confirmed' AS metric, lc AS last_total, tc AS delta_total, lc = tc AS matched FROM pair
UNION ALL SELECT 'recovered', lr, tr, lr = tr FROM pair
UNION ALL SELECT 'deaths', ld, td, ld = td FROM pair""",
)
def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = series.repair_and_diff(event_panel(spark, sf_dir), KEY, TS, METRICS)
    return quality.reconcile(df, TS, METRICS)


@query(
    "run_summary",
    f"""WITH {EVENT_ROWS}, parts AS (
  SELECT 'events' AS dataset, count(*) AS lines, max(timestamp) AS max_day FROM event_rows UNION ALL
  SELECT 'orders', count(*), max(CAST(o_orderdate AS DATE)) FROM orders UNION ALL
  SELECT 'shipments', count(*), max(CAST(l_shipdate AS DATE)) FROM lineitem)
SELECT dataset, lines, format('{{:,}}', lines) AS lines_text, {day_text("max_day")} FROM parts""",
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias(TS))
    shipments = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias(TS))
    tables = {"events": event_rows(spark, sf_dir), "orders": orders, "shipments": shipments}
    return quality.run_summary(tables, TS)


@query(
    "observed_summary",
    f"""WITH {EVENT_ROWS}, parts AS (
  SELECT 'events' AS dataset, count(*) AS lines, min(timestamp) AS min_day, max(timestamp) AS max_day FROM event_rows UNION ALL
  SELECT 'orders', count(*), min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)) FROM orders)
SELECT dataset, lines, format('{{:,}}', lines) AS lines_text, {day_text("min_day")}, {day_text("max_day")} FROM parts""",
)
def observed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary from figures taken while the tables are written."""
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias(TS))
    figures = {}
    for name, df in (("events", event_rows(spark, sf_dir)), ("orders", orders)):
        written, seen = quality.observed(df, TS)
        materialize(written, name)
        figures[name] = seen.get
    return quality.observed_summary(spark, figures)


@query(
    "duplicate_days",
    f"""WITH {EVENT_ROWS} SELECT user_id, {day_text()}, count(*) AS rows FROM event_rows
GROUP BY user_id, event_rows.timestamp HAVING count(*) > 1""",
)
def duplicate_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_days(event_rows(spark, sf_dir), ["user_id"], TS)


@query(
    "active",
    f"WITH {PANEL} SELECT event_type, {day_text()}, confirmed - deaths - recovered AS active FROM panel",
)
def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.balance(event_panel(spark, sf_dir)).select(*KEY, TS, "active")


@query(
    "series_day_number",
    f"""WITH {DAY_SERIES} SELECT {day_text()}, confirmed,
  CAST(row_number() OVER (ORDER BY series.timestamp) - 1 AS INTEGER) AS "Days" FROM series""",
)
def series_day_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day_number(day_series(spark, sf_dir).select(TS, "confirmed"), [], TS)


@query(
    "sorted_panel",
    f"WITH {event_panel_sql(key='user_id')} SELECT user_id, {day_text()}, confirmed FROM panel ORDER BY user_id, panel.timestamp",
)
def sorted_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_panel(spark, sf_dir, "user_id").select("user_id", TS, "confirmed").orderBy("user_id", TS)


@query(
    "union_sources",
    f"""WITH {EVENT_ROWS}
SELECT 'event' AS source, {day_text()}, {SUMS} FROM event_rows GROUP BY event_rows.timestamp
UNION ALL SELECT 'order', strftime(o_orderdate, '%m-%d-%Y'), count(*), 0, 0 FROM orders GROUP BY o_orderdate""",
)
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = day_series(spark, sf_dir).withColumn("source", F.lit("event"))
    orders = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias(TS))
    counted = orders.agg(F.count("*").alias("confirmed")).withColumn("source", F.lit("order"))
    return shape.fill_zero(events.unionByName(counted, allowMissingColumns=True))
