"""Queries on completion, onset trim, fills and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallypanel.functions.numbers import round_half_even, safe_ratio
from tallypanel.operators import aggregate as agg
from tallypanel.operators import gaps, lookup, series, shape, spine
from tallypanel.plans.catalog import day_text, query
from tallypanel.plans.panels import (
    EVENT_ROWS,
    METRICS,
    NATION_ORDERS,
    SUMS,
    TS,
    event_panel,
    event_panel_sql,
    event_rows,
    nation_orders,
    table,
)

KEY = ["user_id"]
USERS = event_panel_sql(key="user_id")


def completed_sql(source: str, key: str, columns: str) -> str:
    """SQL for the completed panel of ``source``: each key with each day and the seed day."""
    filled = ", ".join(f"coalesce(s.{c}, 0) AS {c}" for c in columns.split())
    return f"""days AS (SELECT DISTINCT timestamp FROM {source}
  UNION ALL SELECT CAST(min(timestamp) - INTERVAL 1 DAY AS DATE) FROM {source}),
keys AS (SELECT DISTINCT {key} FROM {source}),
completed AS (SELECT k.{key}, d.timestamp, {filled} FROM keys k CROSS JOIN days d
  LEFT JOIN {source} s ON s.{key} = k.{key} AND s.timestamp = d.timestamp)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_panel(spark, sf_dir, "user_id")


COMPLETED = f"{USERS}, {completed_sql('panel', 'user_id', ' '.join(METRICS))}"


@query("panel_spine", f"WITH {COMPLETED} SELECT user_id, {day_text()} FROM completed")
def panel_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spine.spine(event_rows(spark, sf_dir), KEY, TS)


@query(
    "seeded_days",
    f"""WITH {EVENT_ROWS}, {completed_sql("event_rows", "user_id", "confirmed")}
SELECT DISTINCT {day_text()} FROM days""",
)
def seeded_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spine.seeded_days(event_rows(spark, sf_dir), TS)


@query(
    "complete_panel",
    f"WITH {COMPLETED} SELECT user_id, {day_text()}, confirmed, recovered, deaths FROM completed",
)
def complete_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spine.complete_panel(users(spark, sf_dir), KEY, TS)


@query(
    "complete_series",
    """WITH series AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS confirmed FROM orders GROUP BY 1),
days AS (SELECT DISTINCT day FROM series UNION ALL SELECT CAST(min(day) - INTERVAL 1 DAY AS DATE) FROM series)
SELECT strftime(day, '%m-%d-%Y') AS timestamp, coalesce(confirmed, 0) AS confirmed
FROM days LEFT JOIN series USING (day)""",
)
def complete_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias(TS))
    return spine.complete_series(orders.agg(F.count("*").alias("confirmed")), TS)


FLAGGED = f"""{COMPLETED},
flagged AS (SELECT *, coalesce(confirmed = 0 AND lead(confirmed) OVER w > 0, false) AS onset FROM completed
  WINDOW w AS (PARTITION BY user_id ORDER BY timestamp))"""
TRIMMED = f"""{FLAGGED},
trimmed AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY timestamp) - 1 AS INTEGER) AS "Days"
  FROM flagged WHERE onset OR confirmed > 0)"""


@query("onset_flag", f"WITH {FLAGGED} SELECT user_id, {day_text()}, onset FROM flagged")
def onset_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    completed = spine.complete_panel(users(spark, sf_dir), KEY, TS)
    return spine.onset_flag(completed, KEY, TS).select(*KEY, TS, "onset")


@query("onset_trim", f"""WITH {TRIMMED} SELECT user_id, {day_text()}, confirmed, "Days" FROM trimmed""")
def onset_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    trimmed = spine.complete_and_trim(users(spark, sf_dir).select(*KEY, TS, "confirmed"), KEY, TS)
    return trimmed.select(*KEY, TS, "confirmed", "Days")


@query(
    "complete_and_trim",
    f"""WITH {TRIMMED} SELECT user_id, {day_text()}, confirmed, recovered, deaths, "Days" FROM trimmed""",
)
def complete_and_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spine.complete_and_trim(users(spark, sf_dir), KEY, TS)


@query(
    "forward_fill",
    f"""WITH {COMPLETED}, gaps AS (SELECT user_id, timestamp, nullif(confirmed, 0) AS confirmed FROM completed),
filled AS (SELECT user_id, timestamp, last_value(confirmed IGNORE NULLS) OVER (PARTITION BY user_id
  ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS confirmed FROM gaps)
SELECT user_id, {day_text()}, confirmed, confirmed IS NULL AS unknown FROM filled""",
)
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    completed = spine.complete_panel(users(spark, sf_dir).select(*KEY, TS, "confirmed"), KEY, TS)
    gaps = completed.withColumn("confirmed", F.nullif("confirmed", F.lit(0)))
    filled = series.forward_fill(gaps, KEY, TS, ["confirmed"])
    return filled.withColumn("unknown", F.isnull("confirmed"))


@query(
    "panel_columns",
    f"""WITH {USERS} SELECT user_id AS state, {day_text()}, confirmed AS total, deaths, 'events' AS source FROM panel""",
)
def panel_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = shape.rename(users(spark, sf_dir), {"user_id": "state", "confirmed": "total"})
    kept = shape.drop_strict(renamed, ["recovered"]).withColumn("source", F.lit("events"))
    return kept.select("state", TS, "total", "deaths", "source")


@query(
    "fill_missing",
    """SELECT d.doc_id, coalesce(quality, 0) AS quality, coalesce(CAST(toxic AS VARCHAR), '') AS toxic_text,
  quality IS NULL AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", "quality", F.col("toxic").cast("string").alias("toxic_text")
    )
    joined = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    marked = joined.withColumn("missing", F.isnull("quality"))
    return shape.fill_blank(shape.fill_zero(marked, ["quality"]), ["toxic_text"])


@query(
    "null_token",
    """SELECT o_orderkey, nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority,
  coalesce(o_orderpriority = '4-NOT SPECIFIED', false) AS missing FROM orders""",
)
def null_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return shape.null_token(orders, "4-NOT SPECIFIED").withColumn(
        "missing", F.isnull("o_orderpriority")
    )


@query(
    "rounded_price",
    """SELECT o_orderkey, CAST(round_even(o_totalprice, 0) AS BIGINT) AS whole,
  round(log10(o_totalprice), 6) AS magnitude FROM orders""",
)
def rounded_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", round_half_even(price).alias("whole"), F.log10(price).alias("magnitude")
    )


@query(
    "safe_ratio",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round(coalesce(l_discount / nullif(l_tax, 0), 0.0), 6) AS ratio FROM lineitem""",
)
def discount_per_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = safe_ratio(F.col("l_discount"), F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ratio.alias("ratio")
    )


@query(
    "add_dimension",
    f"""WITH {NATION_ORDERS} SELECT o.n_name, {day_text("o.timestamp").replace("AS o.", "AS ")},
  confirmed, n_nationkey, n_regionkey FROM nation_orders o LEFT JOIN nation n ON o.n_name = n.n_name""",
)
def add_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = nation_orders(spark, sf_dir).select("n_name", TS, "confirmed")
    return lookup.add_dimension(daily, table(spark, sf_dir, "nation"), ["n_name"])


@query(
    "add_large_dimension",
    """SELECT p_brand, p_size, count(*) AS lines, round(sum(l_quantity), 6) AS quantity
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
)
def add_large_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way taken when the dimension is too large to broadcast."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), "l_quantity"
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    joined = lookup.add_dimension(lines, part, ["p_partkey"], max_bytes=0)
    return joined.groupBy("p_brand", "p_size").agg(
        F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity")
    )


# Names of event types that count as one.
TYPE_NAMES = [("click", "interaction"), ("view", "interaction"), ("nowhere", "unused")]
TYPE_NAMES_SQL = f"names(current, subs) AS (VALUES {', '.join(map(str, TYPE_NAMES))})"
KEYED_TOTALS = f"""WITH {EVENT_ROWS}, {TYPE_NAMES_SQL}
SELECT coalesce(subs, event_type) AS event_type, {day_text()}, {SUMS}
FROM event_rows LEFT JOIN names ON event_type = current
GROUP BY coalesce(subs, event_type), event_rows.timestamp"""


def _keyed_totals(spark: SparkSession, sf_dir: str, max_bytes: int) -> DataFrame:
    names = spark.createDataFrame(TYPE_NAMES, "current string, subs string")
    rows = event_rows(spark, sf_dir).drop("user_id")
    named = lookup.standardize(rows, "event_type", names, max_bytes=max_bytes)
    return agg.aggregate(named, ["event_type"], TS, METRICS)


@query("keyed_totals", KEYED_TOTALS)
def keyed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed_totals(spark, sf_dir, lookup.BROADCAST_BYTES)


@query("keyed_totals_large_lookup", KEYED_TOTALS)
def keyed_totals_large_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way taken when the lookup is too large to broadcast: few types, all of them hot."""
    return _keyed_totals(spark, sf_dir, 0)


@query(
    "last_wins_lookup",
    """SELECT user_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def last_wins_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.unique_lookup(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


@query(
    "stretched_panel",
    f"""WITH {COMPLETED},
placed AS (SELECT c.*, s.confirmed AS known, row_number() OVER w - 1 AS number,
  lead(c.confirmed) OVER w AS upcoming
  FROM completed c LEFT JOIN panel s ON s.user_id = c.user_id AND s.timestamp = c.timestamp
  WINDOW w AS (PARTITION BY c.user_id ORDER BY c.timestamp)),
filled AS (SELECT *, last_value(known IGNORE NULLS) OVER
  (PARTITION BY user_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS reached FROM placed)
SELECT user_id, {day_text()}, coalesce(reached, -1) AS reached,
  coalesce(confirmed = 0 AND upcoming > 0, false) AS onset, number AS "Days" FROM filled""",
)
def stretched_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The completed panel: absent days carry the last value on and know onsets and day numbers,
    written out at the end."""
    g = gaps.with_gaps(users(spark, sf_dir), KEY, TS)
    g = gaps.day_number(gaps.onset_flag(g))
    df = gaps.expand(gaps.forward_fill(g, ["confirmed"]))
    reached = F.coalesce("confirmed", F.lit(-1)).alias("reached")
    return df.select("user_id", TS, reached, "onset", F.col("Days").cast("long"))


@query(
    "absent_stretches",
    f"""WITH {USERS},
near AS (SELECT user_id, timestamp, lead(timestamp) OVER w AS following, row_number() OVER w AS nth,
  min(timestamp) OVER () AS earliest, max(timestamp) OVER () AS latest
  FROM panel WINDOW w AS (PARTITION BY user_id ORDER BY timestamp)),
ranges AS (SELECT user_id, earliest - 1 AS first_day, timestamp - 1 AS last_day FROM near WHERE nth = 1
  UNION ALL SELECT user_id, timestamp + 1, coalesce(following, latest + 1) - 1 FROM near)
SELECT user_id, {day_text("first_day")}, {day_text("last_day")} FROM ranges WHERE ranges.first_day <= ranges.last_day""",
)
def absent_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days without a row of the user, as ranges of the calendar."""
    return gaps.stretches(gaps.with_gaps(users(spark, sf_dir), KEY, TS))
