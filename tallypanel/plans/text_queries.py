"""Queries on labels, dates, feeds and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallypanel.functions import days, text
from tallypanel.operators import spine
from tallypanel.plans.catalog import day_text, query
from tallypanel.plans.panel_queries import TRIMMED, users
from tallypanel.plans.panels import (
    METRICS,
    NATION_ORDERS,
    TS,
    event_panel,
    event_panel_sql,
    nation_orders,
    table,
)
from tallypanel.session import scratch_path
from tallypanel.sinks import files as sinks
from tallypanel.sinks import months
from tallypanel.sources import feeds, files

UNPADDED = "yyyy-M-d"
# Fields of a region that the tables do not need.
OTHER_FIELDS = ("confirmedCasesForeign", "confirmedCasesIndian")
PANEL = event_panel_sql()
USERS = event_panel_sql(key="user_id")


@query("date_text", "SELECT o_orderkey, strftime(o_orderdate, '%m-%d-%Y') AS label FROM orders")
def date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    unpadded = F.date_format("o_orderdate", UNPADDED)
    return table(spark, sf_dir, "orders").select("o_orderkey", text.date_text(unpadded).alias("label"))


@query(
    "padded_parts",
    """SELECT o_orderkey, strftime(o_orderdate, '%m') || '/' || strftime(o_orderdate, '%d') || '/' ||
  CAST(year(o_orderdate) AS VARCHAR) AS label FROM orders""",
)
def padded_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of an unpadded date, each padded by itself."""
    parts = F.split(F.date_format("o_orderdate", UNPADDED), "-")
    label = F.concat_ws("/", text.zero_pad(parts[1]), text.zero_pad(parts[2]), parts[0])
    return table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"))


@query(
    "parsed_days",
    "SELECT o_orderkey, strftime(o_orderdate, '%m-%d-%Y') AS day FROM orders",
)
def parsed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    unpadded = F.date_format("o_orderdate", UNPADDED)
    return table(spark, sf_dir, "orders").select("o_orderkey", days.parse_day(unpadded).alias("day"))


@query(
    "previous_days",
    """SELECT o_orderkey, strftime(o_orderdate, '%m-%d-%Y') AS day,
  strftime(o_orderdate - INTERVAL 1 DAY, '%m-%d-%Y') AS previous FROM orders""",
)
def previous_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        days.day_label(day).alias("day"),
        days.day_label(days.previous_day(day)).alias("previous"),
    )


def _sql_whitespace() -> str:
    return " || ".join(f"chr({ord(c)})" for c in text.WHITESPACE)


CLEAN = f"""trim(CASE WHEN contains(text, ', ') THEN split_part(text, ',', 2) ELSE text END,
  {_sql_whitespace()})"""


@query("clean_label", f"SELECT doc_id, {CLEAN} AS label FROM documents")
def clean_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.clean_label(F.col("text")).alias("label")
    )


@query(
    "local_time_label",
    """SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%m-%d-%Y %H:%M') || 'IST' AS label
FROM events""",
)
def local_time_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", days.local_time_label(F.col("ts")).alias("label")
    )


@query(
    "elapsed_label",
    f"""WITH spans AS (SELECT user_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM events GROUP BY user_id),
seconds AS (SELECT user_id, us // 1000000 AS s FROM spans)
SELECT user_id, format('{{:02d}} min {{:02d}} sec', (s // 60) % 60, s % 60) AS label FROM seconds""",
)
def elapsed_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = (F.max("ts") - F.min("ts")).alias("span")
    spans = table(spark, sf_dir, "events").groupBy("user_id").agg(span)
    return spans.select("user_id", text.elapsed_label(F.col("span")).alias("label"))


@query(
    "thousands_label",
    "SELECT p_partkey, format('{:,}', CAST(p_partkey * 9973 AS BIGINT)) AS label FROM part",
)
def thousands_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("p_partkey") * 9973
    return table(spark, sf_dir, "part").select("p_partkey", text.thousands(number).alias("label"))


@query(
    "props_extract",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "struct<k: bigint>").alias("props")
    return table(spark, sf_dir, "events").select("event_id", parsed).select("event_id", "props.k")


def map_documents(panel: DataFrame, key: str) -> DataFrame:
    """One map-feed document per key, holding at most one record per day."""
    record = F.struct(F.date_format(TS, UNPADDED).alias("date"), "confirmed", "deaths", "recovered")
    grouped = panel.groupBy(F.col(key).cast("string").alias("_key")).agg(
        F.collect_list(record).alias("_records")
    )
    return grouped.select(F.to_json(F.create_map("_key", "_records")).alias("value"))


# Fixed value: how many keys a document holds about; a day with more has several.
REGIONS_PER_DOCUMENT = 1000


def _history_document(daily: DataFrame, *parts: str) -> DataFrame:
    day = F.struct(F.date_format(TS, "yyyy-MM-dd").alias("day"), *parts)
    return daily.select(F.to_json(F.struct(F.array(day).alias("data"))).alias("value"))


def summary_documents(panel: DataFrame) -> DataFrame:
    """One history-feed document per day with its summary."""
    summary = F.struct(
        F.sum("confirmed").alias("total"), F.sum("recovered").alias("discharged"), F.sum("deaths").alias("deaths")
    )
    return _history_document(panel.groupBy(TS).agg(summary.alias("summary")), "summary")


def regional_documents(panel: DataFrame, key: str, keys: int) -> DataFrame:
    """History-feed documents per day and range of its ``keys`` keys, with their regions."""
    region = F.struct(
        F.col(key).cast("string").alias("loc"),
        F.col("confirmed").alias("totalConfirmed"),
        F.col("recovered").alias("discharged"),
        "deaths",
        F.lit(0).cast("long").alias(OTHER_FIELDS[0]),
        F.col("confirmed").alias(OTHER_FIELDS[1]),
    )
    ranges = -(-keys // REGIONS_PER_DOCUMENT)
    place = F.pmod(F.xxhash64(key), F.lit(max(1, ranges))).alias("_range")
    daily = panel.groupBy(TS, place).agg(F.collect_list(region).alias("regional"))
    return _history_document(daily, "regional")


MAP_ROWS = "SELECT CAST({key} AS VARCHAR) AS country, {day}, confirmed, deaths, recovered FROM panel"


@query("map_feed", f"WITH {USERS} {MAP_ROWS.format(key='user_id', day=day_text())}")
def map_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.with_day(feeds.flatten_map_feed(map_documents(users(spark, sf_dir), "user_id")), "date")


@query("map_feed_lines", f"WITH {USERS} {MAP_ROWS.format(key='user_id', day=day_text())}")
def map_feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "map-lines")
    map_documents(users(spark, sf_dir), "user_id").write.text(path)
    return feeds.read_map_feed(spark, path, "lines")


@query("map_feed_documents", f"WITH {PANEL} {MAP_ROWS.format(key='event_type', day=day_text())}")
def map_feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "map-documents")
    docs = map_documents(event_panel(spark, sf_dir), "event_type")
    # A folder per document, as each file must hold a single one.
    docs.withColumn("doc", F.xxhash64("value")).repartition("doc").write.partitionBy("doc").text(path)
    return feeds.read_map_feed(spark, f"{path}/*")


@query(
    "history_days",
    f"""WITH {PANEL} SELECT {day_text()}, CAST(sum(confirmed) AS BIGINT) AS confirmed,
  CAST(sum(recovered) AS BIGINT) AS recovered, CAST(sum(deaths) AS BIGINT) AS deaths
FROM panel GROUP BY panel.timestamp""",
)
def history_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = summary_documents(event_panel(spark, sf_dir))
    return feeds.with_day(feeds.flatten_history_summary(docs), "day")


@query(
    "history_regions",
    f"WITH {PANEL} SELECT event_type AS state, {day_text()}, confirmed, recovered, deaths FROM panel",
)
def history_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = event_panel(spark, sf_dir)
    docs = regional_documents(panel, "event_type", panel.select("event_type").distinct().count())
    return feeds.with_day(feeds.flatten_history_regions(docs), "day")


def broken_documents(panel: DataFrame, key: str) -> DataFrame:
    """``map_documents`` of which some are cut off, and some records have no day or no number."""
    record = F.struct(
        F.when(F.col("confirmed") % 7 == 0, F.lit("soon")).otherwise(F.date_format(TS, UNPADDED)).alias("date"),
        F.when(F.col("confirmed") % 5 == 0, F.lit("many")).otherwise(F.col("confirmed").cast("string")).alias("confirmed"),
        F.concat(F.col("deaths").cast("string"), F.lit(".0")).alias("deaths"),
        "recovered",
    )
    grouped = panel.groupBy(F.col(key).alias("_key")).agg(F.collect_list(record).alias("_records"))
    whole = F.to_json(F.create_map(F.col("_key").cast("string"), F.col("_records")))
    return grouped.select(F.when(F.col("_key") % 11 == 0, F.left(whole, F.lit(20))).otherwise(whole).alias("value"))


@query(
    "feed_sound_records",
    f"""WITH {USERS} {MAP_ROWS.format(key='user_id', day=day_text())}
WHERE user_id % 11 <> 0 AND confirmed % 7 <> 0 AND confirmed % 5 <> 0""",
)
def feed_sound_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = broken_documents(users(spark, sf_dir), "user_id")
    return feeds.sound(feeds.checked_records(docs, "map"), "map")


@query(
    "feed_set_aside",
    f"""WITH {USERS}, told AS (
  SELECT 'unreadable document' AS reason, count(DISTINCT user_id) AS records FROM panel WHERE user_id % 11 = 0 UNION ALL
  SELECT 'no such day', count(*) FROM panel WHERE user_id % 11 <> 0 AND confirmed % 7 = 0 UNION ALL
  SELECT 'confirmed is no number', count(*) FROM panel
  WHERE user_id % 11 <> 0 AND confirmed % 7 <> 0 AND confirmed % 5 = 0)
SELECT reason, records FROM told WHERE records > 0""",
)
def feed_set_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records are set aside and why."""
    docs = broken_documents(users(spark, sf_dir), "user_id")
    aside = feeds.set_aside(feeds.checked_records(docs, "map"))
    return aside.groupBy("reason").agg(F.count("*").alias("records"))


@query("csv_lookup", "SELECT c_name AS current, c_mktsegment AS subs FROM customer")
def csv_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "lookup")
    customer = table(spark, sf_dir, "customer")
    sinks.write_csv(
        customer.select(F.col("c_name").alias("current"), F.col("c_mktsegment").alias("subs")), path
    )
    return files.read_lookup(spark, path)


@query("csv_text_roundtrip", "SELECT doc_id, ' ' || text || ' ' AS text FROM documents")
def csv_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks, quotes and outer blanks."""
    path = scratch_path(spark, "csv-text")
    outer = F.concat(F.lit(" "), "text", F.lit(" ")).alias("text")
    sinks.write_csv(table(spark, sf_dir, "documents").select("doc_id", outer), path)
    return files.read_csv(spark, path, "doc_id long, text string", multi_line=True)


TRIMMED_ROWS = f"""WITH {TRIMMED} SELECT user_id, {day_text()}, confirmed, recovered, deaths, "Days" FROM trimmed"""
FIELDS = "user_id long, timestamp string, confirmed long, recovered long, deaths long, Days int"


@query("csv_roundtrip", TRIMMED_ROWS)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    df = spine.complete_and_trim(users(spark, sf_dir), ["user_id"], TS)
    sinks.write_csv(df, path, ["user_id", TS])
    return files.read_csv(spark, path, FIELDS)


@query("json_roundtrip", TRIMMED_ROWS)
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "json")
    df = spine.complete_and_trim(users(spark, sf_dir), ["user_id"], TS)
    sinks.write_json(df, path, ["user_id", TS])
    return spark.read.schema(FIELDS).json(path)


@query(
    "json_records",
    f"""WITH {USERS} SELECT CAST(to_json({{'user_id': user_id, 'timestamp': strftime(timestamp, '%m-%d-%Y'),
  'confirmed': confirmed, 'recovered': recovered, 'deaths': deaths}}) AS VARCHAR) AS record FROM panel""",
)
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.json_records(users(spark, sf_dir).select("user_id", TS, *METRICS))


MONTHS = ("2024-01", "1995-03", "1996-07", "1998-02")
NATION_FIELDS = "n_name string, timestamp date, confirmed long, recovered long, deaths long"


@query(
    "replaced_month",
    f"""WITH {NATION_ORDERS} SELECT n_name, {day_text()}, strftime(nation_orders.timestamp, '%Y-%m') AS month,
  confirmed * CASE WHEN strftime(nation_orders.timestamp, '%Y-%m') = '1996-07' THEN 2 ELSE 1 END AS confirmed,
  recovered, deaths FROM nation_orders WHERE strftime(nation_orders.timestamp, '%Y-%m') IN {MONTHS}""",
)
def replaced_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by month, one month of it replaced, some months of it read."""
    path = scratch_path(spark, "months")
    panel = nation_orders(spark, sf_dir)
    months.write_months(panel, path, TS, ["n_name"])
    corrected = panel.where(months.month_of(F.col(TS)) == "1996-07").withColumn("confirmed", F.col("confirmed") * 2)
    months.write_months(corrected, path, TS, ["n_name"])
    return months.read_months(spark, path, NATION_FIELDS, MONTHS)
