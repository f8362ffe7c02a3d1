"""The four jobs over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallypanel.operators.order import file_order
from tallypanel.plans import jobs
from tallypanel.plans.catalog import day_text, query
from tallypanel.plans.metric_queries import DOUBLING
from tallypanel.plans.panel_queries import completed_sql, users
from tallypanel.plans.panels import (
    DAY_SERIES,
    EVENT_ROWS,
    METRICS,
    NATION_ORDERS,
    SUMS,
    TS,
    day_series,
    event_panel,
    event_rows,
    nation_orders,
    table,
)
from tallypanel.plans.text_queries import map_documents, regional_documents, summary_documents
from tallypanel.session import materialize, scratch_path
from tallypanel.sinks.files import write_csv
from tallypanel.sinks.versions import current_path
from tallypanel.sources.files import read_csv

DERIVED = "newConfirmed newRecovered newDeaths growthRate movingAvg doublingTime"


def _shown(columns: list[str], integers: tuple[str, ...] = (), longs: tuple[str, ...] = ()) -> str:
    """SQL select list with the job's output types."""
    out = []
    for c in columns:
        if c == TS:
            out.append(day_text())
        elif c in ("country", "state"):
            out.append(c)
        elif c in integers:
            out.append(f'CAST("{c}" AS INTEGER) AS "{c}"')
        elif c in longs:
            out.append(f'CAST("{c}" AS BIGINT) AS "{c}"')
        else:
            out.append(f'round(CAST("{c}" AS DOUBLE), 6) AS "{c}"')
    return ", ".join(out)


def _derive(source: str, partition: str, growth_partition: str, order: str = "timestamp") -> str:
    """SQL for deltas, growth, average and doubling time of ``source``."""
    new = ", ".join(
        f"coalesce({m} - lag({m}) OVER w, {m}) AS new{m.capitalize()}" for m in METRICS
    )
    over = f"({growth_partition} ORDER BY {order}"
    return f"""new AS (SELECT *, {new} FROM {source} WINDOW w AS ({partition} ORDER BY {order})),
growth AS (SELECT *, coalesce(CAST(newConfirmed AS DOUBLE)
  / nullif(lag(confirmed) OVER {over}), 0), 0.0) AS growthRate FROM new),
average AS (SELECT *, CASE WHEN count(*) OVER w7 = 7 THEN avg(growthRate) OVER w7 ELSE 0.0 END AS movingAvg
  FROM growth WINDOW w7 AS {over} ROWS 6 PRECEDING)),
derived AS (SELECT *, {DOUBLING} AS doublingTime FROM average)"""


def _repair(source: str, key: str, order: str = "timestamp") -> str:
    tops = ", ".join(f"max({m}) OVER u AS {m}" for m in METRICS)
    extra = order.removeprefix("timestamp").removeprefix(",")
    return f"""repaired AS (SELECT {key}, timestamp, {extra + "," if extra else ""} {tops} FROM {source}
  WINDOW u AS (PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING))"""


def _trim(key: str, order: str = "timestamp") -> str:
    return f"""flagged AS (SELECT *, coalesce(confirmed = 0 AND lead(confirmed) OVER w > 0, false) AS onset
  FROM completed WINDOW w AS (PARTITION BY {key} ORDER BY {order})),
trimmed AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS "Days",
  confirmed - deaths - recovered AS active FROM flagged WHERE onset OR confirmed > 0)"""


def _world_sql(growth_partition: str) -> str:
    return f"""WITH {DAY_SERIES}, {_derive("series", "", growth_partition)},
days AS (SELECT timestamp FROM derived UNION ALL SELECT CAST(min(timestamp) - INTERVAL 1 DAY AS DATE) FROM derived),
completed AS (SELECT d.timestamp, coalesce(confirmed, 0) AS confirmed, coalesce(deaths, 0) AS deaths,
  coalesce(recovered, 0) AS recovered, coalesce(confirmed - deaths - recovered, 0) AS active,
  {", ".join(f"coalesce({c}, 0) AS {c}" for c in DERIVED.split())},
  row_number() OVER (ORDER BY d.timestamp) - 1 AS "Days" FROM days d LEFT JOIN derived s ON s.timestamp = d.timestamp)
SELECT {_shown(jobs.WORLD_COLUMNS, ("Days",))} FROM completed"""


def _world_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(spark, sf_dir).withColumnRenamed("event_type", "country")


@query("world_job", _world_sql("PARTITION BY timestamp"))
def world_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.world_job(_world_feed(spark, sf_dir))


@query("world_growth_job", _world_sql(""))
def world_growth_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.world_job(_world_feed(spark, sf_dir), growth_keys=())


HISTORY = f"""WITH {DAY_SERIES},
seeded AS (SELECT timestamp, confirmed, recovered, deaths FROM series UNION ALL
  SELECT CAST(min(timestamp) - INTERVAL 1 DAY AS DATE), 0, 0, 0 FROM series),
{_derive("seeded", "", "")},
numbered AS (SELECT *, row_number() OVER (ORDER BY timestamp) - 1 AS "Days" FROM derived)
SELECT {_shown(jobs.HISTORY_COLUMNS, ("Days",), ("doublingTime",))} FROM numbered"""


@query("history_job", HISTORY)
def history_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.history_job(day_series(spark, sf_dir))


# Nations and states that count as one.
COUNTRY_NAMES = [("NATION_1", "NATION_0"), ("NATION_7", "NATION_6"), ("NOWHERE", "NATION_9")]
STATE_NAMES = [("1", "0"), ("3", "2"), ("nowhere", "5")]


COUNTRY = f"""WITH {NATION_ORDERS}, names(current, subs) AS (VALUES {", ".join(map(str, COUNTRY_NAMES))}),
named AS (SELECT coalesce(subs, n_name) AS country, n_name AS former, timestamp, confirmed, recovered, deaths
  FROM nation_orders LEFT JOIN names ON n_name = current),
{_repair("named", "country", "timestamp, former")},
{_derive("repaired", "PARTITION BY country", "PARTITION BY country", "timestamp, former")},
days AS (SELECT DISTINCT timestamp FROM derived
  UNION ALL SELECT CAST(min(timestamp) - INTERVAL 1 DAY AS DATE) FROM derived),
keys AS (SELECT DISTINCT country FROM derived),
completed AS (SELECT k.country, d.timestamp, former,
  {", ".join(f"coalesce({c}, 0) AS {c}" for c in [*METRICS, *DERIVED.split()])}
  FROM keys k CROSS JOIN days d LEFT JOIN derived s ON s.country = k.country AND s.timestamp = d.timestamp),
{_trim("country", "timestamp, former")},
placed AS (SELECT t.*, CAST(n_nationkey AS DOUBLE) AS lat, CAST(n_regionkey AS DOUBLE) AS long
  FROM trimmed t LEFT JOIN nation ON country = n_name)
SELECT {_shown(jobs.COUNTRY_COLUMNS)} FROM placed"""


def _country(spark: SparkSession, sf_dir: str, **options: int) -> DataFrame:
    daily = nation_orders(spark, sf_dir).withColumnRenamed("n_name", "country")
    feed = materialize(daily, "nation-orders")
    names = spark.createDataFrame(COUNTRY_NAMES, "current string, subs string")
    nation = table(spark, sf_dir, "nation")
    coordinates = nation.select(
        F.col("n_name").alias("country"),
        F.col("n_nationkey").cast("double").alias("lat"),
        F.col("n_regionkey").cast("double").alias("long"),
    )
    return jobs.country_job(feed, names, coordinates, **options)


@query("country_job", COUNTRY)
def country_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _country(spark, sf_dir)


@query("country_job_segmented", COUNTRY)
def country_job_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way taken when a country has too many rows for one task."""
    return _country(spark, sf_dir, max_rows=1)


REGIONAL = f"""WITH {EVENT_ROWS}, names(current, subs) AS (VALUES {", ".join(map(str, STATE_NAMES))}),
named AS (SELECT coalesce(subs, CAST(user_id AS VARCHAR)) AS state, e.* FROM event_rows e
  LEFT JOIN names ON CAST(user_id AS VARCHAR) = current),
totals AS (SELECT state, timestamp, {SUMS} FROM named GROUP BY 1, 2),
{_repair("totals", "state")},
{_derive("repaired", "PARTITION BY state", "PARTITION BY state")},
{completed_sql("derived", "state", " ".join([*METRICS, *DERIVED.split()]))},
{_trim("state")}
SELECT {_shown(jobs.REGIONAL_COLUMNS)} FROM trimmed"""


@query("regional_job", REGIONAL)
def regional_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_rows(spark, sf_dir)
    feed = rows.select(F.col("user_id").cast("string").alias("state"), TS, *METRICS)
    names = spark.createDataFrame(STATE_NAMES, "current string, subs string")
    return jobs.regional_job(feed, names)


def _csv_of(spark: SparkSession, table: str, columns: list[str], others: dict[str, str] | None = None) -> DataFrame:
    """The current version's CSV files."""
    kinds = {"timestamp": "string", "country": "string", "state": "string"} | (others or {})
    schema = ", ".join(f"{c} {kinds.get(c, 'double')}" for c in columns)
    return read_csv(spark, current_path(spark, table, "csv"), schema)


def run_country_table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed feed and lookups, the whole run, and the written table read back."""
    root = scratch_path(spark, "run")
    daily = nation_orders(spark, sf_dir).where("n_name IS NOT NULL")
    map_documents(daily, "n_name").write.text(f"{root}/feed")
    names = spark.createDataFrame(COUNTRY_NAMES, "current string, subs string")
    write_csv(names, f"{root}/names")
    places = table(spark, sf_dir, "nation").select(
        F.lit("X").alias("countryCode"),
        F.col("n_nationkey").cast("double").alias("lat"),
        F.col("n_regionkey").cast("double").alias("long"),
        F.col("n_name").alias("country"),
    )
    write_csv(places, f"{root}/places")
    inputs = {"map_feed": f"{root}/feed", "country_names": f"{root}/names", "coordinates": f"{root}/places"}
    jobs.run_jobs(spark, inputs, f"{root}/tables", ["country"], "lines")
    return _csv_of(spark, f"{root}/tables/country", jobs.COUNTRY_COLUMNS)


@query("run_country_table", COUNTRY)
def run_country_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_country_table_files(spark, sf_dir)


@query("run_regional_table", REGIONAL)
def run_regional_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the regional table."""
    root = scratch_path(spark, "run")
    panel = users(spark, sf_dir)
    keys = panel.select("user_id").distinct().count()
    regional_documents(panel, "user_id", keys).write.text(f"{root}/feed")
    write_csv(spark.createDataFrame(STATE_NAMES, "current string, subs string"), f"{root}/names")
    inputs = {"history_feed": f"{root}/feed", "state_names": f"{root}/names"}
    jobs.run_jobs(spark, inputs, f"{root}/tables", ["regional"], "lines")
    return _csv_of(spark, f"{root}/tables/regional", jobs.REGIONAL_COLUMNS)


@query("run_world_table", _world_sql("PARTITION BY timestamp"))
def run_world_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the world table."""
    root = scratch_path(spark, "run")
    map_documents(event_panel(spark, sf_dir), "event_type").write.text(f"{root}/feed")
    jobs.run_jobs(spark, {"map_feed": f"{root}/feed"}, f"{root}/tables", ["world"], "lines")
    return _csv_of(spark, f"{root}/tables/world", jobs.WORLD_COLUMNS, {"Days": "int"})


@query("run_history_table", HISTORY)
def run_history_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the history table."""
    root = scratch_path(spark, "run")
    summary_documents(event_panel(spark, sf_dir)).write.text(f"{root}/feed")
    jobs.run_jobs(spark, {"history_feed": f"{root}/feed"}, f"{root}/tables", ["history"], "lines")
    return _csv_of(spark, f"{root}/tables/history", jobs.HISTORY_COLUMNS, {"Days": "int", "doublingTime": "long"})


@query(
    "ordered_country_table",
    COUNTRY.rpartition("SELECT ")[0]
    + """SELECT country, strftime(placed.timestamp, '%m-%d-%Y') AS timestamp, CAST("Days" AS DOUBLE) AS "Days",
  row_number() OVER (ORDER BY country NULLS FIRST, placed.timestamp, "Days") - 1 AS position FROM placed""",
)
def ordered_country_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each row in the files of the written table."""
    rows = run_country_table_files(spark, sf_dir)
    return file_order(rows).select("country", TS, "Days", "position")
