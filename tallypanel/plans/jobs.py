"""The four result tables, as plans from feed rows to output columns.

Feed rows carry ``timestamp`` (date), ``confirmed``, ``recovered``, ``deaths`` and, for
keyed jobs, the entity name.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallypanel.operators import aggregate as agg
from tallypanel.operators import lookup, quality, segmented, series, shape, spine
from tallypanel.session import mark, materialize, release
from tallypanel.sinks import files as sinks
from tallypanel.sinks import versions
from tallypanel.sources import feeds, files

TS = "timestamp"
METRICS = ["confirmed", "recovered", "deaths"]

# The columns of the results, in order.
WORLD_COLUMNS = [
    "timestamp", "confirmed", "deaths", "recovered", "active", "newConfirmed", "newDeaths",
    "newRecovered", "growthRate", "movingAvg", "doublingTime", "Days",
]
HISTORY_COLUMNS = [
    "timestamp", "confirmed", "recovered", "deaths", "newConfirmed", "newDeaths",
    "newRecovered", "growthRate", "movingAvg", "doublingTime", "Days",
]
REGIONAL_COLUMNS = [
    "state", "timestamp", "confirmed", "recovered", "deaths", "active", "newConfirmed",
    "newRecovered", "newDeaths", "Days", "growthRate", "movingAvg", "doublingTime",
]
COUNTRY_COLUMNS = ["country", "timestamp", "lat", "long", *REGIONAL_COLUMNS[2:]]


def _output(
    df: DataFrame, columns: Sequence[str], integers: Sequence[str] = (), longs: Sequence[str] = ()
) -> DataFrame:
    kept = {"timestamp", "country", "state"}
    types = {c: "int" if c in integers else "double" for c in columns if c not in kept}
    types |= dict.fromkeys(longs, "long")
    return df.select(*[F.col(c).cast(types[c]).alias(c) if c in types else c for c in columns])


def world_job(feed: DataFrame, growth_keys: Sequence[str] = (TS,)) -> DataFrame:
    """Daily totals of all entities.

    By default growth compares rows of the same day only, and a day has one row, so
    growth, average and doubling time are 0, as users of this table know it.
    ``growth_keys=()`` gives the growth of the series.
    """
    daily = agg.aggregate(feed, [], TS, METRICS)
    df = series.add_deltas(shape.balance(daily), [], TS, METRICS)
    df = series.growth_rate(df, growth_keys, TS)
    df = series.moving_average(df, growth_keys, TS)
    df = spine.complete_series(series.doubling_time(df), TS)
    return _output(spine.day_number(df, [], TS), WORLD_COLUMNS, ["Days"])


def history_job(feed: DataFrame) -> DataFrame:
    """One ready daily series. The seed day comes before deltas and growth here, so the
    first real day grows from 0. A feed with two rows for a day fails the job; so the
    series, which is worked in one task, is bounded by the calendar."""
    df = spine.complete_series(quality.one_row_per_day(feed.select(TS, *METRICS), TS), TS)
    df = series.add_deltas(df, [], TS, METRICS)
    df = series.moving_average(series.growth_rate(df, [], TS), [], TS)
    df = spine.day_number(series.doubling_time(df), [], TS)
    return _output(df, HISTORY_COLUMNS, ["Days"], ["doublingTime"])


def _keyed_metrics(
    df: DataFrame, key: str, days: DataFrame, tie: Sequence[str] = ()
) -> DataFrame:
    """Repair, deltas, growth, completion and trim: one shuffle by ``key``."""
    # Placed on the days first, so that the windows after it follow each other.
    df = spine.with_previous_day(df, TS, days, "_prev")
    df = series.repair_and_diff(df, [key], TS, METRICS, tie, growth_of="confirmed")
    df = series.moving_average(df, [key], TS, tie=tie)
    df = spine.complete_and_trim(df, [key], TS, tie=tie, previous="_prev")
    # An added row's average is 0, and so is its doubling time.
    return shape.balance(series.doubling_time(df))


def _segmented_metrics(
    df: DataFrame, key: str, days: DataFrame, tie: Sequence[str], segments: int
) -> DataFrame:
    """``_keyed_metrics`` for keys with more rows than one task should hold."""
    df = spine.with_previous_day(df, TS, days, "_prev")
    s = segmented.segment(df, [key], [TS, *tie], segments)
    return shape.balance(series.doubling_time(segmented.metrics_and_trim(s, TS, "_prev", METRICS)))


def country_job(
    feed: DataFrame,
    names: DataFrame,
    coordinates: DataFrame,
    max_bytes: int = lookup.BROADCAST_BYTES,
    max_rows: int = segmented.ROWS_PER_SEGMENT,
    segments: int | None = None,
) -> DataFrame:
    """One trimmed series per country with its coordinates.

    Names are replaced but rows are not summed again, so two names that become one keep
    two rows a day, ordered by their former name. That leaves the rows per country
    without bound: countries with more than ``max_rows`` go apart and their series are
    cut into ``segments``. ``feed`` is read for its days, its counts and its rows, so it
    should be a stored table.
    """
    rows = feed.select("country", TS, *METRICS, F.col("country").alias("_former"))
    named = lookup.standardize(rows, "country", names, max_bytes=max_bytes)
    days = spine.observed_days(feed, TS)
    # Written out, so that it is counted once. Few countries have so many rows.
    hot = materialize(agg.hot_groups(named, ["country"], max_rows), "hot")
    hot_rows = hot.agg(F.sum("_rows")).first()[0]
    if hot_rows is None:
        df = _keyed_metrics(named, "country", days, ["_former"])
    else:
        cut = segments or segmented.segments_for(feed.sparkSession, hot_rows)
        keys = hot.select(F.col("country").alias("_hot"))
        # Null-safe: rows without a country may be many as well.
        same = F.col("country").eqNullSafe(F.col("_hot"))
        usual, large = named.join(keys, same, "left_anti"), named.join(keys, same, "left_semi")
        df = _keyed_metrics(usual, "country", days, ["_former"]).unionByName(
            _segmented_metrics(large, "country", days, ["_former"], cut)
        )
    df = lookup.add_dimension(df, coordinates, ["country"], max_bytes)
    return _output(shape.null_token(df), COUNTRY_COLUMNS)


def regional_job(
    feed: DataFrame, names: DataFrame, max_bytes: int = lookup.BROADCAST_BYTES
) -> DataFrame:
    """One trimmed series per state; states that become one name are summed."""
    # A large lookup is joined by shuffle: then rows are summed before it as well.
    small = lookup.fits(names, max_bytes)
    rows = feed if small else agg.aggregate(feed, ["state"], TS, METRICS)
    named = lookup.standardize(rows, "state", names, small=small)
    totals = agg.aggregate(named, ["state"], TS, METRICS)
    # The days come from the feed's own columns, not from the sums above.
    days = spine.observed_days(feed.dropna(subset=["state"]), TS)
    return _output(_keyed_metrics(totals, "state", days), REGIONAL_COLUMNS)


def _world(spark: SparkSession, feed: DataFrame, inputs: Mapping[str, str]) -> DataFrame:
    return world_job(feed)


def _country(spark: SparkSession, feed: DataFrame, inputs: Mapping[str, str]) -> DataFrame:
    names = files.read_lookup(spark, inputs["country_names"])
    return country_job(feed, names, files.read_coordinates(spark, inputs["coordinates"]))


def _history(spark: SparkSession, feed: DataFrame, inputs: Mapping[str, str]) -> DataFrame:
    return history_job(feed)


def _regional(spark: SparkSession, feed: DataFrame, inputs: Mapping[str, str]) -> DataFrame:
    return regional_job(feed, files.read_lookup(spark, inputs["state_names"]))


@dataclass(frozen=True)
class Job:
    """``feed`` names the reader of the input rows and ``order`` sorts the written table."""

    feed: str
    build: Callable[[SparkSession, DataFrame, Mapping[str, str]], DataFrame]
    order: tuple[str, ...]


JOBS = {
    "world": Job("map", _world, (TS,)),
    "country": Job("map", _country, ("country", TS, "Days")),
    "history": Job("summary", _history, (TS,)),
    "regional": Job("regional", _regional, ("state", TS)),
}


def load_feed(
    spark: SparkSession, feed: str, inputs: Mapping[str, str], layout: str = "document"
) -> DataFrame:
    """Parsed feed rows, written to shared scratch: jobs read them more than once and
    JSON is parsed only here."""
    if feed == "map":
        rows = feeds.read_map_feed(spark, inputs["map_feed"], layout)
    else:
        rows = feeds.read_history_feed(spark, inputs["history_feed"], feed, layout)
    return materialize(rows, f"feed-{feed}")


def load_feed_set_aside(
    spark: SparkSession, feed: str, inputs: Mapping[str, str], layout: str = "document"
) -> tuple[DataFrame, DataFrame]:
    """``load_feed`` of the sound records, and the others as ``feeds.set_aside`` shows them."""
    kind = "map_feed" if feed == "map" else "history_feed"
    docs = feeds.read_documents(spark, inputs[kind], layout)
    checked = materialize(feeds.checked_records(docs, feed), f"checked-{feed}")
    return feeds.sound(checked, feed), feeds.set_aside(checked)


BROKEN = ("fail", "set_aside")


def run_jobs(
    spark: SparkSession,
    inputs: Mapping[str, str],
    out_dir: str,
    names: Sequence[str] = tuple(JOBS),
    layout: str = "document",
    broken: str = "fail",
) -> DataFrame:
    """Build the named tables from landed files and replace the versioned table
    ``<out_dir>/<name>`` by its CSV and JSON files, which appear together
    (``sinks.versions``). Jobs on the same feed share its parsed rows.

    Broken records fail the run; with ``broken="set_aside"`` they go to the versioned table
    ``<out_dir>/set_aside/<feed>`` and the summary counts them. Returns the summary of the run,
    one row per table, from figures taken while the tables are written. The scratch of the run is
    deleted, also when it fails.
    """
    if broken not in BROKEN:
        raise ValueError(f"broken is one of {', '.join(BROKEN)}")
    since = mark(spark)
    loaded: dict[str, DataFrame] = {}
    aside: dict[str, int] = {}
    figures: dict[str, dict] = {}
    try:
        for name in names:
            job = JOBS[name]
            if job.feed not in loaded and broken == "set_aside":
                loaded[job.feed], rest = load_feed_set_aside(spark, job.feed, inputs, layout)
                aside[job.feed] = _write_aside(spark, rest, f"{out_dir}/set_aside/{job.feed}")
            elif job.feed not in loaded:
                loaded[job.feed] = load_feed(spark, job.feed, inputs, layout)
            built, seen = quality.observed(job.build(spark, loaded[job.feed], inputs), TS, METRICS)
            stored = materialize(built, name)
            figures[name] = dict(seen.get) | ({"set_aside": aside[job.feed]} if aside else {})
            # Sorted once for both; a lost part is sorted again from the stored table.
            ordered = stored.orderBy(*job.order).persist(StorageLevel.DISK_ONLY)
            try:
                writers = {"csv": partial(sinks.write_csv, ordered), "json": partial(sinks.write_json, ordered)}
                versions.replace(spark, f"{out_dir}/{name}", writers)
            finally:
                ordered.unpersist()
        return quality.observed_summary(spark, figures, stamp=True)
    finally:
        release(spark, since)


def _write_aside(spark: SparkSession, rows: DataFrame, table: str) -> int:
    """Publish the rows set aside; their number."""
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("lines"))
    versions.replace(spark, table, {"json": lambda path: counted.write.json(path)})
    return seen.get["lines"]
