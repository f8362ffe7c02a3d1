"""JSON feeds of daily counters, read from landed files.

A feed is either whole documents (``layout="document"``, one JSON value per file; one
task parses one file) or JSON lines (``layout="lines"``, one value per line; files are
split). Both shapes hold the same values, so large histories are landed as lines or as
many documents and read in parallel. Broken JSON fails the job; ``checked_records`` tells sound
records from broken ones instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallypanel.functions.days import parse_day
from tallypanel.operators.shape import rename

# Counters may be written as 1 or 1.0.
NUMBER = "decimal(30, 6)"
# The fields of the two feeds that the tables need. Others are not parsed.
MAP_FEED = (
    f"map<string, array<struct<date: string, confirmed: {NUMBER}, deaths: {NUMBER}, recovered: {NUMBER}>>>"
)
HISTORY_SUMMARY = (
    "struct<data: array<struct<day: string, "
    f"summary: struct<total: {NUMBER}, discharged: {NUMBER}, deaths: {NUMBER}>>>>"
)
HISTORY_REGIONS = (
    "struct<data: array<struct<day: string, regional: "
    f"array<struct<loc: string, totalConfirmed: {NUMBER}, discharged: {NUMBER}, deaths: {NUMBER}>>>>>"
)


def read_documents(spark: SparkSession, path: str, layout: str = "document") -> DataFrame:
    """Column ``value``: one JSON value per row."""
    if layout not in ("document", "lines"):
        raise ValueError(f"unknown layout {layout!r}")
    return spark.read.text(path, wholetext=layout == "document")


def _parsed(value: Column, schema: str) -> Column:
    return F.from_json(value, schema, {"mode": "FAILFAST"})


def _whole(df: DataFrame, *counters: str) -> DataFrame:
    """The counters as whole numbers; a fraction fails the job."""

    def whole(name: str) -> Column:
        number = F.col(name)
        bad = F.raise_error(F.concat(F.lit(f"{name} is not whole: "), number.cast("string"))).cast("long")
        return F.when(number.isNull() | (number == F.floor(number)), number.cast("long")).otherwise(bad)

    return df.withColumns({c: whole(c) for c in counters})


def flatten_map_feed(docs: DataFrame, value: str = "value", key: str = "country") -> DataFrame:
    """Map of arrays to rows: the map key and the fields of each record."""
    entries = docs.select(F.explode(_parsed(F.col(value), MAP_FEED)).alias(key, "_records"))
    rows = entries.select(key, F.inline("_records"))
    return _whole(rows, "confirmed", "deaths", "recovered")


def _history_days(docs: DataFrame, value: str, schema: str) -> DataFrame:
    return docs.select(F.inline(_parsed(F.col(value), schema)["data"]))


def flatten_history_summary(docs: DataFrame, value: str = "value") -> DataFrame:
    """One row per day with the summary's counters."""
    rows = _history_days(docs, value, HISTORY_SUMMARY).select(
        "day",
        F.col("summary.total").alias("confirmed"),
        F.col("summary.discharged").alias("recovered"),
        F.col("summary.deaths").alias("deaths"),
    )
    return _whole(rows, "confirmed", "recovered", "deaths")


def flatten_history_regions(docs: DataFrame, value: str = "value") -> DataFrame:
    """One row per day and region with the region's counters."""
    regions = _history_days(docs, value, HISTORY_REGIONS).select("day", F.inline("regional"))
    named = rename(
        regions, {"loc": "state", "totalConfirmed": "confirmed", "discharged": "recovered"}
    )
    return _whole(named, "confirmed", "recovered", "deaths")


def with_day(df: DataFrame, text: str, fmt: str = "yyyy-M-d", out: str = "timestamp") -> DataFrame:
    """Replace the text column by its date."""
    return df.withColumn(out, parse_day(F.col(text), fmt)).drop(text)


def read_map_feed(spark: SparkSession, path: str, layout: str = "document") -> DataFrame:
    """``country, confirmed, deaths, recovered, timestamp``."""
    return with_day(flatten_map_feed(read_documents(spark, path, layout)), "date")


def read_history_feed(
    spark: SparkSession, path: str, level: str = "summary", layout: str = "document"
) -> DataFrame:
    """``level="summary"``: one row per day; ``level="regional"``: one per day and state."""
    flatten = {"summary": flatten_history_summary, "regional": flatten_history_regions}[level]
    return with_day(flatten(read_documents(spark, path, layout)), "day", "yyyy-MM-dd")


# Parts are taken apart as text, level by level, so a broken one takes no other with it.
_MAP_PARTS = "map<string, string>"
_HISTORY_PARTS = "struct<data: array<string>, _broken: string>"
_DAY_PARTS = "struct<day: string, summary: string, regional: array<string>, _broken: string>"
_COUNTERS = ("confirmed", "deaths", "recovered")
# The names of the key, the day and the counters in a record of each feed.
_FIELDS = {
    "map": (None, "date", ("confirmed", "deaths", "recovered")),
    "summary": (None, None, ("total", "deaths", "discharged")),
    "regional": ("loc", None, ("totalConfirmed", "deaths", "discharged")),
}


def _open(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})


def _spread(rows: DataFrame, items: Column, whole: Column, reason: str, out: str) -> DataFrame:
    """A row per item as ``out``; where there is no list of items a row with the ``reason`` and
    ``whole`` as its text. Rows that have a reason stay as they are."""
    fails = F.col("reason").isNull() & items.isNull()
    marked = rows.withColumns(
        {
            "record": F.when(fails, whole).otherwise(F.col("record")),
            "_items": F.when(F.col("reason").isNull(), items),
            "reason": F.when(fails, F.lit(reason)).otherwise(F.col("reason")),
        }
    )
    wide = marked.select("*", F.posexplode_outer("_items").alias("_at", out)).drop("_items")
    # An empty list is nothing broken: it has neither an item nor a reason.
    return wide.where(F.col("reason").isNotNull() | F.col("_at").isNotNull()).drop("_at")


def _records(docs: DataFrame, feed: str) -> DataFrame:
    """Every record of every document as ``record`` (its text), ``key``, ``day`` and counters as
    text, with ``reason`` where the document or a part of it cannot be read."""
    key, day, counters = _FIELDS[feed]
    nothing = F.lit(None).cast("string")
    rows = docs.select("value", nothing.alias("record"), nothing.alias("reason"))
    if feed == "map":
        rows = rows.withColumn("_parsed", F.map_entries(_open(F.col("value"), _MAP_PARTS)))
        rows = _spread(rows, F.col("_parsed"), F.col("value"), "unreadable document", "_part")
        rows = rows.withColumns({"_key": F.col("_part.key"), "_day": nothing})
        whole, items = F.to_json("_part"), _open(F.col("_part.value"), "array<string>")
    else:
        rows = rows.withColumn("_parsed", _open(F.col("value"), _HISTORY_PARTS))
        list_ = F.when(F.col("_parsed._broken").isNull(), F.col("_parsed.data"))
        rows = _spread(rows, list_, F.col("value"), "unreadable document", "_whole_day")
        rows = rows.withColumn("_part", _open(F.col("_whole_day"), _DAY_PARTS))
        rows = rows.withColumns({"_key": nothing, "_day": F.col("_part.day")})
        whole, part = F.col("_whole_day"), F.col("_part")
        items = part["regional"] if feed == "regional" else F.when(part["summary"].isNotNull(), F.array(part["summary"]))
    rows = _spread(rows, items, whole, "no records", "_text")
    fields = ", ".join(f"{f}: string" for f in (key, day, *counters) if f)
    rows = rows.withColumn("_r", _open(F.col("_text"), f"struct<{fields}, _broken: string>"))
    broken = F.col("reason").isNull() & (F.col("_r").isNull() | F.col("_r._broken").isNotNull())
    of_key = F.col("_r")[key] if key else F.col("_key")
    of_day = F.col("_r")[day] if day else F.col("_day")
    shown = F.to_json(F.struct(of_key.alias("key"), of_day.alias("day"), F.col("_text").alias("record")))
    return rows.select(
        F.when(F.col("reason").isNull(), shown).otherwise(F.col("record")).alias("record"),
        of_key.alias("key"),
        of_day.alias("day"),
        *[F.col("_r")[f].alias(c) for f, c in zip(counters, _COUNTERS)],
        F.when(broken, F.lit("unreadable record")).otherwise(F.col("reason")).alias("reason"),
    )


def checked_records(docs: DataFrame, feed: str) -> DataFrame:
    """Records of the feed (``map``, ``summary`` or ``regional``) with their typed fields and, for
    the broken ones, the first ``reason`` found: an unreadable document, a part without records, an
    unreadable record, a day that is none, a counter that is no number or not whole."""
    rows = _records(docs, feed)
    fmt = "yyyy-M-d" if feed == "map" else "yyyy-MM-dd"
    day = F.try_to_date("day", fmt)
    reason = F.col("reason")
    reason = F.coalesce(reason, F.when(F.col("day").isNotNull() & day.isNull(), F.lit("no such day")))
    typed = {}
    for c in _COUNTERS:
        number = F.col(c).try_cast(NUMBER)
        odd = F.col(c).isNotNull() & number.isNull()
        reason = F.coalesce(reason, F.when(odd, F.lit(f"{c} is no number")))
        reason = F.coalesce(reason, F.when(number != F.floor(number), F.lit(f"{c} is not whole")))
        typed[c] = number.try_cast("long").alias(c)
    return rows.select("record", "key", day.alias("timestamp"), *typed.values(), reason.alias("reason"))


def sound(checked: DataFrame, feed: str) -> DataFrame:
    """The sound records, with the columns of ``read_map_feed`` or ``read_history_feed``."""
    rows = checked.where("reason IS NULL")
    key = {"map": ["country"], "regional": ["state"], "summary": []}[feed]
    return rows.withColumnRenamed("key", "".join(key) or "key").select(*key, *_COUNTERS, "timestamp")


def set_aside(checked: DataFrame) -> DataFrame:
    """The broken ones: their text and the reason."""
    return checked.where("reason IS NOT NULL").select("record", "reason")
