import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallypanel.functions import days, numbers, text


def values(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def texts(spark, items, function):
    return values(spark, [(i,) for i in items], "v string", function(F.col("v")))


def test_zero_pad_keeps_longer_text(spark):
    assert texts(spark, ["1", "12", "123", "", None], text.zero_pad) == ["01", "12", "123", "", None]


def test_date_text(spark):
    items = ["2020-1-2", "2020-11-02", "2020-1-22", "bad", None]
    assert texts(spark, items, text.date_text) == ["01-02-2020", "11-02-2020", "01-22-2020", None, None]


def clean(label):
    return (label.split(",")[1] if ", " in label else label).strip()


def test_clean_label(spark):
    rng = random.Random(1)
    parts = ["NY", " ", ",", ", ", " ", "　", "\t", "\n", "Cook County", "é", "\x1c", "​"]
    items = ["Cook County, IL", " x ", "a,b", "a, b, c", ""]
    items += ["".join(rng.choices(parts, k=rng.randint(1, 8))) for _ in range(300)]
    assert texts(spark, items, text.clean_label) == [clean(i) for i in items]


def test_whitespace_is_what_strip_removes():
    assert all(c.isspace() for c in text.WHITESPACE)
    assert {chr(i) for i in range(0x10000) if chr(i).isspace()} == set(text.WHITESPACE)


def test_elapsed_label(spark):
    seconds = [0, 59, 60, 3599, 3600, 90061]
    rows = [(dt.timedelta(seconds=s, microseconds=7),) for s in seconds]
    got = values(spark, rows, "v interval day to second", text.elapsed_label(F.col("v")))
    assert got == [
        "00 min 00 sec", "00 min 59 sec", "01 min 00 sec", "59 min 59 sec", "00 min 00 sec", "01 min 01 sec",
    ]


def test_thousands(spark):
    got = values(spark, [(0,), (999,), (1234567,), (-1234,)], "v long", text.thousands(F.col("v")))
    assert got == [f"{n:,}" for n in (0, 999, 1234567, -1234)]


def test_parse_day(spark):
    assert texts(spark, ["2020-1-2", "2020-12-31"], days.parse_day) == [
        dt.date(2020, 1, 2),
        dt.date(2020, 12, 31),
    ]
    padded = texts(spark, ["01-02-2020"], lambda c: days.parse_day(c, "MM-dd-yyyy"))
    assert padded == [dt.date(2020, 1, 2)]
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    for setting in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", setting)
        try:
            with pytest.raises(Exception, match="2020-13-01"):
                texts(spark, ["2020-13-01"], days.parse_day)
        finally:
            spark.conf.set("spark.sql.ansi.enabled", ansi)
    assert texts(spark, [None], days.parse_day) == [None]
    assert texts(spark, ["2020-13-01"], lambda c: days.parse_day(c, strict=False)) == [None]


def test_day_label_and_previous_day(spark):
    rows = [(dt.date(2020, 3, 1),)]
    assert values(spark, rows, "d date", days.day_label(F.col("d"))) == ["03-01-2020"]
    assert values(spark, rows, "d date", days.previous_day(F.col("d"))) == [dt.date(2020, 2, 29)]


def test_local_time_label(spark):
    rows = [(dt.datetime(2020, 5, 4, 20, 15),)]
    got = values(spark, rows, "t timestamp_ntz", days.local_time_label(F.col("t")))
    assert got == ["05-05-2020 01:45IST"]


def test_run_time_label(spark):
    india = dt.timezone(dt.timedelta(hours=5, minutes=30))
    before = dt.datetime.now(india).replace(second=0, microsecond=0, tzinfo=None)
    label = spark.range(1).select(days.run_time_label()).first()[0]
    assert before <= dt.datetime.strptime(label, "%m-%d-%Y %H:%MIST") <= before + dt.timedelta(minutes=2)


def test_safe_ratio(spark):
    rows = [(1.0, 2.0), (1.0, 0.0), (0.0, 0.0), (None, 1.0), (1.0, None)]
    got = values(spark, rows, "a double, b double", numbers.safe_ratio(F.col("a"), F.col("b")))
    assert got == [0.5, 0.0, 0.0, 0.0, 0.0]


def test_round_half_even(spark):
    rows = [(0.5,), (1.5,), (2.5,), (-0.5,), (2.4999,)]
    got = values(spark, rows, "v double", numbers.round_half_even(F.col("v")))
    assert got == [round(v, 0) for (v,) in rows]


def test_doubling_periods(spark):
    from helpers import doubling

    rates = [0.0, 1.0, 0.1, 0.07, -0.5, -1.0, -2.0, 3.0, 0.25]
    got = values(spark, [(r,) for r in rates], "v double", numbers.doubling_periods(F.col("v")))
    assert got == [doubling(r) for r in rates]


def test_delta_name():
    assert numbers.delta_name("confirmed") == "newConfirmed"
