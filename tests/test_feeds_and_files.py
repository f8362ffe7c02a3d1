import json

import pytest
from pyspark.sql import functions as F

from tallypanel.operators import shape
from tallypanel.sinks import files as sinks
from tallypanel.sources import feeds, files

MAP = {
    "US": [
        {"date": "2020-1-22", "confirmed": 1, "deaths": 0, "recovered": 0},
        {"date": "2020-1-23", "confirmed": 3, "deaths": 0, "recovered": 0},
    ],
    "Albania": [{"date": "2020-1-23", "confirmed": 2, "deaths": 0, "recovered": 0}],
    "Nowhere": [],
}


def region(loc, confirmed):
    return {
        "loc": loc, "totalConfirmed": confirmed, "discharged": 1, "deaths": 0,
        "confirmedCasesForeign": 0, "confirmedCasesIndian": confirmed,
    }


HISTORY = {
    "success": True,
    "data": [
        {
            "day": "2020-03-10",
            "summary": {"total": 47, "discharged": 1, "deaths": 0, "other": 3},
            "regional": [region("Nagaland#", 3), region("Nagaland", 4)],
        },
        {"day": "2020-03-11", "summary": {"total": 60, "discharged": 0, "deaths": 0}, "regional": []},
    ],
}


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_map_feed(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(MAP, indent=1))
    got = feeds.read_map_feed(spark, str(tmp_path))
    assert dict(got.dtypes)["timestamp"] == "date"
    assert rows_of(got.withColumn("timestamp", F.col("timestamp").cast("string")), "country", "timestamp", "confirmed") == [
        ("Albania", "2020-01-23", 2), ("US", "2020-01-22", 1), ("US", "2020-01-23", 3),
    ]


def test_map_feed_lines_and_documents_agree(spark, tmp_path):
    docs, lines = tmp_path / "docs", tmp_path / "lines"
    docs.mkdir(), lines.mkdir()
    for key, records in MAP.items():
        (docs / f"{key}.json").write_text(json.dumps({key: records}, indent=2))
    (lines / "all.jsonl").write_text("\n".join(json.dumps({k: v}) for k, v in MAP.items()))
    columns = ["country", "timestamp", "confirmed", "deaths", "recovered"]
    assert rows_of(feeds.read_map_feed(spark, str(docs)), *columns) == rows_of(
        feeds.read_map_feed(spark, str(lines), "lines"), *columns
    )
    with pytest.raises(ValueError):
        feeds.read_map_feed(spark, str(docs), "other")


def test_history_feed(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(HISTORY))
    days = feeds.read_history_feed(spark, str(tmp_path))
    assert rows_of(days.withColumn("timestamp", F.col("timestamp").cast("string")), "timestamp", "confirmed", "recovered") == [
        ("2020-03-10", 47, 1), ("2020-03-11", 60, 0),
    ]
    states = feeds.read_history_feed(spark, str(tmp_path), "regional")
    assert rows_of(states, "state", "confirmed") == [("Nagaland", 4), ("Nagaland#", 3)]
    assert sorted(states.columns) == ["confirmed", "deaths", "recovered", "state", "timestamp"]


def test_broken_feed_fails(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"US": [')
    with pytest.raises(Exception, match="MALFORMED|JSON"):
        feeds.read_map_feed(spark, str(tmp_path)).collect()


def test_lookup_file(spark, tmp_path):
    path = tmp_path / "names.csv"
    path.write_text('current,subs\nA,B\nCôte,"Ivory, Coast"\nT*,T\nA,C\nX,Y [Z]\n', encoding="utf-8")
    assert rows_of(files.read_lookup(spark, str(path)), "current", "subs") == [
        ("A", "C"), ("Côte", "Ivory, Coast"), ("T*", "T"), ("X", "Y [Z]"),
    ]


def test_coordinates_file(spark, tmp_path):
    path = tmp_path / "places.csv"
    path.write_text("countryCode,lat,long,country\nNA,-22.9,18.4,Namibia\nUM,,,Islands\n", encoding="utf-8")
    got = {r["country"]: (r["lat"], r["long"]) for r in files.read_coordinates(spark, str(path)).collect()}
    assert got == {"Namibia": (-22.9, 18.4), "Islands": (None, None)}
    codes = files.read_csv(spark, str(path), files.COORDINATES).select("countryCode")
    assert rows_of(codes, "countryCode") == [("NA",), ("UM",)]


TABLE = 'name string, day date, n int, x double'


def table(spark):
    import datetime as dt

    rows = [('say "hi", you', dt.date(2020, 1, 2), 1, 0.12345678901234), ("é", dt.date(2020, 1, 1), None, None)]
    return spark.createDataFrame(rows, TABLE)


def test_csv_sink(spark, tmp_path):
    path = str(tmp_path / "csv")
    for _ in range(2):  # the second write replaces the first
        sinks.write_csv(table(spark), path, ["day"])
    got = files.read_csv(spark, path, "name string, day string, n int, x double")
    assert sorted(tuple(r) for r in got.collect()) == [
        ('say "hi", you', "01-02-2020", 1, 0.12345678901234), ("é", "01-01-2020", None, None),
    ]


def test_json_sink_and_records(spark, tmp_path):
    path = str(tmp_path / "json")
    sinks.write_json(table(spark), path, ["day"])
    want = [
        {"name": "é", "day": "01-01-2020", "n": None, "x": None},
        {"name": 'say "hi", you', "day": "01-02-2020", "n": 1, "x": 0.1234567890},
    ]
    written = [r["value"] for r in spark.read.text(path).collect()]
    assert sorted((json.loads(v) for v in written), key=lambda r: r["day"]) == want
    records = [r["record"] for r in sinks.json_records(table(spark)).collect()]
    assert sorted(records) == sorted(written)


def test_shape(spark):
    df = table(spark)
    with pytest.raises(ValueError):
        shape.drop_strict(df, ["absent"])
    assert shape.drop_strict(df, ["n"]).columns == ["name", "day", "x"]
    assert shape.rename(df, {"n": "m"}).columns == ["name", "day", "m", "x"]
    filled = {r["name"]: (r["n"], r["x"]) for r in shape.fill_zero(df).collect()}
    assert filled["é"] == (0, 0.0)
    tokens = spark.createDataFrame([("NULL", "a", 1), ("b", "NULL", 2)], "s string, t string, n int")
    assert sorted(map(tuple, shape.null_token(tokens).collect()), key=repr) == [("b", None, 2), (None, "a", 1)]
    blank = spark.createDataFrame([(None, None)], "s string, n int")
    assert tuple(shape.fill_blank(blank).first()) == ("", None)


def test_counters_written_as_floats(spark):
    good = spark.createDataFrame([('{"A": [{"date": "2020-1-2", "confirmed": 1.0, "deaths": 2, "recovered": 3.000}]}',)], "value string")
    assert [tuple(r)[1:] for r in feeds.flatten_map_feed(good).collect()] == [("2020-1-2", 1, 2, 3)]
    bad = spark.createDataFrame([('{"A": [{"date": "2020-1-2", "confirmed": 1.5}]}',)], "value string")
    with pytest.raises(Exception, match="not whole"):
        feeds.flatten_map_feed(bad).collect()


def test_csv_keeps_blanks_and_line_breaks(spark, tmp_path):
    texts = [" lead", "trail ", "two\nlines", 'say "x", y', "  ", "\ttab\t"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, v string")
    sinks.write_csv(df, str(tmp_path / "t"))
    back = files.read_csv(spark, str(tmp_path / "t"), "id int, v string", multi_line=True)
    assert [r["v"] for r in back.orderBy("id").collect()] == texts


def reasons(spark, feed, *values):
    docs = spark.createDataFrame([(v,) for v in values], "value string")
    checked = feeds.checked_records(docs, feed)
    return feeds.sound(checked, feed), sorted(r["reason"] for r in feeds.set_aside(checked).collect())


def test_broken_map_records_are_set_aside(spark):
    record = lambda **other: {"date": "2020-1-22", "confirmed": 1, "deaths": "2.0", "recovered": None} | other
    good = json.dumps({"A": [record(), record(date="2020-01-05")], "Nowhere": []})
    odd = json.dumps({"B": [record(date="soon"), record(confirmed="x"), record(deaths=1.5), record(), None], "C": None, "D": 5})
    rows, found = reasons(spark, "map", good, odd, "{", "[1]", "", "{}", None)
    assert found == sorted(
        ["no such day", "confirmed is no number", "deaths is not whole", "no records", "no records", "unreadable record"]
        + ["unreadable document"] * 4
    )
    assert sorted(r["country"] for r in rows.collect()) == ["A", "A", "B"]
    docs = spark.createDataFrame([(good,)], "value string")
    strict = feeds.with_day(feeds.flatten_map_feed(docs), "date")
    columns = ["country", "confirmed", "deaths", "recovered", "timestamp"]
    same = feeds.sound(feeds.checked_records(docs, "map"), "map")
    assert same.select(*columns).dtypes == strict.select(*columns).dtypes
    assert sorted(map(tuple, same.select(*columns).collect())) == sorted(map(tuple, strict.select(*columns).collect()))


def test_broken_history_records_are_set_aside(spark):
    good = json.dumps(HISTORY)
    odd = json.dumps({"data": [{"day": "2020-13-01", "summary": {"total": 1}, "regional": [region("A", "x")]}, {"day": "2020-03-12"}]})
    days, found = reasons(spark, "summary", good, odd, '{"data": 3}', "{}", "nothing")
    assert found == ["no records", "no such day"] + ["unreadable document"] * 3
    assert sorted(r["confirmed"] for r in days.collect()) == [47, 60]
    states, found = reasons(spark, "regional", good, odd)
    assert found == ["no records", "no such day"]
    assert rows_of(states, "state", "confirmed") == [("Nagaland", 4), ("Nagaland#", 3)]
    strict = feeds.with_day(feeds.flatten_history_regions(spark.createDataFrame([(good,)], "value string")), "day")
    assert states.select(*sorted(strict.columns)).dtypes == strict.select(*sorted(strict.columns)).dtypes
