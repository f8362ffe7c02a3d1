import json
import os

import pytest
from pyspark.sql import functions as F

from tallypanel import session
from tallypanel.operators import quality
from tallypanel.plans import jobs
from tallypanel.sinks import files, months, versions

DAY = "key string, ts date, confirmed long"


def frame(spark, n, first=0):
    return spark.range(first, first + n).select(
        F.concat(F.lit("k"), F.col("id") % 3).alias("key"),
        F.date_add(F.lit("2020-01-30").cast("date"), F.col("id").cast("int")).alias("ts"),
        F.col("id").alias("confirmed"),
    )


def writers(df):
    return {"csv": lambda path: files.write_csv(df, path), "json": lambda path: files.write_json(df, path)}


def counts(spark, table):
    csv = spark.read.option("header", True).csv(versions.current_path(spark, table, "csv")).count()
    return csv, spark.read.json(versions.current_path(spark, table, "json")).count()


def test_replacement_and_versions_kept(spark, tmp_path):
    table = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.current_path(spark, table, "csv")
    for n in (3, 5, 7):
        versions.replace(spark, table, writers(frame(spark, n)))
        assert counts(spark, table) == (n, n)
    assert [v.number for v in versions.versions(spark, table)] == [3, 2]
    assert len(os.listdir(f"{table}/data")) == 2
    with pytest.raises(ValueError, match="not orc"):
        versions.current_path(spark, table, "orc")


def test_failure_between_the_two_leaves_the_old_pair(spark, tmp_path):
    table = str(tmp_path / "t")
    versions.replace(spark, table, writers(frame(spark, 4)))

    def fail(path):
        files.write_json(frame(spark, 9), path)
        raise RuntimeError("between")

    with pytest.raises(RuntimeError, match="between"):
        versions.replace(spark, table, writers(frame(spark, 9)) | {"json": fail})
    assert counts(spark, table) == (4, 4) and len(os.listdir(f"{table}/data")) == 1


def test_killed_run_leaves_the_old_pair_and_is_swept(spark, tmp_path):
    """A killed run cleans nothing up: its files lie there without a manifest."""
    table = str(tmp_path / "t")
    versions.replace(spark, table, writers(frame(spark, 4)))
    files.write_csv(frame(spark, 9), f"{table}/data/000000000002-dead/csv")
    (tmp_path / "t" / "manifests" / ".draft-dead").write_text("{")
    assert counts(spark, table) == (4, 4)
    assert versions.sweep(spark, table) == []
    assert versions.sweep(spark, table, older_than=-5) == ["data/000000000002-dead", "manifests/.draft-dead"]
    assert counts(spark, table) == (4, 4)
    versions.replace(spark, table, writers(frame(spark, 6)))
    assert counts(spark, table) == (6, 6)


def test_two_runs_at_once(spark, tmp_path):
    table = str(tmp_path / "t")
    versions.replace(spark, table, writers(frame(spark, 4)))

    def other_first(path):
        files.write_csv(frame(spark, 1), path)
        versions.replace(spark, table, writers(frame(spark, 8)))

    with pytest.raises(versions.ReplacedMeanwhile):
        versions.replace(spark, table, {"csv": other_first})
    assert counts(spark, table) == (8, 8)
    assert not [n for n in os.listdir(f"{table}/manifests") if n.startswith(".draft")]


def feed_lines(path, broken=False):
    lines = [json.dumps({k: [{"date": f"2020-1-{d}", "confirmed": d, "deaths": 0, "recovered": 1} for d in range(20, 29)]}) for k in "AB"]
    if broken:
        lines += ['{"C": [{"date": "2020-1-2']
    path.write_text("\n".join(lines))
    return {"map_feed": str(path)}


def test_failed_run_keeps_tables_and_leaves_no_scratch(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    inputs = feed_lines(tmp_path / "feed.json")
    jobs.run_jobs(spark, inputs, out, ["world"], "lines")
    since, before = session.mark(spark), set(os.listdir(session.scratch_base(spark)))
    monkeypatch.setattr(jobs.sinks, "write_json", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError, match="full"):
        jobs.run_jobs(spark, inputs, out, ["world"], "lines")
    assert session.mark(spark) == since and set(os.listdir(session.scratch_base(spark))) == before
    assert counts(spark, f"{out}/world") == (10, 10)


def test_broken_records_fail_or_are_set_aside(spark, tmp_path):
    out = str(tmp_path / "out")
    sound, broken = feed_lines(tmp_path / "a.json"), feed_lines(tmp_path / "b.json", broken=True)
    with pytest.raises(Exception, match="MALFORMED|JSON"):
        jobs.run_jobs(spark, broken, out, ["world"], "lines")
    with pytest.raises(ValueError):
        jobs.run_jobs(spark, broken, out, ["world"], "lines", broken="ignore")
    plain = jobs.run_jobs(spark, sound, f"{out}/plain", ["world"], "lines").collect()[0]
    told = jobs.run_jobs(spark, broken, out, ["world"], "lines", broken="set_aside").collect()[0]
    assert told["set_aside"] == 1 and told["lines"] == plain["lines"] == 10
    aside = spark.read.json(versions.current_path(spark, f"{out}/set_aside/map", "json")).collect()
    assert [r["reason"] for r in aside] == ["unreadable document"] and aside[0]["record"].startswith('{"C"')
    same = lambda t: sorted(map(tuple, spark.read.json(versions.current_path(spark, t, "json")).collect()))
    assert same(f"{out}/world") == same(f"{out}/plain/world")


def test_figures_come_with_the_write(spark, tmp_path, monkeypatch):
    rows = frame(spark, 50).withColumn("newConfirmed", F.col("confirmed") - 3)
    written, seen = quality.observed(rows, "ts", ["confirmed"])
    assert "CollectMetrics" in written._jdf.queryExecution().executedPlan().toString()
    files.write_json(written, str(tmp_path / "j"))
    want = quality.run_summary({"t": rows}, "ts", metrics=["confirmed"]).collect()[0].asDict()
    got = quality.observed_summary(spark, {"t": seen.get}).collect()[0].asDict()
    assert {k: got[k] for k in want} == want and got["negative_deltas"] == 3
    # No table is scanned again for the summary of a run.
    monkeypatch.setattr(quality, "run_summary", None)
    summary = jobs.run_jobs(spark, feed_lines(tmp_path / "feed.json"), str(tmp_path / "out"), ["world"], "lines")
    assert summary.first()["lines"] == 10
    empty, none = quality.observed(rows.where("confirmed < 0"), "ts", ["confirmed"])
    files.write_json(empty, str(tmp_path / "e"))
    assert none.get == {"lines": 0, "min_day": None, "max_day": None, "negative_deltas": 0}


def test_months(spark, tmp_path):
    path = str(tmp_path / "months")
    months.write_months(frame(spark, 100), path, "ts", ["key"])
    before = {d: set(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("month=")}
    assert len(before) == 5
    again = frame(spark, 100).where(months.month_of(F.col("ts")) == "2020-03").withColumn("confirmed", F.lit(-1).cast("long"))
    months.write_months(again, path, "ts", ["key"])
    after = {d: set(os.listdir(f"{path}/{d}")) for d in before}
    assert {d for d in before if before[d] != after[d]} == {"month=2020-03"}
    got = months.read_months(spark, path, DAY, ["2020-03", "2020-04"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [month" in plan
    assert {(r["month"], r["confirmed"] == -1) for r in got.collect()} == {("2020-03", True), ("2020-04", False)}
    assert got.count() == 61 and months.read_months(spark, path, DAY).count() == 100
