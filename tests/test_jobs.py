"""The jobs from landed files, against a plain-Python account of each table."""

import csv
import datetime as dt
import json
import os
import random

import pytest
from helpers import average, completed, deltas, doubling, growth, repair_pass, trimmed

from tallypanel import session
from tallypanel.plans import jobs
from tallypanel.sinks import versions

METRICS = ["confirmed", "recovered", "deaths"]
NEW = {"confirmed": "newConfirmed", "recovered": "newRecovered", "deaths": "newDeaths"}
START = dt.date(2020, 3, 1)
NAMES = {"Old B": "B", "Merge": "C"}
PLACES = {"A": (1.5, 2.5), "C": (3.5, -4.5), "D": (None, None)}


def counters(rng, days=16):
    """Mostly rising, sometimes corrected downwards, with absent days."""
    total, out = 0, {}
    for n in range(days):
        total = max(0, total + rng.choice([0, 0, 1, 3, 10, -2]))
        if rng.random() < 0.8:
            out[START + dt.timedelta(days=n)] = (total, total // 2, total // 10)
    return out


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    rng = random.Random(11)
    root = tmp_path_factory.mktemp("landed")
    entities = {k: counters(rng) for k in ["A", "Old B", "C", "Merge", "D", "E"]}
    text = lambda d: f"{d.year}-{d.month}-{d.day}"
    feed = {
        k: [{"date": text(d), "confirmed": c, "recovered": r, "deaths": x} for d, (c, r, x) in rows.items()]
        for k, rows in entities.items()
    }
    days = sorted({d for rows in entities.values() for d in rows})
    history = []
    for d in days:
        here = {k: rows[d] for k, rows in entities.items() if d in rows}
        total = [sum(v[i] for v in here.values()) for i in range(3)]
        history.append(
            {
                "day": d.isoformat(),
                "summary": {"total": total[0], "discharged": total[1], "deaths": total[2]},
                "regional": [
                    {
                        "loc": k, "totalConfirmed": c, "discharged": r, "deaths": x,
                        "confirmedCasesForeign": 0, "confirmedCasesIndian": c,
                    }
                    for k, (c, r, x) in here.items()
                ],
            }
        )
    (root / "map.json").write_text(json.dumps(feed))
    (root / "history.json").write_text(json.dumps({"data": history}))
    names = "current,subs\n" + "".join(f"{k},{v}\n" for k, v in NAMES.items())
    (root / "names.csv").write_text(names)
    places = "".join(f"X,{'' if a is None else a},{'' if b is None else b},{k}\n" for k, (a, b) in PLACES.items())
    (root / "places.csv").write_text("countryCode,lat,long,country\n" + places)
    inputs = {
        "map_feed": str(root / "map.json"),
        "history_feed": str(root / "history.json"),
        "country_names": str(root / "names.csv"),
        "state_names": str(root / "names.csv"),
        "coordinates": str(root / "places.csv"),
    }
    return entities, inputs, str(root / "out")


@pytest.fixture(scope="module")
def tables(spark, landed):
    _, inputs, out = landed
    summary = {r["dataset"]: r for r in jobs.run_jobs(spark, inputs, out).collect()}
    assert list(summary) == list(jobs.JOBS)
    assert str(summary["world"]["max_day"]) == "2020-03-16" and summary["world"]["lines"] == 17
    path = lambda name, kind: versions.current_path(spark, f"{out}/{name}", kind)
    return {name: (read_csv(path(name, "csv")), read_json(path(name, "json"))) for name in jobs.JOBS}


def part_files(path):
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.startswith("part-"))


def read_csv(path):
    rows = []
    for file in part_files(path):
        with open(file, newline="", encoding="utf-8") as f:
            rows.extend(csv.DictReader(f))
    return rows


def read_json(path):
    return [json.loads(line) for file in part_files(path) for line in open(file, encoding="utf-8")]


def derive(rows):
    """``rows``: day-ordered dicts with the metrics; adds the derived columns."""
    for m in METRICS:
        for row, new in zip(rows, deltas([r[m] for r in rows])):
            row[NEW[m]] = new
    rates = growth([r["confirmed"] for r in rows])
    averages = average(rates)
    for row, rate, avg in zip(rows, rates, averages):
        row.update(growthRate=rate, movingAvg=avg, doublingTime=doubling(avg))
    return rows


ZERO = dict.fromkeys(
    [*METRICS, *NEW.values(), "growthRate", "movingAvg", "doublingTime", "active"], 0
)


def repair(rows):
    for m in METRICS:
        values = [r[m] for r in rows]
        while any(d < 0 for d in deltas(values)[1:]):
            values = repair_pass(values)
        for row, v in zip(rows, values):
            row[m] = v
    return rows


def keyed(panel):
    """``{key: day-ordered rows}`` to the trimmed table."""
    out = []
    by_key = {k: derive(repair(rows)) for k, rows in panel.items()}
    days = {}
    for k, rows in by_key.items():
        for r in rows:
            days.setdefault(k, {}).setdefault(r["timestamp"], []).append(r)
    for k, by_day in completed(days).items():
        full = []
        for d, rows in by_day.items():
            full.extend(rows if rows else [{**ZERO, "timestamp": d}])
        for n, i in enumerate(trimmed(full, lambda r: r["confirmed"])):
            r = full[i]
            active = r["confirmed"] - r["deaths"] - r["recovered"]
            out.append({**r, "key": k, "Days": n, "active": active})
    return out


def check(got, want, columns, key=None):
    csv_rows, json_rows = got
    assert [list(r) for r in csv_rows[:1]] == [columns] and len(csv_rows) == len(json_rows) == len(want)
    for c, j, w in zip(csv_rows, json_rows, want):
        if key:
            w[key] = w["key"]
        w["timestamp"] = w["timestamp"].strftime("%m-%d-%Y")
        for name in columns:
            expected = w[name]
            if isinstance(expected, str):
                assert c[name] == expected == j[name]
            elif expected is None:
                assert c[name] == "" and j[name] is None
            else:
                assert float(c[name]) == pytest.approx(expected, abs=1e-12)
                assert j[name] == pytest.approx(expected, abs=1e-9)


def totals(entities, rename=None):
    """Rows summed by (renamed) name and day."""
    out = {}
    for k, rows in entities.items():
        k = (rename or {}).get(k, k)
        for d, v in rows.items():
            at = out.setdefault(k, {}).setdefault(d, [0, 0, 0])
            for i in range(3):
                at[i] += v[i]
    return {
        k: [dict(zip(["timestamp", *METRICS], [d, *v])) for d, v in sorted(rows.items())]
        for k, rows in out.items()
    }


def test_regional_table(tables, landed):
    entities = landed[0]
    want = sorted(keyed(totals(entities, NAMES)), key=lambda r: (r["key"], r["timestamp"]))
    check(tables["regional"], want, jobs.REGIONAL_COLUMNS, "state")


def test_country_table_keeps_merged_names_apart(tables, landed):
    entities = landed[0]
    panel = {}
    for former, rows in entities.items():
        name = NAMES.get(former, former)
        for d, v in rows.items():
            row = dict(zip(["timestamp", *METRICS], [d, *v]))
            panel.setdefault(name, []).append({**row, "former": former})
    for rows in panel.values():
        rows.sort(key=lambda r: (r["timestamp"], r["former"]))
    want = keyed(panel)
    for row in want:
        row["lat"], row["long"] = PLACES.get(row["key"], (None, None))
    order = lambda r: (r["key"], r["timestamp"], r["Days"])
    got = tables["country"]
    by_number = lambda r: (r["country"], dt.datetime.strptime(r["timestamp"], "%m-%d-%Y"), float(r["Days"]))
    check((sorted(got[0], key=by_number), sorted(got[1], key=by_number)), sorted(want, key=order), jobs.COUNTRY_COLUMNS, "country")


def test_history_table_is_seeded_before_deltas(tables, landed):
    rows = list(totals({"all": {}} | {k: v for k, v in landed[0].items()}, dict.fromkeys(landed[0], "all")).values())[0]
    seed = {"timestamp": rows[0]["timestamp"] - dt.timedelta(days=1), "confirmed": 0, "recovered": 0, "deaths": 0}
    want = derive([seed, *rows])
    for n, r in enumerate(want):
        r["Days"] = n
    check(tables["history"], want, jobs.HISTORY_COLUMNS)


def test_world_table(tables, landed, spark):
    rows = list(totals(landed[0], dict.fromkeys(landed[0], "all")).values())[0]
    for r in rows:
        r["active"] = r["confirmed"] - r["recovered"] - r["deaths"]
    seed = {**ZERO, "timestamp": rows[0]["timestamp"] - dt.timedelta(days=1)}
    want = [seed, *derive(rows)]
    flat = []
    for n, r in enumerate(want):
        flat.append({**r, "Days": n, "growthRate": 0, "movingAvg": 0, "doublingTime": 0})
    check(tables["world"], flat, jobs.WORLD_COLUMNS)

    feed = jobs.load_feed(spark, "map", landed[1])
    got = jobs.world_job(feed, growth_keys=()).orderBy("timestamp").collect()
    assert [r["growthRate"] for r in got] == pytest.approx([r["growthRate"] for r in want])
    assert [r["movingAvg"] for r in got] == pytest.approx([r["movingAvg"] for r in want])
    assert [r["doublingTime"] for r in got] == [r["doublingTime"] for r in want]


@pytest.mark.parametrize("max_rows,segments", [(0, 1), (0, 5), (0, 60), (16, 4)])
def test_country_table_in_segments(spark, landed, max_rows, segments):
    """With 16 rows allowed only the country of two names is cut."""
    feed = jobs.load_feed(spark, "map", landed[1])
    names = spark.createDataFrame(list(NAMES.items()), "current string, subs string")
    places = spark.createDataFrame(
        [(k, *v) for k, v in PLACES.items()], "country string, lat double, long double"
    )
    plain = jobs.country_job(feed, names, places)
    cut = jobs.country_job(feed, names, places, max_rows=max_rows, segments=segments)
    assert plain.dtypes == cut.dtypes

    assert rows_of(plain) == rows_of(cut)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rows_without_a_country_are_cut_too(spark):
    rng = random.Random(2)
    rows = [
        (name, START + dt.timedelta(days=n), rng.randint(0, 90), n, 0)
        for name in (None, "A", "B")
        for n in range(40 if name is None else 3)
    ]
    feed = spark.createDataFrame(rows, "country string, timestamp date, confirmed long, recovered long, deaths long")
    names = spark.createDataFrame([("x", "y")], "current string, subs string")
    places = spark.createDataFrame([("A", 1.0, 2.0)], "country string, lat double, long double")
    plain = jobs.country_job(feed, names, places)
    cut = jobs.country_job(feed, names, places, max_rows=10, segments=5)
    assert rows_of(plain) == rows_of(cut) and len(rows_of(cut)) > 40


def test_large_counters(spark):
    """A slow growth of large numbers doubles after more days than an int holds."""
    rows = [(START + dt.timedelta(days=n), 10**11 + n, n, 0) for n in range(12)]
    feed = spark.createDataFrame(rows, "timestamp date, confirmed long, recovered long, deaths long")
    got = jobs.history_job(feed).orderBy("timestamp").collect()
    assert got[-1]["doublingTime"] > 2**31
    assert [r["Days"] for r in got] == list(range(13))


def test_two_rows_for_a_day_fail(spark):
    rows = [(START, 1, 0, 0), (START, 2, 0, 0)]
    feed = spark.createDataFrame(rows, "timestamp date, confirmed long, recovered long, deaths long")
    with pytest.raises(Exception, match="two rows for the day"):
        jobs.history_job(feed).collect()


def test_a_run_leaves_no_scratch(spark, landed, tmp_path):
    since = session.mark(spark)
    base = session.scratch_base(spark)
    before = set(os.listdir(base))
    summary = jobs.run_jobs(spark, landed[1], str(tmp_path / "out"), ["country", "regional"])
    assert {r["dataset"]: r["negative_deltas"] for r in summary.collect()} == {"country": 0, "regional": 0}
    assert session.mark(spark) == since and set(os.listdir(base)) == before


def test_scratch_without_the_setting(spark, monkeypatch):
    class Conf:
        def __init__(self, master):
            self.master = master

        def get(self, key, default=None):
            return {"spark.master": self.master}.get(key, default)

    class Fake:
        sparkContext = spark.sparkContext  # noqa: N815

        def __init__(self, master):
            self.conf = Conf(master)

    path = session.scratch_base(Fake("local[4]"))
    assert os.path.isdir(path) and session.scratch_base(Fake("local[4]")) == path
    with pytest.raises(ValueError, match="all executors share"):
        session.scratch_base(Fake("spark://cluster:7077"))

    class Set(Conf):
        def get(self, key, default=None):
            return "/tmp/plain" if key == session.SETTING else super().get(key, default)

    fake = Fake("yarn")
    fake.conf = Set("yarn")
    with pytest.raises(ValueError, match="of each machine"):
        session.scratch_base(fake)


@pytest.mark.parametrize("master", ["local-cluster[2,3,1024]", "local[2]"])
def test_a_plain_scratch_path_serves_where_all_executors_share_the_machine(spark, master):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": master, session.SETTING: "/tmp/plain/"}.get(key, default)

    class Fake:
        sparkContext = spark.sparkContext  # noqa: N815
        conf = Conf()

    assert session.scratch_base(Fake()) == "/tmp/plain"


def test_regional_table_with_a_large_lookup(spark, landed):
    feed = jobs.load_feed(spark, "regional", landed[1])
    names = spark.createDataFrame(list(NAMES.items()), "current string, subs string")
    small, large = (jobs.regional_job(feed, names, max_bytes=b) for b in (1 << 20, 0))
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
