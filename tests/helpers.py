"""Small fixtures and a plain-Python account of the expected results."""

from __future__ import annotations

import datetime as dt
import importlib.util
import math
import random
from pathlib import Path

FIRST = dt.date(2020, 1, 22)
METRICS = ["confirmed", "recovered", "deaths"]
SCHEMA = "key string, ts date, confirmed double, recovered double, deaths double"

# The hand-made panel: ``confirmed`` by day; the other metrics are half and a tenth of it.
SERIES = {
    "a": [0, 0, 1, 2, 4, 8, 16, 32, 64, 128],
    "b": [10, 8, 9, 12],
    "c": [5, "absent", 7],
    "d": [5, None, 7, 6, 8],
    "e": [-1, 0],
    "g": [4] * 8,
}


def day(n: int) -> dt.date:
    return FIRST + dt.timedelta(days=n)


def panel_rows(series=SERIES):
    rows = []
    for key, values in series.items():
        for n, v in enumerate(values):
            if v == "absent":
                continue
            parts = (None, None) if v is None else (v / 2, v / 10)
            rows.append((key, day(n), None if v is None else float(v), *parts))
    return rows


def panel(spark, series=SERIES):
    return spark.createDataFrame(panel_rows(series), SCHEMA)


def random_series(seed: int, keys: int = 6, days: int = 15) -> dict:
    """Gaps, decreases, zeros, no missing values."""
    rng = random.Random(seed)
    out = {}
    for k in range(keys):
        values = [
            "absent" if rng.random() < 0.3 else rng.choice([0, 0, 1, 2, 3, 5, 8, 13]) for _ in range(days)
        ]
        if any(v != "absent" for v in values):
            out[f"k{k}"] = values
    return out


def column(df, key, name, order="ts", key_column="key"):
    """Values of ``name`` for one key in day order."""
    rows = df.where(df[key_column] == key).orderBy(order).collect()
    return [r[name] for r in rows]


# --- expected results, row by row -------------------------------------------------


def deltas(values):
    out = []
    for i, v in enumerate(values):
        previous = values[i - 1] if i else None
        out.append(v if v is None or previous is None else v - previous)
    return out


def repair_pass(values):
    """A value that is not >= its predecessor takes the last accepted one."""
    accepted, last, out = [], None, []
    for i, v in enumerate(values):
        if i == 0:
            ok = True
        else:
            p = values[i - 1]
            ok = v is not None and p is not None and v >= p
        accepted.append(v if ok else None)
    for v, a in zip(values, accepted):
        last = a if a is not None else last
        out.append(last if last is not None else v)
    return out


def growth(values):
    out = []
    for i, v in enumerate(values):
        p = values[i - 1] if i else None
        out.append((v - p) / p if p else 0.0)
    return out


def average(values, n=7):
    return [sum(values[i - n + 1 : i + 1]) / n if i >= n - 1 else 0.0 for i in range(len(values))]


def doubling(rate):
    if rate + 1 <= 0 or math.log10(rate + 1) == 0:
        return 0
    return int(round(math.log10(2) / math.log10(rate + 1), 0))


def completed(by_key: dict) -> dict:
    """``{key: {day: row}}`` on all observed days and the day before the first; None = absent."""
    days = sorted({d for rows in by_key.values() for d in rows})
    days = [days[0] - dt.timedelta(days=1), *days]
    return {k: {d: rows.get(d) for d in days} for k, rows in by_key.items()}


def trimmed(rows: list, positive) -> list:
    """Indexes of positive rows and of zero rows followed by one."""
    keep = []
    for i, r in enumerate(rows):
        onset = positive(r) == 0 and i + 1 < len(rows) and positive(rows[i + 1]) > 0
        if positive(r) > 0 or onset:
            keep.append(i)
    return keep


def spark_home(folder) -> str:
    """Spark's home with a work folder of its own, for a local cluster, whose workers end the driver
    if they cannot make theirs."""
    home = Path(folder) / "home"
    (home / "work").mkdir(parents=True)
    for path in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if path.name != "work":
            (home / path.name).symlink_to(path)
    return str(home)
