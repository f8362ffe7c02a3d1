import math
from collections import defaultdict

import pytest
from llm_helpers import documents, frame, words
from pyspark.sql import functions as F

from tallypanel.llm import mixing


def targets(sizes):
    """Stop at three times the size, reshare the excess by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in stopped)
        open_ = [s for s in names if s not in stopped]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s] * (1 + 1e-12)}
        if not above:
            return {s: float(3 * sizes[s]) if s in stopped else share[s] for s in names}
        stopped |= above


def check(spark, rows):
    got = [r.asDict() for r in mixing.mix(frame(spark, rows)).collect()]
    sizes = defaultdict(int)
    for row in rows:
        sizes[row[3]] += len(words(row[1]))
    want = targets(dict(sizes))
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    return got, sizes, want, taken


def test_edges(spark):
    rows = documents()
    got, *_ = check(spark, rows)
    assert sorted(r["size"] for r in got) == sorted(len(words(r[1])) for r in rows)
    again = mixing.mix(frame(spark, rows)).select("doc_id", "copies", "taken").collect()
    assert sorted(map(tuple, again), key=repr) == sorted(((r["doc_id"], r["copies"], r["taken"]) for r in got), key=repr)


def test_targets_are_met_and_capped(spark):
    rows = [(i, "w " * (1 + i % 37), "en", f"s{i % 5 if i % 3 else 0}", 0, "", "", 0, 0) for i in range(3000)]
    rows += [(9000 + i, "w " * 5, "en", f"tiny{i % 3}", 0, "", "", 0, 0) for i in range(12)]
    _, sizes, want, taken = check(spark, rows)
    for source, target in want.items():
        assert abs(taken[source] - target) <= 40 + 0.002 * target, source
    assert any(want[s] == 3 * sizes[s] for s in sizes)
    assert math.isclose(sum(want.values()), sum(sizes.values()))


def test_documents(spark):
    docs = frame(spark)
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    copies = mixing.mix(docs).groupBy("doc", "fp").agg(F.sum("copies").alias("n")).agg(F.sum("n")).first()[0]
    assert got.count() == copies
    assert mixing.mixed_documents(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [])).count() == 0


def test_no_words(spark):
    rows = [(1, "", "en", "a", 0, "", "", 0, 0), (2, None, "en", None, 0, "", "", 0, 0)]
    assert {(r["target"], r["taken"]) for r in mixing.mix(frame(spark, rows)).collect()} == {(0.0, 0)}


def test_native(spark):
    plan = mixing.mixed_documents(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
