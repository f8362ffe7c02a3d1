import math

import numpy as np
from llm_helpers import reachable
from pyspark.sql import functions as F

from tallypanel.llm import nn_descent as nn

SCHEMA = "vec_id long, embedding array<float>, label int, u int, grp string"


def plain(rows, threshold=nn.THRESHOLD):
    x = []
    for _, e, label in rows:
        ok = e is not None and label is not None and len(e) and None not in e and all(map(math.isfinite, e)) and any(e)
        v = np.array(e, np.float32).astype(float) if ok else None
        x.append(v / np.linalg.norm(v) if ok else None)
    m = len(rows)
    linked = [
        [j for j in range(m) if i != j and x[i] is not None and x[j] is not None and rows[i][2] == rows[j][2]
         and len(x[i]) == len(x[j]) and x[i] @ x[j] >= threshold]
        for i in range(m)
    ]
    out = []
    for group in reachable(linked).values():
        root = min(rows[i][0] for i in group)
        out += [(rows[i][0], len(linked[i]), root, rows[i][0] == root) for i in group]
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted(map(tuple, nn.near_duplicates(df).collect()))


def cluster(rng, centre, n, noise):
    return [(centre + rng.normal(0, noise, len(centre))).tolist() for _ in range(n)]


def test_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for label in (0, 1):
        for _ in range(60):
            rows += [(len(rows) + k, e, label) for k, e in enumerate(cluster(rng, rng.normal(size=16), 1 + label, 0.05))]
    rows += [(1000 + i, e, 0) for i, e in enumerate(cluster(rng, rng.normal(size=16), 45, 0.03))]
    # A loose chain, whose ends do not link directly.
    a, b = rng.normal(size=16), rng.normal(size=16)
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    rows += [(2000 + i, (a * math.cos(i / 4) + b * math.sin(i / 4)).tolist(), 1) for i in range(6)]
    bad = [None, [], [0.0] * 16, [1.0, None] * 8, [float("nan")] * 16, [float("inf")] + [1.0] * 15]
    rows += [(3000 + i, e, 0) for i, e in enumerate(bad)]
    rows += [(3100, rows[0][1], None), (3101, rows[0][1], 1), (3102, [1.0, 0.0], 0), (3103, [1.0, 0.001], 0)]
    assert found(spark, rows) == plain(rows)


def test_two_dense_groups_with_one_bridge(spark):
    """Both groups saturate every list, so the link between them must come from the blocks."""
    rng = np.random.default_rng(4)
    a, b = np.zeros(16), np.zeros(16)
    a[0], b[0], b[1] = 1, math.cos(0.42), math.sin(0.42)
    rows = [(i, e, 0) for i, e in enumerate(cluster(rng, a, 30, 0.012) + cluster(rng, b, 30, 0.012))]
    want = plain(rows)
    assert found(spark, rows) == want


def test_empty(spark):
    assert nn.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_rows(spark):
    row = (7, [1.0, 2.0, 3.0], 1)
    got = found(spark, [row, row, (9, [1.0, 2.0, 3.01], 1)])
    assert [g[2] for g in got] == [7, 7, 7] and [g[3] for g in got] == [True, True, False]


def planted(n=6000, pairs=600, hot=500, size=64, seed=2):
    """Random vectors, some with a partner at cosine 0.94 that nothing else leads to, and a group
    whose vectors are all linked."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(pairs, size))
    side -= (side * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = 0.94 * x[:pairs] + (1 - 0.94**2) ** 0.5 * side
    centre = rng.normal(size=size)
    group = centre / np.linalg.norm(centre) + rng.normal(0, 0.01, (hot, size))
    return np.concatenate([x, near, group]).astype(np.float32)


def test_isolated_pairs_beside_a_hot_group(spark):
    n, pairs, hot = 6000, 600, 500
    rows = [(i, v.tolist(), 1) for i, v in enumerate(planted(n, pairs, hot))]
    got = {r[0]: r for r in found(spark, rows)}
    hits = sum(got[i][2] == got[n + i][2] == i and got[i][1] == got[n + i][1] == 1 for i in range(pairs))
    assert hits >= 0.99 * pairs
    assert all(got[i][1] == hot - 1 for i in range(n + pairs, n + pairs + hot))
    assert sum(r[1] > 0 for r in got.values()) <= 2 * pairs + hot


def test_recall_is_told_apart(spark):
    """A hot group that is found whole does not hide pairs that are missed."""
    rows = spark.createDataFrame([(i, v.tolist(), 1, 0, "") for i, v in enumerate(planted(0 + 400, 100, 300))], SCHEMA)
    _, good, dtype = nn.vectors(rows)
    good = good.select("u", "grp", "vec")
    full = spark.range(500, 800).select(F.col("id").alias("u"))
    links = full.select(F.col("u").alias("a"), F.lit(500).cast("long").alias("b"), F.lit(299).cast("long").alias("links"))
    assert nn.recalls(links, full, good, dtype, nn.THRESHOLD) == (0.0, 1.0)
    half = spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 400).alias("b"), F.lit(1).cast("long").alias("links"))
    both = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "links"))
    assert nn.recalls(links.unionByName(both), full, good, dtype, nn.THRESHOLD) == (0.5, 1.0)
