"""A bounded sample of labelled documents, and calibration of scores."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallypanel.llm.common import held_out, text_bytes

# The bounds of what a classifier is fitted on.
MOST_PER_CLASS = 2000
MOST_BYTES = 48_000_000
MODULUS = 4


@dataclass
class Sample:
    texts: list[bytes]
    y: np.ndarray
    weight: np.ndarray  # how many labelled documents a sampled one stands for
    extra: list[tuple]
    ids: list[int] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.y)


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, y`` of the labelled documents outside the held-out ids."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(MODULUS))
    return known.groupBy("doc_id").agg(F.max("y").alias("y"))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, extra: tuple[str, ...] = (), per_class: int = MOST_PER_CLASS
) -> Sample:
    """At most ``per_class`` documents of each label and ``MOST_BYTES`` of text, by hash
    of the id, from those outside the held-out ids. Of several labels for an id the
    greatest counts; other values than 0 and 1 and null ids don't count."""
    known = known_labels(labels, label)
    totals = dict(known.groupBy("y").count().collect())
    taken = [
        known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)
    ]
    chosen = F.broadcast(taken[0].unionByName(taken[1]))
    columns = [F.col(c) for c in extra]
    rows = docs.select("doc_id", text_bytes().alias("text"), *columns).join(chosen, "doc_id")
    sized = rows.select("doc_id", F.length("text").alias("size")).groupBy("doc_id").agg(F.max("size").alias("size"))
    sizes = sorted(((r["doc_id"], r["size"]) for r in sized.collect()), key=lambda r: (r[0] * 0x9E3779B97F4A7C15) % 2**64)
    room, keep = MOST_BYTES, []
    for doc_id, size in sizes:
        room -= size
        if room < 0 and keep:
            break
        keep.append(doc_id)
    if len(keep) < len(sizes):
        rows = rows.where(F.col("doc_id").isin(keep))
    got = sorted(rows.dropDuplicates(["doc_id"]).collect(), key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in got], np.int64)
    have = np.bincount(y, minlength=2)
    weight = np.array([totals.get(k, 0) / max(1, have[k]) for k in (0, 1)])[y] if len(y) else np.zeros(0)
    return Sample([bytes(r["text"]) for r in got], y, weight, [tuple(r[c] for c in extra) for r in got], [r["doc_id"] for r in got])


def platt(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """``a, b`` so that sigmoid(a * logit + b) fits the weighted labels; a >= 0."""
    a, b = 1.0, 0.0
    if not len(y) or y.min() == y.max():
        return a, b
    w = weight / weight.sum()
    # Softened targets keep the fit finite when the classes are separated.
    n1, n0 = (weight * (y == 1)).sum(), (weight * (y == 0)).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(1e-6, float(np.abs(logit).max()))
    x = np.stack([logit / scale, np.ones_like(logit)], 1)
    beta = np.array([scale, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        grad = x.T @ (w * (p - target)) + np.array([1e-6, 0]) * beta
        hess = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return max(1e-3, float(beta[0] / scale)), float(beta[1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))
