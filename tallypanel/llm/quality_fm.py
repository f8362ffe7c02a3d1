"""Factorisation machine for document quality.

The features are hashed words (a text's counts, damped and scaled to length 1), structure
statistics (capitals, digits, symbols, word and line lengths, repetition) and metadata (the
number of characters). Every feature has a weight and a short vector, and every pair of
features interacts by the product of their vectors. By the identity
``sum_{i<j} <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2`` a text is scored in
time linear in its features. Trained in numpy on a bounded sample of labelled documents and
calibrated on a fifth of it. Scoring needs no shuffle.

Defined results: null and empty texts score by their statistics alone; a null ``n_chars`` is
taken from the text; texts of any length are scored whole; repeated rows score alike; without
labels of both kinds every score is the share of label 1; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallypanel.llm.common import held_out, slices, text_bytes
from tallypanel.llm.labelled import MODULUS, MOST_PER_CLASS, labelled_sample, platt, sigmoid
from tallypanel.llm.words import WordTable, sums

FACTORS = 8
EPOCHS = 10
PREDICT_AT = 0.7

# Kinds of bytes that are counted.
_KINDS = np.zeros((256, 6), np.float32)
for _b in range(256):
    _c = chr(_b)
    _KINDS[_b] = (
        65 <= _b <= 90, _c in "0123456789", _c in "#*$%&|<>@^_~=+{}[]\\/", _c in ".,;:!?'\"()-", _b >= 128, (_b & 0xC0) != 0x80,
    )
N_DENSE = 14


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word.lower().strip(b".,;:!?\"'()"))


@dataclass
class Model:
    hashes: np.ndarray  # sorted; feature i + 1; feature 0 is for all other words
    mean: np.ndarray
    std: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray
    dense_w: np.ndarray
    dense_v: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)

    def describe(self, words: list[bytes]) -> list[np.ndarray]:
        """Feature and byte kinds of words."""
        n = len(words)
        feature = np.zeros(n, np.int32)
        if len(self.hashes) and n:
            h = np.fromiter(map(word_hash, words), np.uint64, n)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            feature = np.where(self.hashes[at] == h, at + 1, 0).astype(np.int32)
        lengths = np.fromiter(map(len, words), np.int64, n)
        kinds = sums(_KINDS[np.frombuffer(b"".join(words), np.uint8)], lengths)
        return [feature, kinds]


class Features:
    """Sparse and dense features of texts."""

    def __init__(self, model: Model):
        self.table = WordTable(model.describe)
        self.size = len(model.hashes) + 1

    def read(self, texts: list[bytes], chars: list[int | None]):
        """Text, feature and value of each sparse entry; the dense features."""
        numbers, counts = self.table.numbers([t.split() for t in texts])
        feature, kinds = self.table.columns[0][numbers], self.table.columns[1][numbers]
        owner = np.repeat(np.arange(len(texts)), counts)
        key, count = np.unique(owner * self.size + feature, return_counts=True)
        row, column = key // self.size, key % self.size
        value = np.log1p(count).astype(np.float32)
        per_text = np.bincount(row, minlength=len(texts))
        value /= np.sqrt(np.maximum(sums(value**2, per_text), 1e-9))[row]
        span = int(numbers.max(initial=0)) + 1
        distinct = np.bincount(np.unique(owner * span + numbers) // span, minlength=len(texts))
        total = sums(kinds, counts)
        words = np.maximum(counts, 1)
        length = np.maximum(total[:, 5], 1)
        lines = [t.split(b"\n") for t in texts]
        n_lines = np.array([len(x) for x in lines])
        repeated = np.array([len(x) - len(set(x)) for x in lines])
        known = np.array([len(t) if c is None else c for t, c in zip(texts, chars)], float)
        loud = sums((kinds[:, 0] >= 2).astype(np.float32), counts)
        with_symbol = sums((kinds[:, 2] > 0).astype(np.float32), counts)
        long_words = sums((kinds[:, 5] > 18).astype(np.float32), counts)
        dense = np.stack(
            [
                total[:, 0] / length, total[:, 1] / length, total[:, 2] / length, total[:, 3] / length,
                total[:, 4] / length, total[:, 5] / words, loud / words, with_symbol / words, long_words / words,
                np.log1p(counts), np.log1p(known), repeated / n_lines, np.log1p(counts / n_lines),
                distinct / words**0.8,
            ],
            1,
        )
        return row, column, value, per_text, dense


def _raw(model: Model, value, column, per_text, dense):
    """Score before calibration, and the summed vectors."""
    x = value[:, None] * model.v[column]
    total = sums(x, per_text) + dense @ model.dense_v
    squares = sums(x**2, per_text) + (dense**2) @ (model.dense_v**2)
    linear = model.bias + sums(value * model.w[column], per_text) + dense @ model.dense_w
    return linear + 0.5 * (total**2 - squares).sum(1), total


class Scorer:
    def __init__(self, model: Model):
        self.model, self.features = model, Features(model)

    def logits(self, texts: list[bytes], chars: list[int | None]) -> np.ndarray:
        _, column, value, per_text, dense = self.features.read(texts, chars)
        dense = np.clip((dense - self.model.mean) / self.model.std, -4, 4).astype(np.float32)
        return _raw(self.model, value, column, per_text, dense)[0].astype(float)

    def scores(self, texts: list[bytes], chars: list[int | None]) -> np.ndarray:
        a, b = self.model.scale
        return sigmoid(a * self.logits(texts, chars) + b)


def _vocabulary(texts: list[bytes], least: int = 3, most: int = 40_000) -> np.ndarray:
    seen: dict[int, int] = {}
    known: dict[bytes, int] = {}
    for text in texts:
        for word in {known.get(w) or known.setdefault(w, word_hash(w)) for w in set(text.split())}:
            seen[word] = seen.get(word, 0) + 1
    common = sorted((h for h, n in seen.items() if n >= least), key=lambda h: (-seen[h], h))[:most]
    return np.array(sorted(common), np.uint64)


def train(texts: list[bytes], chars: list[int | None], y: np.ndarray, seed: int = 11) -> Model:
    """Adagrad over batches of documents."""
    rng = np.random.default_rng(seed)
    hashes = _vocabulary(texts)
    n = len(hashes) + 1
    model = Model(
        hashes, np.zeros(N_DENSE), np.ones(N_DENSE), 0.0, np.zeros(n, np.float32),
        rng.normal(0, 0.05, (n, FACTORS)).astype(np.float32), np.zeros(N_DENSE, np.float32),
        rng.normal(0, 0.05, (N_DENSE, FACTORS)).astype(np.float32),
    )
    if not len(texts) or y.min() == y.max():
        share = float(np.mean(y)) if len(texts) else 0.0
        model.bias = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
        model.v[:] = 0
        model.dense_v[:] = 0
        return model
    row, column, value, per_text, dense = Features(model).read(texts, chars)
    model.mean, model.std = dense.mean(0), dense.std(0) + 1e-3
    dense = np.clip((dense - model.mean) / model.std, -4, 4).astype(np.float32)
    begin = np.concatenate([[0], np.cumsum(per_text)])
    seen = {k: np.full(a.shape, 1e-2, np.float32) for k, a in (("w", model.w), ("v", model.v), ("dw", model.dense_w), ("dv", model.dense_v))}
    rate, decay = 0.1, 2e-4
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), 32):
            chosen = order[a : a + 32]
            at = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in chosen])
            c, x, d, per = column[at], value[at], dense[chosen], per_text[chosen]
            z, total = _raw(model, x, c, per, d)
            g = ((sigmoid(z) - y[chosen]) / len(chosen)).astype(np.float32)
            gx, gs = np.repeat(g, per), np.repeat(total, per, axis=0)
            unique, back = np.unique(c, return_inverse=True)
            gw = np.bincount(back, gx * x, len(unique)).astype(np.float32) + decay * model.w[unique]
            gv = np.zeros((len(unique), FACTORS), np.float32)
            np.add.at(gv, back, (gx * x)[:, None] * (gs - x[:, None] * model.v[c]))
            gv += decay * model.v[unique]
            gdw = d.T @ g + decay * model.dense_w
            gdv = d.T @ (g[:, None] * total) - (g[:, None] * d**2).sum(0)[:, None] * model.dense_v + decay * model.dense_v
            model.bias -= rate * float(g.sum())
            for name, array, grad, rows in (
                ("w", model.w, gw, unique), ("v", model.v, gv, unique),
                ("dw", model.dense_w, gdw, slice(None)), ("dv", model.dense_v, gdv, slice(None)),
            ):
                seen[name][rows] += grad**2
                array[rows] -= (rate * grad / np.sqrt(seen[name][rows])).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = MOST_PER_CLASS) -> Model:
    sample = labelled_sample(docs, labels, "quality", ("n_chars",), per_class)
    aside = np.array([xxhash.xxh64_intdigest(t) % 5 == 0 for t in sample.texts], bool)

    def pick(out: bool):
        keep = [i for i, a in enumerate(aside) if a == out]
        return [sample.texts[i] for i in keep], [sample.extra[i][0] for i in keep], sample.y[keep], sample.weight[keep]

    texts, chars, y, _ = pick(False)
    model = train(texts, chars, y)
    texts, chars, y_cal, weight = pick(True)
    if len(y) and len(y_cal) and y.min() != y.max():
        model.scale = platt(Scorer(model).logits(texts, chars), y_cal, weight)
    return model


def quality(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row."""

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch, "text"):
                scores = scorer.scores(part.column("text").to_pylist(), part.column("chars").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["row", "score"])

    rows = docs.select(F.struct("doc_id").alias("row"), text_bytes().alias("text"), F.col("n_chars").cast("long").alias("chars"))
    kind = rows.schema["row"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"row {kind}, score double").select("row.doc_id", "score")
    return scored.select(
        "doc_id",
        held_out(MODULUS).alias("held_out"),
        "score",
        (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"),
    )
