"""Convolutional text classifier for toxicity.

A word is lower-cased and freed of punctuation at its ends; it and its first four letters are
hashed, so that inflected forms are known by their stem. Hashes seen in at least two sampled
documents have an embedding (the ``MOST_HASHES`` commonest of them; a bound of the fit), all others
none, and a word's embedding is the sum of its two.
Filters of several widths run
over the embeddings, each keeps its maximum over the text, and a logistic layer reads the
maxima. Trained in numpy on a bounded sample of labelled documents (``labelled``); the score
is calibrated on a fifth of it. A rejection threshold for each language is chosen from counts of
labels and scores over all labelled documents but the held-out and the fitted ones.
Every text is scored once: scores are stored, and labels meet them there. Scoring needs no
shuffle: the convolutions of an embedding are tables, and memory is bounded by a block of words.

Defined results: null and empty texts score as a text without words; texts of any length are
scored whole; repeated rows score alike; an unknown or null language has the threshold of all;
without labels of both kinds every score is the share of label 1; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallypanel.llm.common import held, held_out, pack_rows, slices, text_bytes
from tallypanel.llm.labelled import MODULUS, MOST_PER_CLASS, known_labels, labelled_sample, platt, sigmoid
from tallypanel.llm.words import WordTable, starts_of
from tallypanel.session import materialize

PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WIDTHS = (1, 2, 3)
FILTERS = 8
SIZE = 8
EPOCHS = 6
STEM = 4
MOST_HASHES = 80_000
BLOCK = 16_384  # words that are convolved at a time
PREDICT_AT = 0.3
THRESHOLDS = (0.3, 0.9)  # the range of a language's threshold
BINS = 1000  # of scores, when thresholds are chosen
LOWEST = -1e9


def word_hashes(word: bytes) -> tuple[int, int]:
    """Of the word and of its stem."""
    plain = word.lower().strip(PUNCTUATION)
    stem = plain.decode("utf-8", "replace")[:STEM].encode()
    return xxhash.xxh64_intdigest(plain), xxhash.xxh64_intdigest(b"^" + stem)


@dataclass
class Model:
    hashes: np.ndarray  # sorted; row i + 1 of the embeddings; row 0 is for pads and others
    embedding: np.ndarray
    filters: list[np.ndarray]  # (width, SIZE, FILTERS)
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    fitted: list[int] = field(default_factory=list)  # ids of the documents it was trained on
    totals: tuple[float, float] = (0.0, 0.0)  # documents of each label, with these

    def rows_of(self, words: list[bytes]) -> list[np.ndarray]:
        """Embedding rows of words: of the word and of its stem."""
        if not len(self.hashes) or not words:
            return [np.zeros((len(words), 2), np.int32)]
        h = np.array([word_hashes(w) for w in words], np.uint64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return [np.where(self.hashes[at] == h, at + 1, 0).astype(np.int32)]


def _padded(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with pads after each text, and the text of each position (pads: one more
    than there are texts, but an empty text's first pad is its own)."""
    gap = max(WIDTHS)
    begin = starts_of(counts) + np.arange(len(counts)) * gap
    size = int(counts.sum()) + gap * len(counts)
    flat, owner = np.zeros(size, np.int32), np.full(size, len(counts), np.int64)
    place = np.arange(len(ids)) + np.repeat(np.arange(len(counts)) * gap, counts)
    flat[place], owner[place] = ids, np.repeat(np.arange(len(counts)), counts)
    empty = counts == 0
    owner[begin[empty]] = np.flatnonzero(empty)
    return flat, owner


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.table = WordTable(self._convolved, most=100_000)
        # What an embedding adds to each filter at each of its places, side by side.
        self.taps = np.concatenate([f[j] for f in model.filters for j in range(len(f))], 1)

    def _convolved(self, words: list[bytes]) -> list[np.ndarray]:
        rows = self.model.rows_of([b"", *words])[0]  # the first one stands for a pad
        rows[0] = 0
        out = self.model.embedding[rows].sum(1) @ self.taps
        return [out[1:].astype(np.float32)]

    def pooled(self, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Maximum of every filter over each text, block by block."""
        flat, owner = _padded(numbers + 1, counts)
        known = self.table.columns[0]
        best = np.full((len(counts) + 1, len(WIDTHS) * FILTERS), LOWEST, np.float32)
        flat = np.concatenate([flat, np.zeros(max(WIDTHS), np.int32)])
        for a in range(0, len(owner), BLOCK):
            own = owner[a : a + BLOCK]
            cuts = np.flatnonzero(np.diff(own, prepend=-1))
            here = flat[a : a + len(own) + max(WIDTHS)]
            # Pads have number 0 and add nothing.
            taps = known[np.maximum(here - 1, 0)]
            taps[here == 0] = 0
            parts, tap = [], 0
            for width in WIDTHS:
                z = taps[: len(own), tap * FILTERS : (tap + 1) * FILTERS].copy()
                for j in range(1, width):
                    z += taps[j : j + len(own), (tap + j) * FILTERS : (tap + j + 1) * FILTERS]
                tap += width
                parts.append(np.maximum.reduceat(z, cuts))
            part, texts = np.concatenate(parts, 1), own[cuts]
            real = texts < len(counts)
            best[texts[real]] = np.maximum(best[texts[real]], part[real])
        return best[:-1]

    def logits(self, texts: list[bytes]) -> np.ndarray:
        numbers, counts = self.table.numbers([t.split() for t in texts])
        hidden = np.maximum(self.pooled(numbers, counts) + self.model.bias, 0)
        return hidden @ self.model.dense + self.model.dense_bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        a, b = self.model.scale
        return sigmoid(a * self.logits(texts).astype(float) + b)


def _vocabulary(texts: list[bytes], least: int = 2, most: int = MOST_HASHES) -> np.ndarray:
    """Hashes of words and stems in at least ``least`` sampled documents, the commonest
    first kept."""
    seen: dict[int, int] = {}
    known: dict[bytes, tuple[int, int]] = {}
    for text in texts:
        pairs = (known.get(w) or known.setdefault(w, word_hashes(w)) for w in set(text.split()))
        for one in {h for pair in pairs for h in pair}:
            seen[one] = seen.get(one, 0) + 1
    common = sorted((h for h, n in seen.items() if n >= least), key=lambda h: (-seen[h], h))[:most]
    return np.array(sorted(common), np.uint64)


def train(texts: list[bytes], y: np.ndarray, weight: np.ndarray, seed: int = 7) -> Model:
    """Adagrad over batches of documents; gradients reach only the places of the maxima."""
    rng = np.random.default_rng(seed)
    hashes = _vocabulary(texts)
    n_filters = len(WIDTHS) * FILTERS
    model = Model(
        hashes,
        rng.normal(0, 0.1, (len(hashes) + 1, SIZE)).astype(np.float32),
        [rng.normal(0, (SIZE * w) ** -0.5, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(n_filters, np.float32),
        rng.normal(0, 0.3, n_filters).astype(np.float32),
        0.0,
    )
    model.embedding[0] = 0
    if not len(texts) or y.min() == y.max():
        share = float(np.average(y, weights=weight)) if len(texts) else 0.0
        model.dense[:] = 0
        model.dense_bias = math.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return model
    table = WordTable(model.rows_of)
    docs = []
    for text in texts:
        numbers, _ = table.numbers([text.split()])
        docs.append(table.columns[0][numbers])
    emb, bias, dense = model.embedding, model.bias, model.dense
    sums = {"e": np.full(emb.shape, 1e-3, np.float32), "b": np.full_like(bias, 1e-3), "d": np.full_like(dense, 1e-3)}
    f_sums = [np.full_like(f, 1e-3) for f in model.filters]
    rate, rare = 0.08, np.array([1.0, max(1.0, (y == 0).sum() / max(1, (y == 1).sum()))])
    gap, batch = max(WIDTHS), 32
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for a in range(0, len(order), batch):
            chosen = order[a : a + batch]
            counts = np.array([len(docs[i]) for i in chosen])
            rows = np.concatenate([docs[i] for i in chosen])
            place, owner = _padded(np.arange(1, len(rows) + 1), counts)
            place = np.concatenate([place, np.zeros(gap, np.int32)])
            flat = np.concatenate([np.zeros((1, 2), np.int32), rows])[place]
            x = emb[flat].sum(1)
            n = len(owner)
            cuts = np.flatnonzero(np.diff(owner, prepend=-1))
            mine = owner[cuts] < len(chosen)
            tops, places = [], []
            for f in model.filters:
                z = sum(x[j : j + n] @ f[j] for j in range(len(f)))
                top = np.maximum.reduceat(z, cuts)
                run = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, n)))
                hit = z == top[run]
                # The first place of each maximum.
                first = np.where(hit, np.arange(n)[:, None], n)
                places.append(np.minimum.reduceat(first, cuts)[mine])
                tops.append(top[mine])
            hidden = np.concatenate(tops, 1) + bias
            active = hidden > 0
            hidden = np.where(active, hidden, 0)
            yb = y[chosen]
            g = (sigmoid(hidden @ dense + model.dense_bias) - yb) * rare[yb] / len(chosen)
            grad_h = (g[:, None] * dense) * active
            grad_d = hidden.T @ g + 1e-4 * dense
            model.dense_bias -= rate * float(g.sum())
            sums["d"] += grad_d**2
            dense -= (rate * grad_d / np.sqrt(sums["d"])).astype(np.float32)
            grad_b = grad_h.sum(0)
            sums["b"] += grad_b**2
            bias -= (rate * grad_b / np.sqrt(sums["b"])).astype(np.float32)
            touched, grads = [], []
            for k, f in enumerate(model.filters):
                gk = grad_h[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(len(f)):
                    at = places[k] + j
                    grad_f = np.einsum("nfs,nf->sf", x[at], gk) + 1e-4 * f[j]
                    gradient = (gk[:, :, None] * f[j].T[None]).reshape(-1, SIZE)
                    for part in range(2):  # the word and its stem
                        touched.append(flat[at, part].ravel())
                        grads.append(gradient)
                    f_sums[k][j] += grad_f**2
                    f[j] -= (rate * grad_f / np.sqrt(f_sums[k][j])).astype(np.float32)
            rows, back = np.unique(np.concatenate(touched), return_inverse=True)
            grad_e = np.zeros((len(rows), SIZE), np.float32)
            np.add.at(grad_e, back, np.concatenate(grads).astype(np.float32))
            keep = rows > 0
            rows, grad_e = rows[keep], grad_e[keep]
            sums["e"][rows] += grad_e**2
            emb[rows] -= rate * grad_e / np.sqrt(sums["e"][rows])
    return model


def best_threshold(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Middle of the cut with the best weighted F1, kept within ``THRESHOLDS``: one missed
    document must not pull the threshold to where clean ones begin. ``PREDICT_AT`` without
    both labels."""
    if not len(y) or y.min() == y.max():
        return PREDICT_AT
    order = np.argsort(-score, kind="stable")
    s, hit, w = score[order], y[order] == 1, weight[order]
    true, taken = np.cumsum(w * hit), np.cumsum(w)
    f1 = 2 * true / (taken + (w * hit).sum())
    last = np.append(s[1:] != s[:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    cut = (s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k]
    return float(np.clip(cut, *THRESHOLDS))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = MOST_PER_CLASS) -> Model:
    sample = labelled_sample(docs, labels, "toxic", ("lang",), per_class)
    # A fifth is kept for calibration.
    aside = np.array([xxhash.xxh64_intdigest(t) % 5 == 0 for t in sample.texts], bool)
    part = [t for t, out in zip(sample.texts, aside) if not out]
    model = train(part, sample.y[~aside], sample.weight[~aside])
    texts = [t for t, out in zip(sample.texts, aside) if out]
    y, weight = sample.y[aside], sample.weight[aside]
    if len(part) and sample.y[~aside].min() != sample.y[~aside].max() and len(texts):
        scorer = Scorer(model)
        model.scale = platt(scorer.logits(texts).astype(float), y, weight)
        model.fitted = [i for i, out in zip(sample.ids, aside) if not out]
        model.totals = tuple(float(sample.weight[sample.y == k].sum()) for k in (0, 1))
    return model


def language_thresholds(scored: DataFrame, labels: DataFrame, model: Model) -> dict[str, float]:
    """Thresholds by language, and of all under "", from sums over all labelled documents but
    the held-out and the fitted. ``scored`` has ``doc_id, lang, score``, so no text is read."""
    if not model.fitted:
        return {}
    seen = F.broadcast(labels.sparkSession.createDataFrame([(i,) for i in model.fitted], "doc_id long"))
    known = known_labels(labels, "toxic").join(seen, "doc_id", "left_anti")
    place = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")
    each = scored.where(F.col("doc_id").isNotNull() & ~held_out(MODULUS))
    each = each.select("doc_id", F.struct(F.coalesce("lang", F.lit("")).alias("lang"), place).alias("at"))
    each = each.groupBy("doc_id").agg(F.min("at").alias("at")).join(known, "doc_id")
    got = each.groupBy("at.lang", "y", "at.bin").agg(F.count("*").alias("n")).collect()
    lang = np.array([r["lang"] for r in got], object)
    y, n = np.array([r["y"] for r in got], np.int64), np.array([r["n"] for r in got], float)
    score = np.array([(r["bin"] + 0.5) / BINS for r in got])
    # The fitted ones were taken by label alone, so a label's others stand for them.
    weight = n * np.array([model.totals[k] / max(1.0, n[y == k].sum()) for k in (0, 1)])[y]
    out = {"": best_threshold(score, y, weight)}
    for one in sorted(set(lang) - {""}):
        own = lang == one
        if min(np.bincount(y[own], n[own], 2)) >= 5:  # fewer say nothing of their own
            out[str(one)] = best_threshold(score[own], y[own], weight[own])
    return out


def threshold(thresholds: dict[str, float], lang: Column) -> Column:
    """The rejection threshold of a row's language; there is one per language with labels."""
    general = F.lit(thresholds.get("", PREDICT_AT))
    known = {k: v for k, v in thresholds.items() if k}
    if not known:
        return general
    pairs = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.element_at(pairs, F.coalesce(lang, F.lit(""))), general)


def score_column(model: Model):
    """An Arrow function from ``row, text`` batches to ``row, score``."""

    def run(batches):
        held("toxicity")
        scorer = Scorer(model)
        for batch in batches:
            for part in slices(batch, "text"):
                scores = scorer.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["row", "score"])

    return run


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    """``row, score`` of rows ``row, text``, stored."""
    kind = rows.schema["row"].dataType.simpleString()
    return materialize(rows.mapInArrow(score_column(model), f"row {kind}, score double"), "toxicity")


def toxicity(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted, threshold, rejected`` per row."""
    model = fit(docs, labels) if model is None else model
    rows = docs.select(F.struct("doc_id", "lang").alias("row"), text_bytes().alias("text"))
    scored = _scored(rows, model).select("row.*", "score")
    limit = threshold(language_thresholds(scored, labels, model), F.col("lang"))
    return scored.select(
        "doc_id",
        held_out(MODULUS).alias("held_out"),
        "score",
        (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"),
        limit.alias("threshold"),
        (F.col("score") >= limit).alias("rejected"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents below their language's threshold, with their columns."""
    model = fit(docs, labels) if model is None else model
    scored = _scored(pack_rows(docs, text=text_bytes()), model)
    facts = scored.select("row.doc_id", "row.lang", "score")
    limit = threshold(language_thresholds(facts, labels, model), F.col("row.lang"))
    return scored.where(F.col("score") < limit).select(*[F.col("row")[c].alias(c) for c in docs.columns])
