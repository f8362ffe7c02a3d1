"""Held-out accuracy, and the edges of scoring."""

import random
import zlib

import numpy as np
import pytest
from llm_helpers import documents, frame, prose
from pyspark.sql import functions as F

from tallypanel.llm import quality_fm, toxicity
from tallypanel.llm.labelled import labelled_sample, platt, sigmoid

BAD = ["idiot", "trash", "loser"]
LABELS = "doc_id long, toxic int, quality int, text string"


def corpus(n=900):
    """Toxic texts hold a bad word, poor ones shout or repeat symbols."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        text, toxic, poor = prose(i, rng.randint(30, 120)), rng.random() < 0.2, rng.random() < 0.3
        w = text.split()
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", ",", "."]))
        if poor:
            w = [x.upper() + "!!" if i % 2 else x + "***" for x in w]
        rows.append((i, " ".join(w), ("en", "de", None)[i % 3], "s", None if i % 5 == 0 else len(text), "", "", 0, 0))
        labels.append((i, int(toxic), int(not poor), "x"))
    return rows, labels


def out_of_sample(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    return frame(spark, rows), spark.createDataFrame(labels, LABELS), labels


def accuracy(scored, labels, column, cut):
    held = [r for r in scored if r["held_out"]]
    assert len(held) > 100 and all(r["held_out"] == out_of_sample(r["doc_id"]) for r in scored)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut) for r in scored)
    truth = {row[0]: row[column] for row in labels}
    return np.mean([r["predicted"] == truth[r["doc_id"]] for r in held])


def test_toxicity_held_out(tables):
    docs, labels, known = tables
    model = toxicity.fit(docs, labels)
    scored = toxicity.toxicity(docs, labels, model).collect()
    assert accuracy(scored, known, 1, 0.3) > 0.95
    left = toxicity.drop_toxic(docs, labels, model)
    assert left.columns == docs.columns
    toxic = {r[0] for r in known if r[1]}
    kept = {r["doc_id"] for r in left.collect()}
    clean = {r[0] for r in known if not r[1]}
    assert len(kept & clean) > 0.97 * len(clean) and len(kept & toxic) < 0.1 * len(toxic)


def test_quality_held_out(tables):
    docs, labels, known = tables
    scored = quality_fm.quality(docs, quality_fm.fit(docs, labels)).collect()
    assert accuracy(scored, known, 2, 0.7) > 0.95


def test_labels_of_held_out_rows_are_not_read(tables, spark):
    docs, labels, known = tables
    swapped = [(i, 1 - t, 1 - q, x) if out_of_sample(i) else (i, t, q, x) for i, t, q, x in known]
    a = labelled_sample(docs, labels, "toxic")
    b = labelled_sample(docs, spark.createDataFrame(swapped, LABELS), "toxic")
    assert a.texts == b.texts and (a.y == b.y).all()


def test_edges(tables, spark):
    _, labels, _ = tables
    rows = documents()
    docs = frame(spark, rows)
    by_toxicity = lambda docs, model: toxicity.toxicity(docs, labels, model)
    for fit, score in ((toxicity.fit, by_toxicity), (quality_fm.fit, quality_fm.quality)):
        # Ids of these rows have labels of other texts: any model will do.
        model = fit(docs, labels)
        got = score(docs, model).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert score(frame(spark, []), model).count() == 0
        nothing = fit(docs, labels.limit(0))
        assert {r["score"] for r in score(docs, nothing).collect()} == {next(iter(r["score"] for r in score(docs, nothing).collect()))}


def test_texts_are_scored_whole():
    rows, labels = corpus(300)
    texts, y = [r[1].encode() for r in rows], np.array([x[1] for x in labels])
    scorer = toxicity.Scorer(toxicity.train(texts, y, np.ones(len(y))))
    clean = prose(1, 40_000)
    low, high = scorer.scores([clean.encode(), (clean + " idiot trash").encode()])
    assert high > low
    # The same maxima, whatever the blocks.
    whole = scorer.logits([clean.encode()])
    toxicity.BLOCK, before = 100, toxicity.BLOCK
    try:
        assert np.allclose(scorer.logits([clean.encode()]), whole)
    finally:
        toxicity.BLOCK = before


def test_pairs_by_the_identity():
    rng = np.random.default_rng(0)
    model = quality_fm.Model(
        np.zeros(0, np.uint64), np.zeros(quality_fm.N_DENSE), np.ones(quality_fm.N_DENSE), 0.3,
        rng.normal(size=5), rng.normal(size=(5, quality_fm.FACTORS)), rng.normal(size=quality_fm.N_DENSE),
        rng.normal(size=(quality_fm.N_DENSE, quality_fm.FACTORS)),
    )
    value, column = rng.normal(size=4), np.array([0, 2, 3, 4])
    dense = rng.normal(size=(1, quality_fm.N_DENSE))
    got, _ = quality_fm._raw(model, value, column, np.array([4]), dense)
    x = np.concatenate([value, dense[0]])
    v = np.concatenate([model.v[column], model.dense_v])
    w = np.concatenate([model.w[column], model.dense_w])
    pairs = sum(v[i] @ v[j] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert got[0] == pytest.approx(0.3 + w @ x + pairs)


def test_platt_orders_and_centres():
    rng = np.random.default_rng(1)
    z = rng.normal(size=4000) * 5
    y = (rng.random(4000) < sigmoid(0.5 * z - 1)).astype(int)
    a, b = platt(z, y, np.ones(4000))
    assert a == pytest.approx(0.5, abs=0.08) and b == pytest.approx(-1, abs=0.2)


def test_sample_is_bounded(tables):
    docs, labels, _ = tables
    sample = labelled_sample(docs, labels, "toxic", per_class=20)
    assert len(sample) == 40 and sample.weight[sample.y == 0][0] > sample.weight[sample.y == 1][0]
    assert docs.where(F.col("doc_id") == 0).count() == 1


def test_threshold_stays_clear_of_clean_documents():
    score = np.array([0.99, 0.98, 0.97, 0.02, 0.01, 0.001])
    y = np.array([1, 1, 1, 1, 0, 0])
    assert toxicity.best_threshold(score, y, np.ones(6)) == 0.3
    assert toxicity.best_threshold(np.array([0.8, 0.2]), np.array([1, 0]), np.ones(2)) == 0.5


def test_thresholds_count_all_labelled_documents(tables):
    """The sample holds too few of a language; all labelled documents hold enough."""
    docs, labels, _ = tables
    model = toxicity.fit(docs, labels, per_class=40)
    scored = docs.select("doc_id", "lang", (F.col("doc_id") % 10 / 10).alias("score"))
    assert set(toxicity.language_thresholds(scored, labels, model)) == {"", "en", "de"}
    assert toxicity.language_thresholds(scored, labels.limit(0), model) == {"": toxicity.PREDICT_AT}


def plain_scores(model, texts):
    """Each filter at each place of the text and its pads, by loops."""
    out = []
    rows = {h: k + 1 for k, h in enumerate(model.hashes.tolist())}
    pad = np.zeros(toxicity.SIZE)
    for text in texts:
        told = [sum((model.embedding[rows[h]].astype(float) for h in toxicity.word_hashes(w) if h in rows), pad) for w in text.split()]
        best = []
        for f in model.filters:
            width = len(f)
            ends = told + [pad] * max(toxicity.WIDTHS)
            places = range(len(told)) if told else range(1)
            best += [max(sum(ends[i + j] @ f[j][:, k] for j in range(width)) for i in places) for k in range(toxicity.FILTERS)]
        hidden = np.maximum(np.array(best) + model.bias, 0)
        a, b = model.scale
        out.append(sigmoid(a * (hidden @ model.dense + model.dense_bias) + b))
    return np.array(out)


def test_convolution_by_loops():
    rows, labels = corpus(200)
    texts, y = [r[1].encode() for r in rows], np.array([x[1] for x in labels])
    model = toxicity.train(texts, y, np.ones(len(y)))
    some = [*texts[:40], b"", b"idiot", b"two words", b"idiot " * 30, "é über".encode()]
    assert np.allclose(toxicity.Scorer(model).scores(some), plain_scores(model, some), atol=1e-4)


def test_texts_are_read_once_for_scores(tables, monkeypatch):
    docs, labels, _ = tables
    model = toxicity.fit(docs, labels)
    passes = []
    monkeypatch.setattr(toxicity, "score_column", lambda m, real=toxicity.score_column: passes.append(1) or real(m))
    toxicity.toxicity(docs, labels, model).count()
    toxicity.drop_toxic(docs, labels, model).count()
    assert len(passes) == 2


def test_workers_let_go_what_others_left():
    from tallypanel.llm import common

    common.held("one")["x"] = 1
    assert common.held("one") == {"x": 1}
    assert common.held("two") == {} and common.held("one") == {}
