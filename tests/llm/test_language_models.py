"""Counts, normalisation and results against plain versions."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import documents, frame, prose, words

from tallypanel.llm import bpe, lm_score, quality_rules

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def base_rules(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(cover), failed


def test_quality_rules(spark):
    rows = documents() + [(700 + i, prose(4000 + i, 60), "en", "s", 0, "", "", 0, 0) for i in range(80)]
    rng = np.random.default_rng(2)
    noise = " ".join("".join(rng.choice(list("qxzwjyfghpc#%"), 9)) for _ in range(60))
    rows += [(900, noise, "en", "s", 0, "", "", 0, 0)]
    got = quality_rules.judge(frame(spark, rows)).collect()
    keys = [*quality_rules.MEASURES, "base_failed"]
    assert sorted(((r["doc_id"], *[r[k] for k in keys]) for r in got), key=repr) == sorted(
        ((row[0], *base_rules(row[1])) for row in rows), key=repr
    )
    assert not any(r["kept"] and r["base_failed"] for r in got)
    by_id = {r["doc_id"]: r["kept"] for r in got}
    assert all(by_id[700 + i] for i in range(80)) and not by_id[900]
    assert quality_rules.judge(frame(spark, [])).count() == 0


def test_kneser_ney_sums_to_one(spark):
    """Over all next symbols after any context, seen or not."""
    rows = [(i, prose(i, 200), "en", "s", 0, "", "", 0, 0) for i in range(6)]
    model = quality_rules.fit(frame(spark, rows))
    symbols = [c for c in "bakelimonurasetivodu"] + ["\x02"]
    alphabet = sorted(set(symbols))
    for context in ("\x01", "\x01b", "\x01ba", "bak", "kel", "uuu"):
        total = 0.0
        for s in alphabet:
            ids = [ord(c) for c in context + s]
            p = model.floor
            for n in range(1, quality_rules.ORDER + 1):
                if n > len(ids):
                    break
                tail = ids[-n:]
                packed = sum(c << (16 * k) for k, c in enumerate(reversed(tail)))
                own = quality_rules._find(model.grams[n - 1], np.array([packed]), 0.0)[0]
                if n == 1:
                    back = model.contexts[0][1][0]
                else:
                    back = quality_rules._find(model.contexts[n - 1], np.array([packed >> 16]), 1.0)[0]
                p = own + back * p
            total += p
        types = 1 / model.floor - 1
        # What is missing is the floor's share of the one unseen symbol.
        assert total == pytest.approx(1, abs=0.03), context
        assert types == len(alphabet)


def test_repeated_words_over_texts():
    numbers, counts = np.array([1, 2, 3, 4, 5, 6, 7, 8] * 2 + [1, 2, 3, 4, 5, 6, 7, 8], np.int64), np.array([16, 8])
    assert quality_rules.repeated_words(numbers, counts).tolist() == [16, 0]


def base_score(rows):
    tokens = [[w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in words(r[1])] + [0] for r in rows]
    counts = Counter()
    for row, t in zip(rows, tokens):
        if zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 7 != 2:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    return [
        (row[0], len(t), sum(counts[w] > 0 for w in t), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
        for row, t in zip(rows, tokens)
    ]


@pytest.mark.parametrize("hot", [1 << 18, 40])
def test_base_scores(spark, monkeypatch, hot):
    """With all words broadcast, and with most of them joined."""
    monkeypatch.setattr(lm_score, "HOT", hot)
    rows = documents()
    got = lm_score.score(frame(spark, rows), PATH, public_tokenizers.PATTERN).collect()
    want = sorted(base_score(rows), key=repr)
    mine = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=repr)
    assert [m[:4] for m in mine] == [w[:4] for w in want]
    assert [m[4] for m in mine] == pytest.approx([w[4] for w in want])
    assert all(r["score"] < 0 and r["open_score"] < 0 for r in got)


def test_hot_words_change_nothing_but_the_way(spark, monkeypatch):
    rows = [(i, prose(i % 20, 150), "en", "s", 0, "", "", 0, 0) for i in range(40)]
    scores = []
    for hot in (1 << 18, 25):
        monkeypatch.setattr(lm_score, "HOT", hot)
        got = lm_score.score(frame(spark, rows), PATH, public_tokenizers.PATTERN).orderBy("doc_id").collect()
        scores.append([r["score"] for r in got])
    assert scores[0] == pytest.approx(scores[1], rel=1e-4)


def test_context_helps_on_held_out_rows(spark):
    """Two kinds of texts share no words, so what came before tells what may come."""
    kinds = [[prose(50 + k, 1) + str(j) for j in range(40)] for k in (0, 1)]
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(kinds[i % 2], 200)), "en", "s", 0, "", "", 0, 0) for i in range(300)]
    got = [r for r in lm_score.score(frame(spark, rows), PATH, public_tokenizers.PATTERN).collect() if r["held_out"]]
    per_token = [sum(r[c] for r in got) / sum(r["n_tokens"] for r in got) for c in ("base_score", "score")]
    assert per_token[1] > per_token[0] + 0.1


def test_each_piece_is_scored_once_with_most_context():
    coder = lm_score.speller(bpe.read_vocabulary(PATH), public_tokenizers.PATTERN)
    params = lm_score.att.new_params(50, 4, 4)
    model = type("M", (), {"params": params, "tokens": 1, "distinct": 1, "hot": []})()
    scorer = lm_score.Scorer(model, coder)
    counts = np.array([1, 5, 24, 25, 100])
    ids = np.random.default_rng(0).integers(0, 50, int(counts.sum()))
    got = scorer._states(ids, counts)
    at = 0
    for n in counts:
        for k in range(n):
            first = max(0, k // lm_score.STRIDE * lm_score.STRIDE - lm_score.OVERLAP)
            shift = lm_score.OVERLAP if k < lm_score.STRIDE else 0
            window = np.zeros((1, lm_score.LENGTH), np.int64)
            there = np.zeros((1, lm_score.LENGTH), bool)
            window[0, shift : shift + k - first + 1] = ids[at + first : at + k + 1]
            there[0, shift : shift + k - first + 1] = True
            want = lm_score.att.attend(params, window, there)[0, shift + k - first]
            assert np.allclose(got[at + k], want, atol=1e-4)
        at += n


def test_every_piece_is_a_target_once():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 30, 31, 32, 33, 500])
    pieces = rng.integers(0, 50, int(counts.sum())).astype(np.int32)
    windows = np.concatenate(list(lm_score.consecutive(pieces, counts, 50)))
    targets = windows[:, 1:]
    want = np.concatenate([[*part, 50] for part in np.split(pieces, np.cumsum(counts)[:-1])])
    assert targets[targets >= 0].tolist() == want.tolist()


def test_classes_and_training_see_all_windows(spark):
    """Short and repeated texts as well, which gave no window or one for all copies."""
    coder = lm_score.speller(bpe.read_vocabulary(PATH), public_tokenizers.PATTERN)
    texts = [prose(k % 3, 90).encode() for k in range(9)]
    batch = lm_score.pa.RecordBatch.from_arrays([lm_score.pa.array(texts, lm_score.pa.binary())], names=["text"])
    end = len(coder.bytes_of)
    windows = np.concatenate(list(lm_score._windows([batch], coder)))
    assert (windows[:, 1:] >= 0).sum() == sum(coder.spell(t.split())[1].sum() + 1 for t in texts)
    first = np.array([b[:1] == b" " for b in coder.bytes_of])
    starting = np.bincount(windows[(windows >= 0) & (windows < end)], minlength=end) * first
    common = np.argsort(-starting, kind="stable")[:5]
    want = Counter()
    for w in windows.tolist():
        own = {i for i in w if 0 <= i < end and first[i]}
        want.update((i, j) for i in own for j in own & set(common.tolist()))
    raw = spark.sparkContext.broadcast(bpe.read_vocabulary(PATH))
    docs = spark.createDataFrame([(bytearray(t),) for t in texts], "text binary")
    met = lm_score._met(docs, raw, public_tokenizers.PATTERN, first, common)
    assert {(int(i), int(common[j])): int(met[i, j]) for i, j in np.argwhere(met)} == dict(want)


def test_ngrams_are_known_exactly(spark):
    """No unseen n-gram has the probability of a seen one, also where 22 bits of a hash agree."""
    rows = [(i, prose(i, 200), "en", "s", 0, "", "", 0, 0) for i in range(6)]
    table = quality_rules.fit(frame(spark, rows)).grams[3]
    seen = {w[k : k + 4] for r in rows for w in words(r[1]) for k in range(len(w) - 3)}
    letters = np.arange(ord("a"), ord("z") + 1, dtype=np.int64)
    packed = letters[:, None, None, None] << 48 | letters[:, None, None] << 32 | letters[:, None] << 16 | letters
    known = {sum(ord(c) << (16 * k) for k, c in enumerate(reversed(g))) for g in seen}
    others = np.array(sorted(set(packed.ravel().tolist()) - known))
    assert (quality_rules._find(table, np.array(sorted(known)), 0.0) > 0).all()
    assert not quality_rules._find(table, others, 0.0).any()


@pytest.mark.parametrize("hot", [0, 30])
def test_joined_scores_are_the_broadcast_ones(spark, monkeypatch, hot):
    rows = documents()
    docs = frame(spark, rows)
    model = quality_rules.fit(docs)

    def found():
        return sorted(map(tuple, quality_rules.measures(docs, model).collect()), key=repr)

    want = found()
    monkeypatch.setattr(quality_rules, "FITS", 0)
    monkeypatch.setattr(quality_rules, "HOT", hot)
    got = found()
    assert [g[:-1] for g in got] == [w[:-1] for w in want]
    assert [g[-1] for g in got] == pytest.approx([w[-1] for w in want])


def test_junk_does_not_widen_the_bands(spark):
    """A hot source of 24 % junk, copies of one junk text, and a one-sided spread."""
    rng = np.random.default_rng(3)
    rows = [(i, "en", i, 200, 1000, 2 + 0.05 * rng.normal()) for i in range(300)]
    rows += [(1000 + i, "en", 1000 + i, 200, 1000, 3 + 0.05 * rng.normal()) for i in range(95)]
    rows += [(2000 + i, "de", i, 200, 1000, 2 + 0.05 * rng.normal()) for i in range(300)]
    rows += [(3000 + i, "de", 3000, 200, 1000, 3.5) for i in range(400)]
    rows += [(4000 + i, "fr", i, 200, 1000, 2 + abs(rng.normal()) * (0.3 if i % 2 else -0.05)) for i in range(301)]
    rows += [(5000, "fr", 5000, 200, 1000, 1.4), (5001, "fr", 5001, 200, 1000, 2.6)]
    table = spark.createDataFrame(rows, "doc_id long, lang string, same long, n_words long, word_chars long, entropy double")
    z = quality_rules.deviation("middle")
    inside = z.between(-quality_rules.F.col("lower"), quality_rules.F.col("upper")).alias("inside")
    got = {r[0]: r[1] for r in quality_rules.with_bands(table).select("doc_id", inside).collect()}
    assert all(got[i] for i in [*range(300), *range(2000, 2300), 5001])
    assert not any(got[i] for i in [*range(1000, 1095), *range(3000, 3400), 5000])


def test_units_tell_texts_apart():
    """Also characters above U+FFFF, U+FFFF itself and what marks words."""
    words = ["\U00020000", "\u8000", "\uffff" * 4, "\uffff", "\x01", "\x02", "\x01\x02", "\U0010ffff", "a\U0001f642b", "é"]
    seen = set()
    for w in words:
        flat, lengths = quality_rules.units([w.encode()])
        assert lengths.tolist() == [len(flat)] and flat[0] == quality_rules.START and flat[-1] == quality_rules.END
        assert not set(flat[1:-1].tolist()) & {1, 2, 0xFFFF}
        seen.add(tuple(flat.tolist()))
        order, packed = quality_rules.greatest(flat, lengths)
        assert (packed != -1).all()
    assert len(seen) == len(words)
    flat, lengths = quality_rules.units([w.encode() for w in words])
    parts = np.split(flat, np.cumsum(lengths)[:-1])
    assert {tuple(p.tolist()) for p in parts} == seen


def test_rare_characters_score_alike_both_ways(spark, monkeypatch):
    texts = ["\uffff\uffff\uffff\uffff word", "\U00020000\U00020000 \u8000\u8000", "\x01\x02 \x01"] + [prose(i, 30) for i in range(5)]
    docs = frame(spark, [(i, t, "en", "s", 0, "", "", 0, 0) for i, t in enumerate(texts)])
    model = quality_rules.fit(docs)

    def entropies():
        return {r["doc_id"]: r["entropy"] for r in quality_rules.measures(docs, model).collect()}

    broadcast = entropies()
    monkeypatch.setattr(quality_rules, "FITS", 0)
    joined = entropies()
    assert joined.keys() == broadcast.keys()
    assert all(joined[i] == pytest.approx(broadcast[i], rel=1e-9) for i in joined)


def plain_kneser_ney(words):
    """Probability of each n-gram of the words by the textbook recursion, with plain dicts."""
    order, mark = quality_rules.ORDER, lambda w: "\x01" + w + "\x02"
    raw = {n: {} for n in range(1, order + 1)}
    for w in map(mark, words):
        for end in range(1, len(w)):
            n = min(order, end + 1)
            g = w[end + 1 - n : end + 1]
            raw[n][g] = raw[n].get(g, 0) + 1
    counts = {order: raw[order]}
    for n in range(order - 1, 0, -1):
        heard = {}
        for g in counts[n + 1]:
            heard[g[1:]] = heard.get(g[1:], 0) + 1
        for g, c in (raw[n] if n > 1 else {}).items():
            heard[g] = heard.get(g, 0) + c
        counts[n] = heard
    floor = 1 / (len(counts[1]) + 1)
    below = {}
    for n in range(1, order + 1):
        of = [sum(c == k for c in counts[n].values()) for k in range(5)]
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + of[2] else 0.5
        cut = [0.0] + [min(max(k - (k + 1) * y * of[k + 1] / of[k], 0.05), k - 0.05) if of[k] and of[k + 1] else 0.5 * k for k in (1, 2, 3)]
        total, kept = {}, {}
        for g, c in counts[n].items():
            total[g[:-1]] = total.get(g[:-1], 0) + c
            kept[g[:-1]] = kept.get(g[:-1], 0.0) + cut[min(c, 3)]
        below = {
            g: min(1.0, (c - cut[min(c, 3)]) / total[g[:-1]] + kept[g[:-1]] / total[g[:-1]] * (below[g[1:]] if n > 1 else floor))
            for g, c in counts[n].items()
        }
        yield n, below


def test_kneser_ney_by_plain_counts(spark):
    rows = [(i, prose(i, 40), "en", "s", 0, "", "", 0, 0) for i in range(6)]
    model = quality_rules.fit(frame(spark, rows))
    got = {(r["n"], r["packed"]): r["logp"] for r in model.scores.collect()}
    checked = 0
    for n, table in plain_kneser_ney([w for r in rows for w in r[1].split()]):
        for g, p in table.items():
            packed = sum(ord(c) << 16 * (n - 1 - k) for k, c in enumerate(g))
            packed = packed - 2**64 if packed >= 2**63 else packed
            if (n, packed) in got:
                assert got[n, packed] == pytest.approx(math.log(max(p, 1e-12)), rel=1e-9, abs=1e-9)
                checked += 1
    assert checked == len(got) > 100


def test_no_word_is_hot_where_the_first_step_has_no_room(spark, monkeypatch):
    """300 words of one occurrence: none is collected for the broadcast."""
    rows = [(i, " ".join(f"u{i}x{k}" for k in range(10)), "en", "s", 0, "", "", 0, 0) for i in range(30)]
    monkeypatch.setattr(lm_score, "HOT", 50)
    docs = frame(spark, rows)
    model, _ = lm_score.fit(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert model.hot == [] and model.least == lm_score.NEVER
