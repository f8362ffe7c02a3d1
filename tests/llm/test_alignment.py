import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import documents, frame

from tallypanel.llm import alignment

PATHS = [public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def tool():
    return alignment.Aligner(*map(alignment._read, PATHS))


def plain_groups(tool, text):
    """``(a ids, b ids, links)`` of each group by comparing byte ranges; None if a side differs."""
    ids_a = tool.tokenizer.encode(" " + text, add_special_tokens=False).ids
    ids_b = tool.pieces.encode(text)
    vocabulary = json.loads(alignment._read(PATHS[0]))["model"]["vocab"]
    alphabet = alignment.byte_alphabet()
    of_a = {i: bytes(alphabet[c] for c in t) for t, i in vocabulary.items()}
    model = tool.pieces
    bytes_a = [of_a[i] for i in ids_a]
    bytes_b = [
        bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
        for i in ids_b
    ]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return None

    def ranges(parts):
        out, at = [], 0
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    spans_a, spans_b = ranges(bytes_a), ranges(bytes_b)
    links = [
        (x, y) for x, (s, e) in enumerate(spans_a) for y, (t, f) in enumerate(spans_b) if s < f and t < e
    ]
    cuts = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
    groups, begin = [], 0
    for cut in cuts:
        groups.append(
            ([i for i, (s, e) in zip(ids_a, spans_a) if begin <= s and e <= cut], [i for i, (s, e) in zip(ids_b, spans_b) if begin <= s and e <= cut])
        )
        begin = cut
    return groups, [(ids_a[x], ids_b[y]) for x, y in links], len(ids_a), len(ids_b)


def expected(tool, rows):
    told = [plain_groups(tool, r[1]) if r[1] else None for r in rows]
    counts = Counter(link for t in told if t for link in t[1])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for row, t in zip(rows, told):
        if t is None:
            out.append((row[0], 0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links, n_a, n_b = t
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(counts[link] == most[link[1]] for link in links)
        total = sum(counts[link] for link in links)
        out.append((row[0], n_a, n_b, len(groups), len(links), best, total, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


ODD = [
    "a\n\n\nb", "a \n b", "\n\nlead", " lead", "trail ", "trail\n\n", "x\n\n y", "x\n\n\n  y z", "tab\tx", " y q  r",
    "<|endoftext|> and <s> </s> <0x41> <unk>", "▁x ▁", "ab▁cd", "naïve 東京タワー 🙂👍🏽", "\x00 nul", "don't can't I'm",
    "a\r\nb\r\n", "﻿bom ​zero", "x" * 700, "ﬁ ligature é \u0085 next", "1234567 12 3.14", "\n", " ", "  ", "　全角",
]


def small_rows():
    return [r for r in documents() if len(r[1] or "") < 1500] + [(900 + i, t, "en", "s1", 0, "", "", 0, 0) for i, t in enumerate(ODD)]


def got_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("hot", [1 << 19, 40, 0])
def test_report_equals_comparison_of_ranges(spark, tool, hot):
    rows = small_rows()
    got = alignment.align_report(frame(spark, rows), *PATHS, hot=hot)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got_rows(got) == expected(tool, rows)


def test_words_align_as_whole_texts(tool):
    rng = random.Random(5)
    parts = ["the", "Zq", "word,", "\n", "\n\n", " ", "  ", "\t", "é", "東", "'s", "12", "—", " ", "▁", "a\n", "\x1f"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    known = alignment.Digester(tool)
    assert tool.by_word
    counts, shown, owner, keys = known.digest(texts)
    found = tool.align(texts)
    told = dict(zip(found.docs.tolist(), tool.group_texts(found)))
    assert [told.get(k) for k in range(len(texts))] == shown
    of, own = tool.links(found)
    assert Counter(zip(found.docs[of].tolist(), own.tolist())) == Counter(zip(owner.tolist(), keys.tolist()))
    assert sum(1 for t in texts if t and all(map(alignment._is_plain, alignment._words(t)))) > 50
    # The same again from memory.
    assert known.digest(texts)[1] == shown


def test_forgetting_words(tool, monkeypatch):
    monkeypatch.setattr(alignment, "MOST_WORDS", 5)
    texts = [r[1] for r in documents() if r[1]]
    forgetful, usual = alignment.Digester(tool), alignment.Digester(tool)
    once = [forgetful.digest([t])[1][0] for t in texts]
    assert once == usual.digest(texts)[1]


def test_long_chain(tool):
    import numpy as np

    follow = np.minimum(np.arange(1000) + 1, 999)
    assert (alignment.terminals(follow) == 999).all()
    # A text without spaces and one of 200,000 characters.
    text = "ab" * 2000 + " " + "lorem ipsum " * 17_000
    counts, shown, owner, keys = alignment.Digester(tool).digest([text])
    assert counts[0, 3] == len(keys) == counts[0, 0] + counts[0, 1] - counts[0, 2]


def test_groups_and_spans(spark, tool):
    rows = small_rows()
    shown = {repr((r[0], hashlib.sha256(alignment.render_groups(r[1]).encode()).hexdigest() if r[1] else "")) for r in alignment.align_documents(frame(spark, rows), *PATHS).collect()}
    assert shown == {repr((e[0], e[7])) for e in expected(tool, rows)}
    text = "naïve 東京"
    one = alignment.align_documents(frame(spark, [(1, text, "", "", 0, "", "", 0, 0)]), *PATHS).first()
    ends = [g["end"] for g in one["groups"]]
    assert ends[-1] == len((" " + text).encode()) and [g["begin"] for g in one["groups"]] == [0, *ends[:-1]]


def test_empty_table(spark):
    assert alignment.align_report(frame(spark, []), *PATHS).count() == 0


def test_packed_pairs():
    import numpy as np

    keys, times = np.array([0, 5, 2**40]), np.array([1, 300, 2**33])
    a, b = alignment.unpack_pairs(alignment.pack_pairs(keys, times))
    assert a.tolist() == keys.tolist() and b.tolist() == times.tolist()


def test_sums_are_sent_on(monkeypatch):
    import numpy as np

    monkeypatch.setattr(alignment, "MOST_PAIRS", 4)
    sums, sent = alignment._Sums(), Counter()
    for a in range(6):
        sums.add(np.array([a, a + 1, 100]), np.array([1, 2, 3]))
        for batch in sums.spill(always=a == 5):
            for key, n in zip(batch.column("key").to_pylist(), batch.column("links").to_pylist()):
                sent[key] += n
    assert sent == {0: 1, 1: 3, 2: 3, 3: 3, 4: 3, 5: 3, 6: 2, 100: 18}


def test_what_a_task_holds_is_bounded():
    sums, sent = alignment._Sums(), 0
    for a in range(0, 600_000, 50_000):
        sums.add(np.arange(a, a + 50_000), np.ones(50_000, np.int64))
        sent += sum(b.num_rows for b in sums.spill())
        assert sums.size <= 300_000
    assert sent + sum(b.num_rows for b in sums.spill(always=True)) == 600_000
    assert alignment.MOST_WORDS <= 120_000
