import random

import numpy as np
import pytest
from llm_helpers import documents, frame, jaccard_groups, prose, reachable

from tallypanel.llm import ngram_join as nj
from tallypanel.llm.components import components, forest


def plain(rows):
    linked = jaccard_groups(rows)
    out = [None] * len(rows)
    for members in reachable(linked).values():
        first = min((0 if rows[m][0] is None else rows[m][0]) for m in members)
        for m in members:
            out[m] = (rows[m][0], first if len(members) > 1 else rows[m][0], len(linked[m]))
    return sorted(out, key=repr)


def found(spark, rows):
    got = nj.similar_documents(frame(spark, rows))
    return sorted((tuple(r) for r in got.select("doc_id", "class_id", "n_links").collect()), key=repr)


def test_edges(spark):
    rows = [r for r in documents() if r[0] is not None]
    assert found(spark, rows) == plain(rows)


def test_null_ids(spark):
    got = nj.similar_documents(frame(spark)).collect()
    assert len(got) == len(documents())
    assert all(r["n_links"] == 0 for r in got if r["doc_id"] == 500)


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 8)
    rng, base = random.Random(1), prose(7, 120).split()
    texts = [prose(900 + i, 80) for i in range(30)]
    for _ in range(40):  # near copies that are all different, some beyond the threshold
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [" ".join(base)] * 5
    rows = [(i, t, "en", "s", 0, "", "", 0, 0) for i, t in enumerate(texts)]
    assert found(spark, rows) == plain(rows)


def test_one_of_each_group_stays(spark):
    rows = [r for r in documents() if r[0] is not None]
    docs = frame(spark, rows)
    got = nj.drop_similar(docs)
    assert got.columns == docs.columns
    heads = {w[1] for w in plain(rows)}
    assert {r["doc_id"] for r in got.collect()} == heads
    assert nj.drop_similar(frame(spark, [])).count() == 0


def test_depth_reaches_the_target():
    depth = nj.match_depth()
    assert nj.recall_at(depth, nj.SIMILARITY) >= nj.RECALL > nj.recall_at(depth + 1, nj.SIMILARITY)


def sets_of(texts):
    return nj.Shingler(nj.N).sets([t.encode() for t in texts])


def jaccard(a, b):
    both = len(np.intersect1d(a, b))
    return both / max(1, len(a) + len(b) - both)


def meeting_depth(a, b):
    """Deepest prefix two sets share in a trie, level by level."""
    factors = nj._multipliers(nj.TREES * nj.DEPTH)
    one, two = (nj.path_of(nj.signature(x, factors)).reshape(nj.TREES, nj.DEPTH, -1).tolist() for x in (a, b))
    return max(next((d for d in range(nj.DEPTH) if p[d] != q[d]), nj.DEPTH) for p, q in zip(one, two))


def test_audit_finds_every_link_of_its_members():
    texts = [prose(100 + i, 60) for i in range(6)]
    texts += [" ".join(t.split()[k:] + ["tail"] * k) for t in texts for k in (1, 3, 6, 20)] + ["", "one two"]
    sets = sets_of(texts)
    audit = nj.Audit(sets[:6], nj.SIMILARITY, nj.TREES)
    assert len(audit.sets) == 6
    want = []
    for m, member in enumerate(sets[:6]):
        for s in sets:
            alike = jaccard(member, s)
            if len(s) and nj.SIMILARITY <= alike < 1:
                band = sum(alike >= e for e in nj.band_edges(nj.SIMILARITY)) - 1
                want.append((m * nj.BANDS + band) * (nj.DEPTH + 1) + meeting_depth(member, s))
    factors = nj._multipliers(nj.TREES * nj.DEPTH)
    paths = [nj.path_of(nj.signature(s, factors)) if len(s) else None for s in sets]
    assert want and sorted(audit.met(sets, paths).tolist()) == sorted(want)
    none = nj.Audit([], nj.SIMILARITY, nj.TREES)
    assert not len(none.met(sets, paths)) and not len(none.met([], []))


def test_audit_takes_one_of_a_group():
    base = prose(5, 200).split()
    sets = sets_of([" ".join([*base, f"end{i}"]) for i in range(50)] + [prose(6, 80)])
    assert len(nj.Audit(sets, nj.SIMILARITY, nj.TREES).sets) == 2


def counts(depth_of_each, band=0, documents=40):
    """Every audited document has one link in the band for each depth given."""
    out = {}
    for m in range(documents):
        for depth in depth_of_each:
            code = (m * nj.BANDS + band) * (nj.DEPTH + 1) + depth
            out[code] = out.get(code, 0) + 1
    return out


def test_prefixes_are_shortened_until_the_target():
    everywhere = lambda *depths: {c: n for band in range(nj.BANDS) for c, n in counts(depths, band).items()}
    assert nj.forest_depth({}) == nj.match_depth()  # nothing measured: the chance at the threshold
    assert nj.forest_depth(everywhere(8, 8)) == 8
    assert nj.forest_depth(everywhere(8, 6)) == 6
    assert nj.forest_depth(everywhere(8, 8, 3)) == 3
    assert nj.forest_depth(everywhere(0)) == 1
    assert nj.forest_depth(counts([8], documents=nj.EVIDENCE - 1)) == nj.match_depth()
    hot = counts([8], band=0) | counts([8], band=1) | counts([8], band=2)
    hot = {c: n * (10_000 if c // (nj.BANDS * (nj.DEPTH + 1)) == 0 else 1) for c, n in hot.items()}
    lost = {(7 * nj.BANDS) * (nj.DEPTH + 1) + 2: 1}  # one link of another document, met at 2 only
    recall, documents = nj.measured_recall(hot | lost)
    assert documents.tolist() == [40, 40, 40]
    assert recall[0, 8] == pytest.approx(1 - 0.5 / 40)  # not hidden by the 10,000 links of one document
    assert nj.forest_depth(hot | lost) == 2


def test_depth_follows_the_data(spark, monkeypatch):
    used = []
    choose = nj.forest_depth
    monkeypatch.setattr(nj, "forest_depth", lambda *a: used.append(choose(*a)) or used[-1])
    monkeypatch.setattr(nj, "EVIDENCE", 5)

    def near(words, changed):  # 12 groups in each band of similarity, or in none
        texts = []
        for i in range(36):
            base = prose(3000 + i, words).split()
            cut = changed[i % 3]
            texts += [" ".join(base), " ".join(base[: len(base) - cut] + [f"x{i}{k}" for k in range(cut)])]
        return [(i, t, "en", "s", 0, "", "", 0, 0) for i, t in enumerate(texts)]

    for words, changed in ((104, (10, 7, 1)), (104, (11, 11, 11)), (104, (90, 90, 90))):
        rows = near(words, changed)
        assert found(spark, rows) == plain(rows)
    assert used[0] > used[2] == nj.match_depth()


def test_a_sample_never_lengthens_the_prefix(spark, monkeypatch):
    everywhere = lambda *depths: {c: n for band in range(nj.BANDS) for c, n in counts(depths, band).items()}
    assert nj.depth_in_use(everywhere(8, 8)) == nj.depth_in_use({}) == nj.match_depth()
    assert nj.depth_in_use(everywhere(8, 8, 3)) == 3
    monkeypatch.setattr(nj, "forest_depth", lambda *a: nj.DEPTH)  # what links of copies alone would tell
    rows = []
    for i in range(80):
        base = prose(7000 + i, 104).split()
        texts = [" ".join(base), " ".join(base[:-11] + [f"x{i}{k}" for k in range(11)])]
        rows += [(2 * i + k, t, "en", "s", 0, "", "", 0, 0) for k, t in enumerate(texts)]
    assert found(spark, rows) == plain(rows)


def test_pieces_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_BYTES", 20_000)
    long_ = prose(77, 6000).split()  # larger than a block by itself
    texts = [" ".join([*long_[:-k], *["z"] * k]) for k in range(1, 6)] + [prose(200 + i, 50) for i in range(10)]
    rows = [(i, t, "en", "s", 0, "", "", 0, 0) for i, t in enumerate(texts)]
    assert found(spark, rows) == plain(rows)


def test_only_open_pairs_are_compared(monkeypatch):
    sets = sets_of([prose(9, 50), prose(9, 50) + " more", prose(10, 50)])
    keys = np.array([[1, 4], [1, 4], [2, 4]])
    seen = []
    real = nj.overlaps
    monkeypatch.setattr(nj, "overlaps", lambda s, wanted: seen.append(int(wanted.sum())) or real(s, wanted))
    blocks = np.zeros(3, int)
    assert nj._links(sets, keys, blocks, 0, 0, 0, 0.8).tolist() == [[False, True, False], [True, False, False], [False] * 3]
    assert not nj._links(sets, keys, blocks, 0, 0, 1, 0.8).any()  # the pair met in the trie before
    assert seen == [6, 4]


@pytest.mark.parametrize("m", [2, 4, 5, 12])
def test_overlaps(m):
    rng = np.random.default_rng(m)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 7000)).astype(np.uint64)) for _ in range(m)]
    got = nj.overlaps(sets)
    for i in range(m):
        for j in range(m):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(100, 130)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    linked = [[] for _ in range(131)]
    for a, b in pairs:
        linked[a].append(b)
        linked[b].append(a)
    want = {m: min(g) for g in reachable(linked).values() for m in g}
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got and all(want[v] == root for v, root in got.items())
    assert set(got) == {x for p in pairs for x in p if p[0] != p[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest():
    linked = np.zeros((6, 6), bool)
    for a, b in ((1, 3), (3, 2), (4, 5)):
        linked[a, b] = linked[b, a] = True
    assert forest(linked).tolist() == [0, 1, 1, 1, 4, 4]
