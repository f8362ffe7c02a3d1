import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import SCHEMA, documents, frame

from tallypanel.llm import line_dedup as ld

TRIM = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs=10, keep_first=False):
    """Kept lines per row, by a dictionary of all keys."""
    docs, first = defaultdict(set), {}
    for row in rows:
        for pos, line in enumerate((row[1] or "").split("\n")):
            key = line.strip(TRIM).translate(LOWER)
            if key:
                docs[key].add((row[0], row[1]))
    out = []
    for row in rows:
        lines = (row[1] or "").split("\n")
        keys = [x.strip(TRIM).translate(LOWER) for x in lines]
        out.append([bool(k) and len(docs[k]) >= min_docs for k in keys])
    return out


def test_report(spark):
    rows = documents()
    got = sorted(map(tuple, ld.line_report(frame(spark)).collect()), key=repr)
    want = []
    for row, drop in zip(rows, plain(rows)):
        lines = (row[1] or "").split("\n")
        kept = "\n".join(x for x, d in zip(lines, drop) if not d)
        want.append((row[0], len(lines), sum(drop), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert sum(w[2] for w in want) > 20


def test_empty(spark):
    assert ld.line_report(frame(spark, [])).count() == 0
    assert ld.dedup_lines(frame(spark, [])).count() == 0


def test_documents_keep_columns_and_rows(spark):
    docs = frame(spark)
    got = ld.dedup_lines(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    row = got.where("doc_id = 17").first()
    assert "hared" not in row["text"] and row["n_chars"] == len(row["text"]) and row["size"] == "x"
    assert got.where("doc_id = 500").first()["text"] is None


def test_hot_line_over_many_parts(spark):
    rows = [(i, f"Hot\nown {i}\nHOT \nhot", "en", "s", 1, "", "", 0, 0) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = ld.line_report(frame(spark, rows)).collect()
        kept = ld.dedup_lines(frame(spark, rows), keep_first=True).orderBy("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert all(r["n_dropped"] == 3 for r in got)
    assert kept[0]["text"] == "Hot\nown 0" and all(r["text"] == f"own {r['doc_id']}" for r in kept[1:])


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
@pytest.mark.parametrize("keep_first", [False, True])
def test_stream_in_any_batches(size, keep_first):
    """Whatever the cut into batches, decided lines are the same."""
    rng = np.random.default_rng(size)
    rows = sorted({(int(rng.integers(0, 6)), 0, int(rng.integers(0, 30)), 0, int(rng.integers(0, 4))) for _ in range(160)})
    columns = [np.array(c, np.int64) for c in zip(*rows)]
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array(c[a : a + size].astype(np.int32 if k == 4 else np.int64)) for k, c in enumerate(columns)], schema=ld._LINES
        )
        for a in range(0, len(rows), size)
    ]
    out = [tuple(r.values()) for b in ld._stream(10, keep_first)(iter(batches)) for r in b.to_pylist()]
    docs = defaultdict(set)
    for r in rows:
        docs[r[0]].add(r[2])
    ends = {rows[0][0], rows[-1][0]}
    sure = {r[:5] for r in out if r[5] == ld.DROP and r[0] not in ends}
    first = {h: min(r for r in rows if r[0] == h) for h in docs}
    want = {r for r in rows if len(docs[r[0]]) >= 10 and r[0] not in ends and not (keep_first and r == first[r[0]])}
    assert sure == want
    aside = {r[:5] for r in out if r[5] == ld.ASIDE}
    assert {r for r in rows if r[0] == rows[0][0]} <= aside


def test_bitmaps():
    for dropped in ([0], [3, 9], [7], [8], [100, 5000]):
        keep = ld.unpack_bitmap(ld.pack_bitmap(np.array(dropped)), 6000)
        assert np.flatnonzero(~keep).tolist() == dropped
    assert ld.unpack_bitmap(None, 3).all()


def test_schema_has_clashing_names():
    assert "size" in SCHEMA and "fp" in SCHEMA
