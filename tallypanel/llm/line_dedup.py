"""Line dedup over range-partitioned line hashes.

Lines become 128-bit hashes of their key (stripped of ASCII white space, A-Z lower-cased).
The hashes are dealt by range of (hash, document, position) and sorted, so a key that holds
a third of all lines spans many parts. Each part is streamed: a key seen in
``min_docs`` documents loses its lines (all of them, or all but the first occurrence). Only a
part's first and last key can continue elsewhere; their lines are set aside and decided
from counts over all parts. What comes back are compressed bitmaps per document, no text.

Defined results: a null or empty text is one empty line; keys without a character are always
kept; rows equal in id and text are one document; ties of first occurrences go to the
smallest (id, fingerprint, position); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallypanel.llm.common import KEY, batch_of, doc_key, pack_rows, text_bytes, with_text
from tallypanel.session import materialize

MIN_DOCS = 10
MIN_CHARS = 1
HASH = ["h1", "h2"]
PLACE = ["doc", "fp", "pos"]
# What a streamed row says.
DROP, ASIDE, REACHED = 0, 1, 2

_LINES = pa.schema([(c, pa.int64()) for c in (*HASH, *KEY)] + [("pos", pa.int32())])
_SEEN = pa.schema([*_LINES, ("says", pa.int32())])


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, fps, texts = (batch.column(i) for i in range(3))
            digests, counts, positions = [], [], []
            for text in texts.to_pylist():
                n = 0
                for pos, line in enumerate(text.split(b"\n")):
                    key = line_key(line)
                    if key and (min_chars < 2 or len(key.decode("utf-8", "replace")) >= min_chars):
                        digests.append(hashlib.blake2b(key, digest_size=16).digest())
                        positions.append(pos)
                        n += 1
                counts.append(n)
            if digests:
                pairs = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield batch_of(
                    _LINES, pairs[:, 0], pairs[:, 1],
                    np.repeat(docs.to_numpy(), counts), np.repeat(fps.to_numpy(), counts),
                    np.array(positions, np.int32),
                )

    return run


def _stream(min_docs: int, keep_first: bool):
    """Streams one part, sorted by hash and place. Holds at most the lines of
    ``min_docs`` documents with one key, and one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 5  # the open key's lines while it is below min_docs
        open_key, reached, first_key = None, False, None

        def rows(columns, says):
            return batch_of(_SEEN, *columns[:4], columns[4].astype(np.int32), says)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(i).to_numpy() for i in range(5)]
            if first_key is None:
                first_key = (new[0][0], new[1][0])
            if reached:
                end = int(np.argmin(np.append((new[0] == open_key[0]) & (new[1] == open_key[1]), False)))
                if end:
                    says = ASIDE if open_key == first_key else DROP
                    yield rows([c[:end] for c in new], np.full(end, says, np.int32))
                    new = [c[end:] for c in new]
                if not len(new[0]):
                    continue
                reached = False
            cols = [np.concatenate(pair) for pair in zip(held, new)]
            h1, h2, doc, fp, _ = cols
            n = len(h1)
            fresh = np.ones(n, bool)
            fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            other = fresh.copy()
            other[1:] |= (doc[1:] != doc[:-1]) | (fp[1:] != fp[:-1])
            starts = np.flatnonzero(fresh)
            docs = np.add.reduceat(other.astype(np.int64), starts)
            lengths = np.diff(np.append(starts, n))
            enough = docs >= min_docs
            says = np.where(enough, DROP, -1).astype(np.int32)
            if (h1[0], h2[0]) == first_key:
                says[0] = ASIDE
            if not enough[-1]:
                says[-1] = -1
            per_row = np.repeat(says, lengths)
            if keep_first:
                firsts = starts[says == DROP]
                per_row[firsts] = -1
            out = per_row >= 0
            if out.any():
                yield rows([c[out] for c in cols], per_row[out])
            open_key, reached = (h1[-1], h2[-1]), bool(enough[-1])
            held = [c[n:] if reached else c[starts[-1] :] for c in cols]
        if len(held[0]):
            yield rows(held, np.full(len(held[0]), ASIDE, np.int32))
        elif reached and open_key != first_key:
            mark = [np.array([v], np.int64) for v in (*open_key, 0, 0, 0)]
            yield rows(mark, np.array([REACHED], np.int32))

    return run


def dropped_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False, min_chars: int = MIN_CHARS
) -> DataFrame:
    """``doc, fp, pos`` of each line to drop."""
    keyed = docs.select(*[c.alias(k) for k, c in doc_key().items()], text_bytes().alias("text"))
    types = "h1 long, h2 long, doc long, fp long, pos int"
    lines = materialize(keyed.mapInArrow(_hash_lines(min_chars), types), "lines")
    dealt = lines.repartitionByRange(*HASH, *PLACE).sortWithinPartitions(*HASH, *PLACE)
    seen = materialize(dealt.mapInArrow(_stream(min_docs, keep_first), f"{types}, says int"), "seen")
    aside = seen.where(F.col("says") != DROP)
    # At most two keys per part, so what is broadcast is bounded by the parts.
    per_doc = aside.groupBy(*HASH, *KEY).agg(
        F.min("pos").alias("pos"), F.max(F.col("says") == REACHED).alias("reached")
    )
    keys = per_doc.groupBy(*HASH).agg(
        F.count("*").alias("docs"),
        F.min(F.struct(*PLACE)).alias("first"),
        F.max("reached").alias("reached"),
    )
    keys = keys.where(F.col("reached") | (F.col("docs") >= min_docs))
    decided = aside.where(F.col("says") == ASIDE).join(F.broadcast(keys), HASH)
    if keep_first:
        decided = decided.where(F.col("reached") | (F.struct(*PLACE) != F.col("first")))
    return seen.where(F.col("says") == DROP).select(*PLACE).unionByName(decided.select(*PLACE))


def pack_bitmap(dropped: np.ndarray) -> bytes:
    """Bit ``i`` is 1 if line ``i`` stays; lines beyond the last byte stay."""
    keep = np.ones(int(dropped.max()) + 1, bool)
    keep[dropped] = False
    padded = np.ones(-(-len(keep) // 8) * 8, bool)
    padded[: len(keep)] = keep
    return zlib.compress(np.packbits(padded).tobytes(), 6)


def unpack_bitmap(bitmap: bytes | None, lines: int) -> np.ndarray:
    keep = np.ones(lines, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:lines]
        keep[: len(bits)] = bits.astype(bool)
    return keep


def keep_bitmaps(
    docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False, min_chars: int = MIN_CHARS
) -> DataFrame:
    """``doc, fp, bitmap`` for each document that loses lines."""
    schema = pa.schema([("doc", pa.int64()), ("fp", pa.int64()), ("bitmap", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [pack_bitmap(np.array(p, np.int64)) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], schema=schema)

    dropped = dropped_lines(docs, min_docs, keep_first, min_chars)
    # A group is the lines of one document.
    grouped = dropped.groupBy(*KEY).agg(F.collect_list("pos").alias("at"))
    return grouped.mapInArrow(pack, "doc long, fp long, bitmap binary")


def _apply(batches: Iterator[pa.RecordBatch], text_at: int, bitmap_at: int, make):
    for batch in batches:
        texts, maps = batch.column(text_at).to_pylist(), batch.column(bitmap_at).to_pylist()
        out = []
        for text, bitmap in zip(texts, maps):
            lines = text.split(b"\n")
            keep = unpack_bitmap(bitmap, len(lines))
            kept = text if bitmap is None else b"\n".join(x for x, k in zip(lines, keep) if k)
            out.append((len(lines), int((~keep).sum()), kept))
        yield make(batch, out)


def line_report(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` per row of ``docs``."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())]
    )

    def make(batch, out):
        sha = [hashlib.sha256(kept).hexdigest() for _, _, kept in out]
        return batch_of(schema, batch.column(0), [o[0] for o in out], [o[1] for o in out], sha)

    rows = docs.select("doc_id", text_bytes().alias("text"), *[c.alias(k) for k, c in doc_key().items()])
    joined = rows.join(keep_bitmaps(docs, min_docs).hint("shuffle_hash"), KEY, "left")
    return joined.select("doc_id", "text", "bitmap").mapInArrow(
        lambda it: _apply(it, 1, 2, make), "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    )


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """The documents without the dropped lines, with their columns; all documents stay."""
    packed = pack_rows(docs, **doc_key())
    joined = packed.join(keep_bitmaps(docs, min_docs, keep_first).hint("shuffle_hash"), KEY, "left")

    @F.pandas_udf("string")
    def cut(texts, maps):
        def one(text, bitmap):
            if text is None or bitmap is None:
                return None
            lines = text.split("\n")
            return "\n".join(x for x, k in zip(lines, unpack_bitmap(bitmap, len(lines))) if k)

        return texts.combine(maps, one)

    # Only texts that change go through Python.
    changing = F.when(F.col("bitmap").isNotNull(), F.col("row.text"))
    return with_text(
        joined.withColumn("new_text", F.coalesce(cut(changing, "bitmap"), "row.text")), docs.columns
    )
