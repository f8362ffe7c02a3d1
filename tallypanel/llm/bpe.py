"""Byte-level BPE encoding and decoding by a rank file.

A text is cut by the pattern and each match is merged on its own: again and again the
leftmost pair of the lowest rank becomes one token, whose id is its rank. A segment tree
over the byte positions of the match holds ``rank, position`` of the pair that starts at
each live position; its root is the next merge, and a merge updates the leaves of three
positions: the merged one, the swallowed one and the live one before it.

Short matches are merged many at a time: one array holds the trees of all matches of one
size class and each step does one merge in every tree. Longer ones have a tree each.

Defined results: a null or empty text has no tokens; texts are never cut for their length
(memory is bounded by the longest text); repeated rows are encoded each; ids decode to the
exact bytes; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallypanel.llm.common import batch_of, held, pack_rows, slices

NONE = np.int64(1) << 40  # no pair starts here; above every rank and position
MOST_AT_ONCE = 1 << 19  # leaves in the arrays of one step
LONGEST_SHARED = 256  # bytes of a match that is merged beside others
MOST_KEPT = 48_000_000  # bytes, about, of what a worker remembers of encoded matches
ENTRY = 150  # bytes of a remembered match besides its text and ids
LONGEST_KEPT = 128
SLICE = 1_000_000  # characters that are encoded at a time


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


class SegmentTree:
    """Minimum over positions, with point updates."""

    def __init__(self, values: list[int]):
        size = 1
        while size < len(values):
            size *= 2
        self.size = size
        self.node = [int(NONE)] * size + values + [int(NONE)] * (size - len(values))
        for i in range(size - 1, 0, -1):
            self.node[i] = min(self.node[2 * i], self.node[2 * i + 1])

    def set(self, at: int, value: int) -> None:
        node, i = self.node, at + self.size
        node[i] = value
        while i > 1:
            i //= 2
            least = min(node[2 * i], node[2 * i + 1])
            if node[i] == least:
                break
            node[i] = least


class Encoder:
    def __init__(self, raw: bytes, pattern: str):
        ranks = parse_ranks(raw)
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[int(k)] for k in self.pair_keys], np.int64)
        self.forget()

    def forget(self) -> None:
        self.kept: dict[str, bytes | None] = {}  # by what follows a space
        self.pieces: dict[str, bytes] = {}  # by match
        self.size = 0

    # ---- merging

    def _rank_at(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
        """``rank, position`` of the pairs as one number."""
        key = left << 20 | right
        found = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        ok = (self.pair_keys[found] == key) & (left >= 0) & (right >= 0)
        return np.where(ok, self.pair_ranks[found] << bits | at, NONE)

    def _merge_many(self, words: list[bytes], width: int) -> list[bytes]:
        """Packed ids of words of 2 to ``width`` bytes, ``width`` a power of two."""
        n, bits = len(words), width.bit_length() - 1
        lengths = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        at = np.arange(width)
        # A column more on both ends stands for "no neighbour".
        ids = np.full((n, width + 2), -1, np.int64)
        ids[:, 1:-1] = np.where(at < lengths[:, None], self.byte_id[raw], -1)
        after = np.minimum(np.arange(width + 2) + 1, width + 1)[None].repeat(n, 0)
        before = np.maximum(np.arange(width + 2) - 1, 0)[None].repeat(n, 0)
        tree = np.full((n, 2 * width), NONE, np.int64)
        tree[:, width:] = self._rank_at(ids[:, 1:-1], ids[:, 2:], at[None], bits)
        for low in [1 << k for k in range(bits - 1, -1, -1)]:
            kids = tree[:, 2 * low : 4 * low]
            tree[:, low : 2 * low] = np.minimum(kids[:, ::2], kids[:, 1::2])
        rows = np.arange(n)
        while True:
            rows = rows[tree[rows, 1] < NONE]
            if not len(rows):
                break
            top = tree[rows, 1]
            here = (top & (width - 1)) + 1
            gone = after[rows, here]
            following = after[rows, gone]
            previous = before[rows, here]
            token = top >> bits
            ids[rows, here] = token
            ids[rows, gone] = -1
            after[rows, here] = following
            before[rows, following] = here
            # Position 0 stands for "none": its leaf would lie outside, so the one after it
            # is written twice instead.
            left = np.where(previous > 0, previous, here)
            mine = self._rank_at(token, ids[rows, following], here - 1, bits)
            theirs = np.where(previous > 0, self._rank_at(ids[rows, left], token, left - 1, bits), mine)
            for leaf, value in ((gone - 1, NONE), (here - 1, mine), (left - 1, theirs)):
                node = leaf + width
                tree[rows, node] = value
                for _ in range(bits):
                    node >>= 1
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        inner = ids[:, 1:-1]
        live = inner >= 0
        flat = inner[live].astype("<u4").tobytes()
        ends = (np.cumsum(live.sum(1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _merge_one(self, word: bytes) -> bytes:
        """The same with one tree of its own, for long words."""
        ids = [int(self.byte_id[b]) for b in word]
        n, bits, pairs = len(ids), len(ids).bit_length(), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def pair_at(i: int) -> int:
            j = after[i]
            rank = pairs.get(ids[i] << 20 | ids[j]) if j < n else None
            return int(NONE) if rank is None else rank << bits | i

        tree = SegmentTree([pair_at(i) for i in range(n)])
        while (top := tree.node[1]) < NONE:
            here = top & ((1 << bits) - 1)
            gone = after[here]
            ids[here], ids[gone] = top >> bits, -1
            after[here] = after[gone]
            if after[gone] < n:
                before[after[gone]] = here
            tree.set(gone, int(NONE))
            tree.set(here, pair_at(here))
            if before[here] >= 0:
                tree.set(before[here], pair_at(before[here]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each match."""
        out: list[bytes] = [b""] * len(words)
        classes: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            rank = self.ranks.get(word)
            if rank is not None:
                out[k] = rank.to_bytes(4, "little")
            elif len(word) > LONGEST_SHARED:
                out[k] = self._merge_one(word)
            elif word:
                classes.setdefault(1 << (len(word) - 1).bit_length(), []).append(k)
        for width, members in classes.items():
            step = max(1, MOST_AT_ONCE // width)
            for a in range(0, len(members), step):
                part = members[a : a + step]
                for k, ids in zip(part, self._merge_many([words[i] for i in part], width)):
                    out[k] = ids
        return out

    # ---- texts

    def _matches(self, texts: Iterable[str]) -> list[list[str]]:
        """The matches of each text; those not known yet are merged."""
        found = [self.find(t) for t in texts]
        new = list({m for ms in found for m in ms if m not in self.pieces})
        ids = self.merge([m.encode() for m in new])
        self.pieces.update(zip(new, ids))
        self.size += ENTRY * len(new) + sum(map(len, new)) + sum(map(len, ids))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text.

        A space between two characters that are no white space always starts a match of the
        tokenizers' usual pattern (another ``pattern`` must do so as well), so texts are cut
        there and what was seen before is looked up. A text with other white space beside a
        space is cut by the pattern alone.
        """
        if self.size > MOST_KEPT:
            self.forget()
        kept, parts = self.kept, [t.split(" ") for t in texts]
        new = {p for ps in parts for p in ps[1:] if p not in kept}
        odd = {p for p in new if not p or p[0].isspace() or p[-1].isspace()}
        kept.update(dict.fromkeys(odd))
        new = list(new - odd)
        join, pieces = b"".join, self.pieces
        for part, ms in zip(new, self._matches([" " + p for p in new])):
            kept[part] = ids = join([pieces[m] for m in ms])
            self.size += ENTRY + len(part) + len(ids)
        heads = self._matches([ps[0] for ps in parts])
        out: list[bytes] = []
        odd_texts: list[int] = []
        for k, (ps, head) in enumerate(zip(parts, heads)):
            ids = list(map(kept.__getitem__, ps[1:]))
            if None in ids or (ids and ps[0] and ps[0][-1].isspace()):
                odd_texts.append(k)
                out.append(b"")
            else:
                out.append(join([pieces[m] for m in head]) + join(ids))
        for k, ms in zip(odd_texts, self._matches([texts[k] for k in odd_texts])):
            out[k] = join([pieces[m] for m in ms])
        for part in [p for p in new if len(p) > LONGEST_KEPT]:
            del kept[part]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(raw: bytes, pattern: str) -> Encoder:
    """One per worker process and vocabulary, until another operator uses the process."""
    store, key = held("bpe"), hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in store:
        store.clear()
        store[key] = Encoder(raw, pattern)
    return store[key]


def read_vocabulary(path: str) -> bytes:
    """Read on the driver; a rank file has a fixed size, so it may be broadcast."""
    with open(path, "rb") as file:
        return file.read()


def _encoded(batches, shared, pattern: str, text: str) -> Iterator[tuple[pa.RecordBatch, list[bytes], Encoder]]:
    coder = encoder(shared.value, pattern)
    for batch in batches:
        for part in slices(batch, text, SLICE):
            yield part, coder.encode(part.column(text).to_pylist()), coder


def token_report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    )

    def run(batches):
        for part, ids, coder in _encoded(batches, shared, pattern, "text"):
            yield batch_of(
                schema,
                part.column("doc_id"),
                [len(i) // 4 for i in ids],
                [hashlib.sha256(i).hexdigest() for i in ids],
                [hashlib.sha256(coder.decode(i)).hexdigest() for i in ids],
            )

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns but the text, with ``n_tokens`` and ``token_ids``."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches):
        for part, ids, _ in _encoded(batches, shared, pattern, "text"):
            counts = np.array([len(i) // 4 for i in ids], np.int64)
            values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            tokens = pa.ListArray.from_arrays(offsets, values)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(counts), tokens], names=["row", "n_tokens", "token_ids"]
            )

    names = [c for c in docs.columns if c not in ("text", "n_tokens", "token_ids")]
    rows = pack_rows(docs.select(*names, F.col("text").alias("text")), text=F.coalesce("text", F.lit("")))
    rows = rows.withColumn("row", F.col("row").dropFields("text")) if names else rows
    kind = rows.schema["row"].dataType.simpleString()
    out = rows.select("row", "text").mapInArrow(run, f"row {kind}, n_tokens long, token_ids array<int>")
    return out.select(*[F.col("row")[c].alias(c) for c in names], "n_tokens", "token_ids")


def decode_tokens(rows: DataFrame, path: str, tokens: str = "token_ids", out: str = "text") -> DataFrame:
    """``rows`` with the text of ``tokens``; bytes that are no UTF-8 become U+FFFD."""
    shared = rows.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    @F.pandas_udf("string")
    def decode(ids):
        coder = encoder(shared.value, r"\s+|\S+")
        return ids.map(
            lambda i: None if i is None else coder.decode(np.asarray(i, "<u4").tobytes()).decode("utf-8", "replace")
        )

    return rows.withColumn(out, decode(tokens))
