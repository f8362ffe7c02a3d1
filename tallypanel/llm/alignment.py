"""Alignment of two tokenizers' tokens over the same bytes.

Tokens of both tokenizers cover the same bytes of a text. Every token points to the farthest-right
token of the other side that overlaps it, and the pointers of all tokens of a batch are doubled at
once (each takes its successor's successor) until nothing moves. Each then names the last token of
its component of the overlap graph, the one that ends where tokens of both sides end, which labels
the groups. A link is a pair of overlapping token occurrences; where a token of either side begins,
a link begins.

Texts are tokenized once. Where a space parts two characters that are no white space, and where line
breaks follow such a character, tokens of both sides begin (checked from the vocabularies). So
texts are cut there and a worker aligns the words it does not remember, all of a batch as one
text; texts with other white space are aligned as a whole. A row per document is stored with the document's distinct linked id
pairs and how often it holds each, and beside them each task's sums of the pairs. The sums of the
tasks are the corpus counts. Counts of the commonest pairs (at most ``HOT``, chosen by size class
of the count) are broadcast; all other pairs of a document are joined with their counts. Where all
pairs fit, nothing is left to join.

Defined results: null and empty texts, and those that a tokenizer does not render byte for byte,
have no tokens; texts of any length are aligned whole (memory is bounded by the longest text);
strings of special tokens are plain text; repeated rows count each; null ids stay null; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallypanel.llm.common import batch_of, held, prepare, slices
from tallypanel.llm.words import WordTable, sums
from tallypanel.session import materialize

SLICE = 500_000  # characters that are tokenized at a time
MOST_WORDS = 120_000  # aligned words that a worker remembers: about 40 MB
LONGEST_WORD = 200  # characters; a text with a longer one is aligned as a whole
HOT = 1 << 19  # pairs whose counts are broadcast: at most 9 MB
NEVER = 2**63 - 1  # no count reaches it
MOST_PAIRS = 1 << 18  # pairs that a task sums before it sends them on: about 15 MB while they are merged
A_END, B_END, COMMA = ord("|"), ord(";"), ord(",")


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself where it prints,
    else one of those from U+0100 on, in order."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in prints}
    others = (b for b in range(256) if chr(b) not in out)
    return out | {chr(0x100 + n): b for n, b in enumerate(list(others))}


class Spelling:
    """The bytes of ids as arrays, and their decimal digits."""

    def __init__(self, of_id: list[bytes]):
        self.lengths = np.array([len(b) for b in of_id], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.raw = np.frombuffer(b"".join(of_id), np.uint8)
        width = len(str(max(1, len(of_id) - 1)))
        texts = b"".join(str(i).encode().rjust(width, b"\0") for i in range(len(of_id)))
        self.digits = np.frombuffer(texts, np.uint8).reshape(len(of_id), width)

    def __len__(self) -> int:
        return len(self.lengths)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.raw[np.arange(total) + np.repeat(self.begins[ids] - (ends - lengths), lengths)]


@dataclass
class Aligned:
    """The tokens of some texts, one after another. ``docs`` are the places of the texts."""

    docs: np.ndarray
    n_a: np.ndarray  # by text
    n_b: np.ndarray
    a: np.ndarray  # ids
    b: np.ndarray
    group_a: np.ndarray  # by token, numbered over all texts
    group_b: np.ndarray
    link_a: np.ndarray  # tokens of each link
    link_b: np.ndarray


def terminals(follow: np.ndarray) -> np.ndarray:
    """Where each pointer chain ends, by doubling the pointers that still move."""
    follow = follow.copy()
    moving = np.flatnonzero(follow[follow] != follow)
    while len(moving):
        further = follow[follow[moving]]
        changed = further != follow[moving]
        follow[moving] = further
        moving = moving[changed]
    return follow


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts


def _by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each text's values."""
    ends = np.concatenate([[0], np.cumsum(values)])
    at = np.concatenate([[0], np.cumsum(counts)])
    return ends[at[1:]] - ends[at[:-1]]


class Aligner:
    """Tokenizes by a byte-level BPE (side A) and by a piece model (side B) and aligns."""

    def __init__(self, raw_a: bytes, raw_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(raw_a)
        self.tokenizer.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=raw_b)
        told = json.loads(raw_a)
        of_b = self._bytes_b()
        self.spell_a, self.spell_b = Spelling(self._bytes_a(told)), Spelling(of_b)
        # Whether words begin tokens on both sides: side A's are found by its usual pattern, and no
        # piece of side B has a space behind another character or a line break beside one.
        before = told.get("pre_tokenizer") or {}
        usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not told.get("normalizer")
        joined = any(b" " in b.lstrip(b" ") or (b"\n" in b and b.strip(b"\n")) for b in of_b)
        self.by_word = bool(usual and not joined)

    def _bytes_a(self, told: dict) -> list[bytes]:
        alphabet = byte_alphabet()
        entries = {i: bytes(map(alphabet.__getitem__, token)) for token, i in told["model"]["vocab"].items()}
        for token in told.get("added_tokens", ()):
            entries.setdefault(token["id"], token["content"].encode())
        return [entries.get(i, b"") for i in range(max(entries) + 1)]

    def _bytes_b(self) -> list[bytes]:
        model = self.pieces
        return [
            bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(model.get_piece_size())
        ]

    def align(self, texts: list[str]) -> Aligned:
        docs = np.array([k for k, t in enumerate(texts) if t], np.int64)
        spaced = [" " + texts[k] for k in docs]
        raw = [t.encode() for t in spaced]
        ids_a = [e.ids for e in self.tokenizer.encode_batch_fast(spaced, add_special_tokens=False)]
        ids_b = self.pieces.encode([texts[k] for k in docs], num_threads=1)
        # Only texts that both sides render whole: first by length, then byte by byte.
        sizes = np.array([len(r) for r in raw], np.int64)
        good = np.ones(len(docs), bool)
        for ids, spelling in ((ids_a, self.spell_a), (ids_b, self.spell_b)):
            flat, counts = _flat(ids)
            good &= _by_text(spelling.lengths[flat], counts) == sizes
        for ids, spelling in ((ids_a, self.spell_a), (ids_b, self.spell_b)):
            kept = np.flatnonzero(good)
            flat, _ = _flat([ids[k] for k in kept])
            wrong = spelling.spell(flat) != np.frombuffer(b"".join(raw[k] for k in kept), np.uint8)
            ends = np.cumsum(sizes[kept])
            good[kept[np.searchsorted(ends, np.flatnonzero(wrong), "right")]] = False
        kept = np.flatnonzero(good)
        a, n_a = _flat([ids_a[k] for k in kept])
        b, n_b = _flat([ids_b[k] for k in kept])
        return self._grouped(docs[kept], n_a, n_b, a, b)

    def align_words(self, words: list[str]) -> Aligned | None:
        """Each word as a text of its own, but aligned as one text, where the words begin tokens
        on both sides. A word that begins with a line break has no space before it. None if the
        text is not rendered whole."""
        whole = " a" + "".join([w if w[0] == "\n" else " " + w for w in words])
        raw = whole.encode()
        a = np.array(self.tokenizer.encode_batch_fast([whole], add_special_tokens=False)[0].ids, np.int64)
        b = np.array(self.pieces.encode(whole[1:]), np.int64)
        told = np.frombuffer(raw, np.uint8)
        for ids, spelling in ((a, self.spell_a), (b, self.spell_b)):
            spelled = spelling.spell(ids)
            if len(spelled) != len(told) or (spelled != told).any():
                return None
        sizes = np.fromiter((len(w.encode()) + (w[0] != "\n") for w in words), np.int64, len(words))
        ends = 2 + np.cumsum(sizes)
        last_a, last_b = np.cumsum(self.spell_a.lengths[a]), np.cumsum(self.spell_b.lengths[b])
        # The tokens up to the end of each word; the first word is no word of ours.
        upto_a = np.searchsorted(last_a, np.concatenate([[2], ends]), "right")
        upto_b = np.searchsorted(last_b, np.concatenate([[2], ends]), "right")
        if (last_a[upto_a - 1] != np.concatenate([[2], ends])).any() or (last_b[upto_b - 1] != np.concatenate([[2], ends])).any():
            return None
        own_a, own_b = a[upto_a[0] :], b[upto_b[0] :]
        return self._grouped(np.arange(len(words)), np.diff(upto_a), np.diff(upto_b), own_a, own_b)

    def _grouped(self, docs, n_a, n_b, a, b) -> Aligned:
        ends_a, ends_b = np.cumsum(self.spell_a.lengths[a]), np.cumsum(self.spell_b.lengths[b])
        size = int(ends_a[-1]) if len(a) else 0
        begins = np.zeros((2, size), np.int32)
        begins[0, ends_a - self.spell_a.lengths[a]] = 1
        begins[1, ends_b - self.spell_b.lengths[b]] = 1
        # The token of each side that holds a byte.
        cover = np.cumsum(begins, 1, dtype=np.int64) - 1
        far_a, far_b = cover[1, ends_a - 1], cover[0, ends_b - 1]
        # Of two that end together, B's ends the component.
        itself = np.arange(len(b)) + len(a)
        follow = np.concatenate([len(a) + far_a, np.where(ends_a[far_b] > ends_b, far_b, itself)])
        last = terminals(follow) - len(a)
        number = np.cumsum(follow[len(a) :] == itself) - 1
        starts = np.flatnonzero(begins[0] | begins[1])
        return Aligned(
            docs, n_a, n_b, a, b, number[last[: len(a)]], number[last[len(a) :]], cover[0, starts], cover[1, starts]
        )

    # ---- what is derived from an alignment

    def group_texts(self, found: Aligned) -> list[bytes]:
        """``a1,a2|b1;a3|b2`` of each text: decimal ids in order, groups ended by ``;``."""
        n_a, n_b = len(found.a), len(found.b)
        groups = int(found.group_b[-1]) + 1 if n_b else 0
        of_a, of_b = np.bincount(found.group_a, minlength=groups), np.bincount(found.group_b, minlength=groups)
        # A group's A tokens come first, then its B tokens.
        at_a = np.arange(n_a) + (np.cumsum(of_b) - of_b)[found.group_a]
        at_b = np.arange(n_b) + np.cumsum(of_a)[found.group_b]
        wide_a, wide_b = self.spell_a.digits.shape[1], self.spell_b.digits.shape[1]
        rows = np.zeros((n_a + n_b, max(wide_a, wide_b) + 1), np.uint8)
        rows[at_a, :wide_a] = self.spell_a.digits[found.a]
        rows[at_b, :wide_b] = self.spell_b.digits[found.b]
        rows[at_a, -1] = np.where(np.append(found.group_a[1:], -1) != found.group_a, A_END, COMMA)
        rows[at_b, -1] = np.where(np.append(found.group_b[1:], -1) != found.group_b, B_END, COMMA)
        shown = rows > 0
        ends = np.concatenate([[0], np.cumsum(shown.sum(1))])[np.concatenate([[0], np.cumsum(found.n_a + found.n_b)])]
        flat = rows[shown].tobytes()
        return [flat[x : y - 1] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def group_counts(self, found: Aligned) -> np.ndarray:
        """Groups of each text."""
        ends = np.append(found.group_b[1:] != found.group_b[:-1], True) if len(found.b) else np.zeros(0, bool)
        return _by_text(ends.astype(np.int64), found.n_b)

    def links(self, found: Aligned) -> tuple[np.ndarray, np.ndarray]:
        """The text (by its place among ``docs``) and the id pair of each link, in order."""
        owner = np.repeat(np.arange(len(found.docs)), found.n_a)
        return owner[found.link_a], found.a[found.link_a] * len(self.spell_b) + found.b[found.link_b]


class AlignedWords(WordTable):
    """What is known of each word: its group text, its counts and its links."""

    def __init__(self, tool: Aligner):
        self.tool = tool
        super().__init__(self._aligned, most=MOST_WORDS)

    def _start(self) -> None:
        super()._start()
        self.texts: list[bytes] = []
        self.keys = np.zeros(0, np.int64)

    def _aligned(self, words: list[str]) -> list[np.ndarray]:
        # White space at an end may belong to a token with what is beside it, and side B writes
        # a space as U+2581.
        plain = np.array([_is_plain(w) for w in words], bool)
        at = np.flatnonzero(plain)
        found = self.tool.align_words([words[k] for k in at]) if len(at) else None
        counts = np.zeros((len(words), 4), np.int64)
        texts = [b""] * len(words)
        keys = np.zeros(0, np.int64)
        if found is None:
            plain[:] = False
        else:
            owner, keys = self.tool.links(found)
            n_links = np.bincount(owner, minlength=len(at))
            for k, values in enumerate((found.n_a, found.n_b, self.tool.group_counts(found), n_links)):
                counts[at, k] = values
            for k, text in zip(at.tolist(), self.tool.group_texts(found)):
                texts[k] = text
        begins = len(self.keys) + np.cumsum(counts[:, 3]) - counts[:, 3]
        self.texts += texts
        self.keys = np.concatenate([self.keys, keys])
        return [counts, begins, plain]


def _is_plain(word: str) -> bool:
    """Whether a word can be aligned by itself."""
    inner = word.lstrip("\n")
    return bool(inner) and not (inner[0].isspace() or inner[-1].isspace()) and "\u2581" not in word


_LINE_ENDS = re.compile("\n+")


def _words(text: str) -> list[str]:
    """Cut at spaces and before line breaks; the former go, the latter stay."""
    return _LINE_ENDS.sub(r" \g<0>", text).split(" ")


class Digester:
    """Counts, group texts and links of texts, word by word where that is the same."""

    def __init__(self, tool: Aligner):
        self.tool, self.words = tool, AlignedWords(tool)

    def digest(self, texts: list[str]):
        """``counts`` (A tokens, B tokens, groups, links) by text, the group text of each that
        has tokens, and of each link its text and id pair."""
        counts, shown = np.zeros((len(texts), 4), np.int64), [None] * len(texts)
        owners, keys = [], []
        cut = [_words(t) if t and self.tool.by_word else [] for t in texts]
        cut = [parts if parts and max(map(len, parts)) <= LONGEST_WORD else [] for parts in cut]
        numbers, sizes = self.words.numbers(cut)
        if sizes.any():
            each, begins, plain = self.words.columns
            good = (sizes > 0) & (_by_text(~plain[numbers], sizes) == 0)
            counts[good] = sums(each[numbers], sizes)[good]
            ends = np.cumsum(sizes)
            for k in np.flatnonzero(good).tolist():
                mine = numbers[ends[k] - sizes[k] : ends[k]].tolist()
                shown[k] = b";".join(map(self.words.texts.__getitem__, mine))
            owner = np.repeat(np.arange(len(texts)), sizes)
            used = good[owner]
            owner, mine = owner[used], numbers[used]
            n = each[mine, 3]
            place = np.arange(int(n.sum())) + np.repeat(begins[mine] - (np.cumsum(n) - n), n)
            owners.append(np.repeat(owner, n))
            keys.append(self.words.keys[place])
            done = set(np.flatnonzero(good).tolist())
        else:
            done = set()
        rest = [k for k, t in enumerate(texts) if t and k not in done]
        if rest:
            found = self.tool.align([texts[k] for k in rest])
            docs = np.array(rest, np.int64)[found.docs]
            owner, own = self.tool.links(found)
            n_links = np.bincount(owner, minlength=len(docs))
            for k, values in enumerate((found.n_a, found.n_b, self.tool.group_counts(found), n_links)):
                counts[docs, k] = values
            for k, text in zip(docs.tolist(), self.tool.group_texts(found)):
                shown[k] = text
            owners.append(docs[owner])
            keys.append(own)
        none = [np.zeros(0, np.int64)]
        return counts, shown, np.concatenate(owners or none), np.concatenate(keys or none)


def digester(raw_a: bytes, raw_b: bytes) -> Digester:
    """One per worker process and pair of vocabularies, until another operator uses the process;
    what it remembers is bounded."""
    store, key = held("alignment"), hashlib.sha256(raw_a + b"|" + raw_b).hexdigest()
    if key not in store:
        store.clear()
        store[key] = Digester(Aligner(raw_a, raw_b))
    return store[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _counted(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each one's times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def pack_pairs(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted keys as steps, and times, laid out byte by byte and compressed."""
    steps = np.diff(keys, prepend=np.int64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = times.astype("<u8").view(np.uint8).reshape(-1, 8)
    planes = np.concatenate([steps, counts], 1).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack_pairs(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(16, -1).T
    both = np.ascontiguousarray(planes).view("<u8").astype(np.int64)
    return np.cumsum(both[:, 0]), both[:, 1]


_STORED = pa.schema(
    [
        ("rid", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
        ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
        ("pairs", pa.binary()), ("key", pa.int64()), ("links", pa.int64()),
    ]
)
STORED_TYPES = (
    "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs binary, key long, links long"
)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


class _Sums:
    """A task's sums of pairs, sent on when they grow beyond ``MOST_PAIRS``."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, times: np.ndarray) -> None:
        self.held.append((keys, times))
        self.size += len(keys)

    def _merge(self) -> None:
        keys, times = _counted(*(np.concatenate(c) for c in zip(*self.held)))
        self.held, self.size = [(keys, times)], len(keys)

    def spill(self, always: bool = False) -> Iterator[pa.RecordBatch]:
        if not self.held or (self.size <= MOST_PAIRS and not always):
            return
        self._merge()
        if always or self.size > MOST_PAIRS // 2:
            keys, times = self.held[0]
            none = [None] * len(keys)
            yield batch_of(_STORED, *[none] * 8, keys, times)
            self.held, self.size = [], 0


def aligned_rows(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document, and rows of ``key, links`` with each task's sums of pairs."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast((_read(path_a), _read(path_b)))

    def run(batches):
        known, total = digester(*shared.value), _Sums()
        tool = known.tool
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                counts, shown, owner, keys = known.digest(part.column("text").to_pylist())
                # Distinct pairs of each text: a text's number above the pair's key.
                bits = (len(tool.spell_a) * len(tool.spell_b)).bit_length()
                both, times = _counted((owner << bits) | keys, np.ones(len(keys), np.int64))
                owner, keys = both >> bits, both & ((1 << bits) - 1)
                total.add(*_counted(keys, times))
                n = part.num_rows
                cuts = np.searchsorted(owner, np.arange(n + 1)).tolist()
                packed = [pack_pairs(keys[x:y], times[x:y]) if y > x else None for x, y in zip(cuts, cuts[1:])]
                shas = ["" if text is None else hashlib.sha256(text).hexdigest() for text in shown]
                none = [None] * n
                yield batch_of(_STORED, rid + np.arange(n), part.column("doc_id"), *counts.T, shas, packed, none, none)
                rid += n
                yield from total.spill()
        yield from total.spill(always=True)

    return _texts(docs).mapInArrow(run, STORED_TYPES)


def pair_counts(stored: DataFrame, n_b: int) -> DataFrame:
    """``key, links, best``: corpus count of each linked id pair and whether no pair of its B id
    has a higher one."""
    sums = stored.where("key IS NOT NULL").groupBy("key").agg(F.sum("links").alias("links"))
    sums = materialize(sums.withColumn("b", F.col("key") % n_b), "pairs")
    most = sums.groupBy("b").agg(F.max("links").alias("most"))
    found = sums.join(most, "b").select("key", "links", (F.col("links") == F.col("most")).alias("best"))
    return materialize(found, "pair-counts")


def _hot(counts: DataFrame, most: int) -> tuple[int, int]:
    """The least count of pairs that are broadcast, so that at most ``most`` are, and how many
    pairs are below it. At most 63 rows come to the driver; the counts are cut between powers of
    two, and if the uppermost step alone has too many pairs, none is broadcast."""
    steps = counts.groupBy(F.length(F.bin("links")).alias("bits")).count().collect()
    least, room, below = NEVER, most, 0
    for bits, n in sorted(((r["bits"], r["count"]) for r in steps), reverse=True):
        if n > room or below:
            below += n
        else:
            room -= n
            least = 1 << (bits - 1)
    return least, below


def align_report(docs: DataFrame, path_a: str, path_b: str, hot: int = HOT) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row."""
    stored = materialize(aligned_rows(docs, path_a, path_b), "aligned")
    tool = Aligner(_read(path_a), _read(path_b))
    counts = pair_counts(stored, len(tool.spell_b))
    least, below = _hot(counts, hot)
    table = counts.where(F.col("links") >= least).orderBy("key").toArrow() if least < NEVER else None
    if table is None:
        known = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    else:
        known = tuple(table.column(c).to_numpy() for c in ("key", "links", "best"))
    shared = docs.sparkSession.sparkContext.broadcast(known)
    schema = pa.schema(
        [*list(_STORED)[:7], ("n_best", pa.int64()), ("count_sum", pa.int64())]
        + [("rare", pa.list_(pa.struct([("key", pa.int64()), ("times", pa.int64())])))]
    )

    def look_up(batches):
        hot_keys, hot_links, hot_best = shared.value
        for batch in batches:
            n = batch.num_rows
            best, total, rare = np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
            for k, raw in enumerate(batch.column("pairs").to_pylist()):
                if raw is None:
                    continue
                keys, times = unpack_pairs(raw)
                at = np.minimum(np.searchsorted(hot_keys, keys), max(0, len(hot_keys) - 1))
                hit = hot_keys[at] == keys if len(hot_keys) else np.zeros(len(keys), bool)
                at, mine = at[hit], times[hit]
                best[k], total[k] = (mine * hot_best[at]).sum(), (mine * hot_links[at]).sum()
                if not hit.all():
                    rare[k] = [{"key": a, "times": b} for a, b in zip(keys[~hit].tolist(), times[~hit].tolist())]
            yield batch_of(schema, *[batch.column(f.name) for f in list(schema)[:7]], best, total, rare)

    rows = stored.where("rid IS NOT NULL").select("rid", *STORED_NAMES, "pairs")
    types = "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    told = rows.mapInArrow(look_up, f"{types}, n_best long, count_sum long, rare array<struct<key:long,times:long>>")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if not below:
        return told.select(*names)
    told = materialize(told, "told")
    spread = told.select("rid", F.explode("rare").alias("pair")).select("rid", "pair.key", "pair.times")
    met = spread.join(counts.where(F.col("links") < least).hint("merge"), "key")
    more = met.groupBy("rid").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("links")).alias("more_sum"),
    )
    whole = told.join(more, "rid", "left")
    added = {
        "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
        "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0)),
    }
    return whole.withColumns(added).select(*names)


STORED_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id`` and ``groups`` per row: of each group its byte range in space + text and the
    ids of both sides."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast((_read(path_a), _read(path_b)))
    group = pa.struct(
        [("begin", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]
    )
    schema = pa.schema([("doc_id", pa.int64()), ("groups", pa.list_(group))])

    def cut(ids: np.ndarray, of: np.ndarray) -> list[list[int]]:
        return [part.tolist() for part in np.split(ids, np.flatnonzero(np.diff(of)) + 1)]

    def run(batches):
        tool = digester(*shared.value).tool
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = tool.align(part.column("text").to_pylist())
                groups: list[list] = [[] for _ in range(part.num_rows)]
                at_a, at_b = np.cumsum(found.n_a), np.cumsum(found.n_b)
                for k, doc in enumerate(found.docs.tolist()):
                    of_a = slice(at_a[k] - found.n_a[k], at_a[k])
                    of_b = slice(at_b[k] - found.n_b[k], at_b[k])
                    begin = 0
                    for a, b in zip(cut(found.a[of_a], found.group_a[of_a]), cut(found.b[of_b], found.group_b[of_b])):
                        end = begin + int(tool.spell_a.lengths[a].sum())
                        groups[doc].append({"begin": begin, "end": end, "a": a, "b": b})
                        begin = end
                yield batch_of(schema, part.column("doc_id"), groups)

    types = "doc_id long, groups array<struct<begin:long,end:long,a:array<int>,b:array<int>>>"
    return _texts(docs).mapInArrow(run, types)


def render_groups(groups: Iterable[dict]) -> str:
    """The text whose checksum ``align_report`` gives, from a row of ``align_documents``."""
    return ";".join(",".join(map(str, g["a"])) + "|" + ",".join(map(str, g["b"])) for g in groups)
