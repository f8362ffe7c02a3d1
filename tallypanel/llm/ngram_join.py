"""Documents with similar word n-grams, by a MinHash LSH forest and exact verification.

A text's set are the hashes of its runs of five words; a shorter text has one run of all its
words. Texts with equal sets are one class. Each class has a path of ``DEPTH`` minimum hashes
in each of ``TREES`` tries, which Spark keeps as paths in sorted order: a node of a trie is a run of
paths with one prefix. Classes meet where their paths share a prefix of the depth in use: the longest at which
the chance of a pair at the threshold reaches the target recall, for every table. Recall is audited as well: a
sample of documents is compared exactly with all documents, in the pass that computes the signatures, and for
each link so found the deepest common prefix is known. It is taken by document, at most one of a group, and
apart for bands of similarity. Where it is below the target the prefix is shortened, in all tries at once; what
a sample shows never makes it longer, so no pair is left out by it.

Classes in a node are candidates, and every candidate pair is verified on its whole sets, once,
in the first trie where it meets. Large nodes are cut along the order of paths into blocks that are
bounded in classes and bytes, each pair of blocks being a piece of work of its own, and a piece
returns sums and a spanning forest instead of its pairs.

Defined results: null and empty texts have no runs and link with nothing; texts are read
whole; texts with equal sets are linked; rows equal in id and text are one document, but
count among the links of others as often as they occur; a null id counts as 0 where ids are
compared; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallypanel.llm.common import KEY, batch_of, doc_key, ranked, slices, text_bytes
from tallypanel.llm.components import components, forest
from tallypanel.llm.words import WordTable
from tallypanel.session import materialize

N = 5
SIMILARITY = 0.8
TREES = 16
DEPTH = 8
RECALL = 0.995
BLOCK = 256  # classes of a node that one piece of work compares with as many others
BLOCK_BYTES = 4_000_000  # and the bytes of their sets, but for one set that is larger
AUDIT = 512  # documents, about, that are compared exactly to measure recall
AUDIT_BYTES = 16_384  # the longest text among them, so that the sample's size has a bound
EVIDENCE = 30  # sampled documents with links from which a band's recall is taken as measured
_WIDE = 3  # bytes of a path for each level
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def recall_at(depth: int, similarity: float, trees: int = TREES) -> float:
    """Chance that a pair shares a prefix of ``depth`` in at least one tree."""
    return 1 - (1 - similarity**depth) ** trees


def match_depth(similarity: float = SIMILARITY, target: float = RECALL, trees: int = TREES) -> int:
    """The longest prefix that reaches the target for pairs at ``similarity``."""
    depth = DEPTH
    while depth > 1 and recall_at(depth, similarity, trees) < target:
        depth -= 1
    return depth


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    return h ^ (h >> np.uint64(27))


class Shingler:
    def __init__(self, n: int):
        self.n = n
        self.table = WordTable(lambda words: [np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))])

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Sorted distinct hashes of each text's runs."""
        numbers, counts = self.table.numbers([t.split() for t in texts])
        words = self.table.columns[0][numbers]
        out, at = [], 0
        for count in counts.tolist():
            own = words[at : at + count]
            at += count
            size = min(self.n, count)
            h = np.zeros(max(0, count - size + 1) if count else 0, np.uint64)
            for k in range(size):
                h = h * _M1 + own[k : k + len(h)]
            out.append(np.unique(_mix(h + np.uint64(size))))
        return out


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over the set, block by block."""
    best = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 2048):
        part = shingles[a : a + 2048, None] * factors
        best = np.minimum(best, part.min(0))
    return best


def path_of(sig: np.ndarray) -> np.ndarray:
    """The bytes of all paths, trie after trie. The low bits are taken after mixing, as a
    minimum's high bits are nearly all zero."""
    return _mix(sig * _M1).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_WIDE].copy()


def _needed(size, similarity: float):
    """How many of a set's smallest hashes must be looked at: two sets at the threshold share one of them."""
    return size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1


class Audit:
    """Sampled sets, with an index of their smallest hashes."""

    def __init__(self, sets: list[np.ndarray], similarity: float, trees: int):
        self.similarity, self.trees = similarity, trees
        factors, seen = _multipliers(trees * DEPTH), set()
        self.sets, paths = [], []
        for s in sets:
            path = path_of(signature(s, factors)).reshape(trees, DEPTH, _WIDE)
            starts = {(t, path[t, 0].tobytes()) for t in range(trees)}
            if seen.isdisjoint(starts):  # one of a group is enough, and keeps hot groups cheap
                self.sets.append(s)
                paths.append(path)
            seen |= starts
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.paths = np.array(paths, np.uint8).reshape(-1, trees, DEPTH, _WIDE)
        heads = _needed(self.sizes, similarity)
        flat = [s[:k] for s, k in zip(self.sets, heads.tolist())]
        values = np.concatenate([np.zeros(0, np.uint64), *flat])
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], np.repeat(np.arange(len(self.sets)), heads)[order]

    def met(self, sets: list[np.ndarray], paths: list[np.ndarray]) -> np.ndarray:
        """A code of (member, band, deepest common prefix) for each link of a member with one of ``sets``
        other than its equals."""
        sizes = np.array([len(s) for s in sets], np.int64)
        heads = np.where(sizes > 0, _needed(sizes, self.similarity), 0)
        probe = np.concatenate([np.zeros(0, np.uint64), *[s[:k] for s, k in zip(sets, heads.tolist())]])
        low = np.searchsorted(self.values, probe)
        count = np.searchsorted(self.values, probe, "right") - low
        row = np.repeat(np.repeat(np.arange(len(sets)), heads), count)
        within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        member = self.owner[np.repeat(low, count) + within]
        pairs = np.unique(row * max(1, len(self.sets)) + member)
        row, member = np.divmod(pairs, max(1, len(self.sets)))
        small, large = np.minimum(sizes[row], self.sizes[member]), np.maximum(sizes[row], self.sizes[member])
        fits = small >= self.similarity * large
        codes = []
        for r, m in zip(row[fits].tolist(), member[fits].tolist()):
            both = len(np.intersect1d(sets[r], self.sets[m], assume_unique=True))
            alike = both / (len(sets[r]) + len(self.sets[m]) - both)
            if self.similarity <= alike < 1:
                same = (paths[r].reshape(self.paths[m].shape) == self.paths[m]).all(-1)
                depth = int(np.logical_and.accumulate(same, 1).sum(1).max())
                band = np.searchsorted(band_edges(self.similarity), alike, "right") - 1
                codes.append((m * BANDS + int(band)) * (DEPTH + 1) + depth)
        return np.array(codes, np.int64)


BANDS = 3


def band_edges(similarity: float) -> np.ndarray:
    """Lower ends of the bands of similarity."""
    return similarity + (1 - similarity) * np.array([0, 0.25, 0.5])


def measured_recall(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """From how often each code of ``Audit.met`` occurred: recall by band and depth, as the mean over the
    sampled documents with links in the band, and the number of these documents."""
    size = BANDS * (DEPTH + 1)
    table: dict[int, np.ndarray] = {}
    for code, n in counts.items():
        table.setdefault(code // size, np.zeros(size)).reshape(-1)[code % size] += n
    seen = np.array(list(table.values())).reshape(-1, BANDS, DEPTH + 1)
    total = seen.sum(2)
    reached = seen[:, :, ::-1].cumsum(2)[:, :, ::-1]  # met at this depth or deeper
    share = reached / np.maximum(total, 1)[:, :, None]
    documents = (total > 0).sum(0)
    return share.sum(0) / np.maximum(documents, 1)[:, None], documents


def forest_depth(
    counts: dict[int, int], similarity: float = SIMILARITY, target: float = RECALL, trees: int = TREES
) -> int:
    """Whole paths first, then one level less at a time until every band reaches the target."""
    recall, documents = measured_recall(counts)
    for depth in range(DEPTH, 1, -1):
        reached = [
            recall[band, depth] if documents[band] >= EVIDENCE else recall_at(depth, float(low), trees)
            for band, low in enumerate(band_edges(similarity))
        ]
        if min(reached) >= target:
            return depth
    return 1


def depth_in_use(
    counts: dict[int, int], similarity: float = SIMILARITY, target: float = RECALL, trees: int = TREES
) -> int:
    """The depth that the threshold asks for, or a lower one if the audit missed the target there. The audit is a
    sample, so it can add pairs that are compared but take none away."""
    return min(match_depth(similarity, target, trees), forest_depth(counts, similarity, target, trees))


def _sample(rows: DataFrame, n: int) -> list[np.ndarray]:
    """Sets of about ``AUDIT`` documents, chosen by a hash of their key."""
    every = max(1, rows.count() // AUDIT)
    by = F.xxhash64(*KEY, F.lit(3))
    some = rows.where(F.octet_length("text") <= AUDIT_BYTES).where(F.pmod(by, F.lit(every)) == 0)
    some = some.select(*KEY, "text").dropDuplicates(KEY).orderBy(by).limit(2 * AUDIT)
    found = some.mapInArrow(_sets(n), "doc long, fp long, shingles binary").orderBy(*KEY).collect()
    return [s for r in found if len(s := np.frombuffer(r["shingles"], np.uint64))]


def _signatures(n: int, trees: int, audit):
    schema = pa.schema(
        [("doc", pa.int64()), ("fp", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("n", pa.int64()),
         ("paths", pa.binary()), ("codes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
    )

    def run(batches):
        shingler, factors = Shingler(n), _multipliers(trees * DEPTH)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingler.sets(part.column("text").to_pylist())
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                paths = [path_of(signature(s, factors)) if len(s) else None for s in sets]
                ends = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                code, count = np.unique(audit.value.met(sets, paths), return_counts=True)
                rest = [None] * (len(sets) - 1)  # the audit's sums of a part stand in its first row
                yield batch_of(
                    schema, part.column("doc"), part.column("fp"), ends[:, 0], ends[:, 1], [len(s) for s in sets],
                    [p if p is None else p.tobytes() for p in paths], [code, *rest], [count, *rest],
                )

    return run


def _sets(n: int):
    schema = pa.schema([("doc", pa.int64()), ("fp", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        shingler = Shingler(n)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [s.tobytes() for s in shingler.sets(part.column("text").to_pylist())]
                yield batch_of(schema, part.column("doc"), part.column("fp"), sets)

    return run


def overlaps(sets: list[np.ndarray], wanted: np.ndarray | None = None) -> np.ndarray:
    """Sizes of pairwise intersections; where few pairs are ``wanted``, of these alone."""
    m = len(sets)
    pairs = np.argwhere(np.triu(np.ones((m, m), bool) if wanted is None else wanted, 1))
    if len(pairs) <= 2 * m:
        out = np.zeros((m, m), np.int64)
        for i, j in pairs.tolist():
            both = np.sort(np.concatenate([sets[i], sets[j]]), kind="stable")
            out[i, j] = out[j, i] = int((both[1:] == both[:-1]).sum())
        return out
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    out = np.zeros((m, m), np.float32)
    wide = 4096
    for a in range(0, int(shared.sum()), wide):
        lo, hi = np.searchsorted(column, [a, a + wide])
        incidence = np.zeros((m, wide), np.float32)
        incidence[owner[lo:hi], column[lo:hi] - a] = 1
        out += incidence @ incidence.T
    return np.rint(out).astype(np.int64)


def _links(sets, keys, blocks, i, j, tree, similarity) -> np.ndarray:
    """Which members are linked: verified pairs of this piece that met in no earlier trie. Only members of
    pairs that are open, by earlier tries and by size, have their sets compared."""
    sizes = np.array([len(s) for s in sets])
    open_ = np.minimum(sizes[:, None], sizes[None]) >= similarity * np.maximum(sizes[:, None], sizes[None])
    np.fill_diagonal(open_, False)
    if i != j:
        open_ &= blocks[:, None] != blocks[None]
    for t in range(tree):
        open_ &= keys[:, t][:, None] != keys[:, t][None]
    linked = np.zeros_like(open_)
    rows = np.flatnonzero(open_.any(1))
    if len(rows):
        cell = np.ix_(rows, rows)
        inter = overlaps([sets[r] for r in rows], open_[cell])
        union = sizes[rows][:, None] + sizes[rows][None] - inter
        linked[cell] = open_[cell] & (inter / np.maximum(union, 1) >= similarity)
    return linked


def _verify(similarity: float):
    piece = ["tree", "key", "i", "j"]
    schema = pa.schema([(c, pa.int64()) for c in ("doc", "fp", "root_doc", "root_fp", "links")])

    def solve(rows: pa.Table):
        sets = [np.frombuffer(b, np.uint64) for b in rows.column("shingles").to_pylist()]
        keys = np.array(rows.column("keys").to_pylist(), np.int64)
        tree, _, i, j = (rows.column(c)[0].as_py() for c in piece)
        linked = _links(sets, keys, rows.column("block").to_numpy(), i, j, tree, similarity)
        some = np.flatnonzero(linked.any(1))
        if len(some):
            doc, fp = rows.column("doc").to_numpy(), rows.column("fp").to_numpy()
            root = forest(linked)[some]
            links = linked.astype(np.int64) @ rows.column("size").to_numpy()
            yield batch_of(schema, doc[some], fp[some], doc[root], fp[root], links[some])

    def run(batches):
        held: list[pa.RecordBatch] = []  # the open piece, at most two blocks
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for c in piece:
                v = batch.column(c).to_numpy()
                new[1:] |= v[1:] != v[:-1]
                if held:
                    new[0] |= held[-1].column(c)[-1].as_py() != v[0]
            cuts = np.flatnonzero(new).tolist()
            at = 0
            for cut in [*cuts, None]:
                if cut is None or cut > at:
                    held.append(batch.slice(at, (batch.num_rows if cut is None else cut) - at))
                if cut is not None:
                    if held:
                        yield from solve(pa.Table.from_batches(held))
                    held, at = [], cut
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def similar_documents(
    docs: DataFrame, n: int = N, similarity: float = SIMILARITY, trees: int = TREES, target: float = RECALL
) -> DataFrame:
    """``doc_id, doc, fp, class_id, n_links, kept`` per row: the smallest id reachable by
    links, the number of other documents linked directly, and whether the row is the one
    that stands for its group."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_bytes().alias("text"), *[c.alias(k) for k, c in doc_key().items()])
    audit = spark.sparkContext.broadcast(Audit(_sample(rows, n), similarity, trees))
    signed = rows.select(*KEY, "text").mapInArrow(
        _signatures(n, trees, audit),
        "doc long, fp long, s1 long, s2 long, n long, paths binary, codes array<long>, counts array<long>",
    )
    signed = materialize(signed, "signatures")
    sums = signed.where("codes IS NOT NULL").select(F.explode(F.arrays_zip("codes", "counts")).alias("c"))
    sums = sums.groupBy("c.codes").agg(F.sum("c.counts").alias("n")).collect()
    depth = depth_in_use({r["codes"]: r["n"] for r in sums}, similarity, target, trees)
    filled = signed.where(F.col("paths").isNotNull())
    # A class stands for all texts with one set; the smallest document speaks for it.
    classes = filled.groupBy("s1", "s2").agg(
        F.min(F.struct("doc", "fp", "n", "paths")).alias("rep"), F.count("*").alias("size")
    )
    long_ = DEPTH * _WIDE
    path = [F.substring("rep.paths", t * long_ + 1, long_) for t in range(trees)]
    node = [F.xxhash64(F.lit(t), F.substring("rep.paths", t * long_ + 1, depth * _WIDE)) for t in range(trees)]
    classes = classes.select(
        "s1", "s2", "rep.doc", "rep.fp", "rep.n", "size", F.array(*node).alias("keys"), F.array(*path).alias("paths")
    )
    classes = materialize(classes, "classes")
    weight = F.greatest(F.col("n") * 8, F.lit(BLOCK_BYTES // BLOCK)).cast("long")
    met = classes.select(*KEY, weight.alias("weight"), F.posexplode(F.arrays_zip("keys", "paths")).alias("tree", "at"))
    met = met.select(*KEY, "weight", "tree", F.col("at.keys").alias("key"), F.col("at.paths").alias("path"))
    who = [F.bit_xor(F.xxhash64(*KEY)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), *KEY)).alias("y")]
    nodes = met.groupBy("tree", "key").agg(F.count("*").alias("m"), F.sum("weight").alias("w"), *who).where("m > 1")
    # Nodes with the same members are looked at once, in their first trie.
    first = nodes.groupBy("m", "w", "x", "y").agg(F.min(F.struct("tree", "key")).alias("b"))
    first = first.select("b.tree", "b.key", F.ceil(F.col("w") / BLOCK_BYTES).cast("int").alias("blocks"))
    # The tries: paths in order, a node's in one run, which may span parts.
    held = met.join(first.hint("shuffle_hash"), ["tree", "key"])
    members = ranked(held, ["path", *KEY], within=["tree", "key"], out="before", weight="weight")
    members = materialize(members.withColumn("block", F.floor(F.col("before") / BLOCK_BYTES).cast("int")), "members")
    wanted = members.select(*KEY).distinct()
    texts = rows.select(*KEY, "text").dropDuplicates(KEY) if _repeats(signed) else rows.select(*KEY, "text")
    sets = texts.join(wanted.hint("shuffle_hash"), KEY).mapInArrow(_sets(n), "doc long, fp long, shingles binary")
    sets = materialize(sets.join(classes.select(*KEY, "keys", "size"), KEY), "sets")
    # Block b works with each block of its node, in the piece (smaller, larger).
    pieces = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pieces = pieces.select(
        *KEY, F.col("tree").cast("long"), "key", "block",
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
    )
    work = pieces.join(sets, KEY).repartition("tree", "key", "i", "j")
    work = work.sortWithinPartitions("tree", "key", "i", "j", *KEY)
    found = work.mapInArrow(_verify(similarity), "doc long, fp long, root_doc long, root_fp long, links long")
    found = materialize(found, "links")
    rep, root = F.struct(*KEY), F.struct(F.col("root_doc").alias("doc"), F.col("root_fp").alias("fp"))
    roots = components(found.select(rep.alias("a"), root.alias("b")))
    sums = found.groupBy(*KEY).agg(F.sum("links").alias("links"))
    grouped = classes.select("s1", "s2", rep.alias("v"), *KEY, "size").join(sums, KEY, "left")
    grouped = grouped.join(roots, "v", "left").where("size > 1 OR root IS NOT NULL")
    grouped = grouped.select(
        "s1", "s2", F.coalesce("root", "v").alias("root"),
        (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
    )
    known = filled.select(*KEY, "s1", "s2").join(grouped, ["s1", "s2"]).select(*KEY, "root", "n_links").distinct()
    out = rows.select("doc_id", *KEY).join(known, KEY, "left")
    own = F.struct(*KEY)
    root_id = F.when(F.col("root").isNull() | (F.col("root.doc") == F.col("doc")), F.col("doc_id")).otherwise(F.col("root.doc"))
    return out.select(
        "doc_id", *KEY, root_id.alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("root").isNull() | (F.col("root") == own)).alias("kept"),
    )


def _repeats(signed: DataFrame) -> bool:
    return bool(signed.groupBy(*KEY).count().where("count > 1").limit(1).count())


def drop_similar(docs: DataFrame, n: int = N, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group, with its columns."""
    gone = similar_documents(docs, n, similarity).where("NOT kept").select(*KEY).distinct()
    gone = materialize(gone, "gone")
    keyed = docs.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in doc_key().items()])
    left = keyed.join(gone.hint("shuffle_hash"), KEY, "left_anti")
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
