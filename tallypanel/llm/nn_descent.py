"""Near-duplicate embeddings by NN-descent.

Every vector keeps a list of its nearest vectors with the same label. Lists start from
neighbours in the order of random sign projections, whose codes are long enough to sort labels of
any size. Fresh projections are added until such a set, which meets a pair by chance alone whether
it is known or not, finds next to no unknown link of a list with room: so links that lead nowhere
else, which no neighbour's neighbour shows, are found as well. Lists are then refined through
neighbours of neighbours: at each vector, the members of its list and those that list it are
compared with each other, and closer ones enter the lists. Rounds end when one adds no pair above
the threshold to a list with room and changes few entries. A list whose every entry is above the threshold is saturated
and hides further links: its component is then compared as a whole, in blocks, which is exact,
together with saturated components near enough to share a link (found by the same descent over
their pivots). An audit compares sampled vectors with all rows and takes the mean of the recalls
of those with links, apart for saturated and other ones, so that a large group does not hide what
others miss; below the target more projections are taken, the lists are lengthened and the descent
goes on. Edges below the threshold are dropped.

Cosines are computed in double precision.

Defined results: vectors that are null, empty, zero or hold null or non-finite components,
and those with a null label, link with nothing; vectors of different length never link; rows
equal in id, label and vector are one vector; a null id counts as the smallest; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallypanel.llm.common import batch_of, prepare, ranked
from tallypanel.llm.components import components, forest
from tallypanel.session import materialize

THRESHOLD = 0.93
LIST = 8
TABLES, BITS = 6, 60
RUN = 64  # neighbours in projected order that are compared at the start
FRESH = 0.002  # share of unknown links among those of fresh projections that ends them
CHANGED = 0.1  # share of changed entries in lists with room that ends the descent
BLOCK = 512
AUDIT = 2048  # vectors whose recall is measured
TARGET = 0.99

_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float64())])
EDGE_TYPES = "u long, v long, sim double"


def unit(vectors: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), dtype).reshape(len(vectors), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _streamed(batches, same, most: int | None, solve):
    """Runs ``solve`` on each run of rows equal in the columns ``same``, cut at ``most``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for c in same:
            v = batch.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
            if held:
                new[0] |= held[-1].column(c)[-1].as_py() != v[0]
        at = 0
        for cut in [*np.flatnonzero(new).tolist(), batch.num_rows]:
            while cut > at:
                take = cut - at if most is None else min(cut - at, most - size)
                held.append(batch.slice(at, take))
                size, at = size + take, at + take
                if most is not None and size == most:
                    yield from solve(pa.Table.from_batches(held))
                    held, size = [], 0
            if cut < batch.num_rows and held:
                yield from solve(pa.Table.from_batches(held))
                held, size = [], 0
    if held:
        yield from solve(pa.Table.from_batches(held))


def vectors(rows: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """All rows as ``vec_id, key, fp``; the vectors that may link as ``u, grp, vec``, with ``u``
    in the order of ids, and ``key, fp`` of each; and the type of the components."""
    dtype = "<f4" if "float" in rows.schema["embedding"].dataType.simpleString() else "<f8"
    key = F.coalesce(F.col("vec_id").cast("long"), F.lit(-(2**63)).cast("long"))
    keyed = rows.select(
        "vec_id", key.alias("key"), F.xxhash64(F.isnull("vec_id"), "label", "embedding").alias("fp"),
        "label", "embedding",
    )
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("grp", pa.int64()), ("vec", pa.binary())])

    def check(batches):
        for b in batches:
            out = [[], [], [], []]
            for k, f, g, v in zip(*(b.column(i).to_pylist() for i in range(4))):
                if v is None or g is None or not v or None in v:
                    continue
                x = np.array(v, dtype)
                norm = np.linalg.norm(x.astype(np.float64))
                if np.isfinite(norm) and norm > 0:
                    for column, value in zip(out, (k, f, g, x.tobytes())):
                        column.append(value)
            yield batch_of(schema, *out)

    grp = F.when(F.col("label").isNotNull(), F.xxhash64(F.col("label").cast("string"), F.size("embedding")))
    good = keyed.select("key", "fp", grp.alias("grp"), "embedding")
    good = good.mapInArrow(check, "key long, fp long, grp long, vec binary").dropDuplicates(["key", "fp"])
    good = materialize(ranked(good, ["key", "fp"], out="u"), "vectors")
    return keyed.select("vec_id", "key", "fp"), good, dtype


def _best(u: np.ndarray, sims: np.ndarray, allowed: np.ndarray, size: int):
    """The ``size`` nearest allowed columns of each row, as edges."""
    sims = np.where(allowed, sims, -2.0)
    size = min(size, len(u) - 1)
    if size < 1:
        return
    near = np.argpartition(-sims, size - 1, axis=1)[:, :size]
    s = np.take_along_axis(sims, near, 1)
    keep = s > -2
    rows = np.repeat(np.arange(len(u)), size).reshape(s.shape)
    yield batch_of(_EDGES, u[rows[keep]], u[near[keep]], s[keep])


def _first_lists(good: DataFrame, dtype: str, size: int, seed: int) -> DataFrame:
    def keys(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            lists = b.column("vec").to_pylist()
            bits = np.zeros((len(lists), TABLES), np.int64)
            for i, raw in enumerate(lists):
                x = np.frombuffer(raw, dtype).astype(np.float64)
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng(seed).normal(size=(TABLES * BITS, len(x)))
                signs = (planes[len(x)] @ x > 0).reshape(TABLES, BITS)
                bits[i] = signs @ (np.int64(1) << np.arange(BITS))
            for t in range(TABLES):
                n = len(lists)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, t, np.int64)), b.column("grp"), pa.array(bits[:, t]), b.column("u"), b.column("vec")],
                    names=["t", "grp", "bits", "u", "vec"],
                )

    def compare(rows: pa.Table):
        u = rows.column("u").to_numpy()
        x = unit(rows.column("vec").to_pylist(), dtype)
        yield from _best(u, x @ x.T, ~np.eye(len(u), dtype=bool), size)

    spread = good.select("u", "grp", "vec").mapInArrow(keys, "t long, grp long, bits long, u long, vec binary")
    order = ["t", "grp", "bits", "u"]
    dealt = spread.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(lambda it: _streamed(it, ["t", "grp"], RUN, compare), EDGE_TYPES)


def _nearest(edges: DataFrame, size: int) -> DataFrame:
    ranks = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    distinct = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    return distinct.withColumn("n", ranks).where(F.col("n") <= size).drop("n")


def _refine(lists: DataFrame, good: DataFrame, dtype: str, size: int) -> DataFrame:
    """One round: new lists with a flag for entries that were not there before."""
    ends = lists.groupBy("u").agg(F.count("*").alias("have"), F.min("sim").alias("least"))
    back = _nearest(lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"), size)
    itself = good.select(F.col("u").alias("c"), "u")
    met = lists.select(F.col("u").alias("c"), F.col("v").alias("u"))
    met = met.unionByName(back.select(F.col("u").alias("c"), F.col("v").alias("u"))).unionByName(itself).distinct()
    facts = good.select("u", "vec").join(ends, "u", "left")
    work = met.join(facts, "u").repartition("c").sortWithinPartitions("c", "u")

    def compare(rows: pa.Table):
        u = rows.column("u").to_numpy()
        if len(u) < 3:
            return
        x = unit(rows.column("vec").to_pylist(), dtype)
        have = np.array([h or 0 for h in rows.column("have").to_pylist()])
        least = np.array([-2.0 if v is None else v for v in rows.column("least").to_pylist()])
        sims = x @ x.T
        # Only what can enter a list.
        allowed = (sims > np.where(have < size, -2.0, least)[:, None]) & ~np.eye(len(u), dtype=bool)
        yield from _best(u, sims, allowed, size)

    found = work.select("c", "u", "vec", "have", "least").mapInArrow(
        lambda it: _streamed(it, ["c"], None, compare), EDGE_TYPES
    )
    old = lists.select(*_EDGES.names, F.lit(1).alias("old"))
    both = old.unionByName(found.withColumn("old", F.lit(0)))
    merged = both.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("old").alias("old"))
    ranks = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return merged.withColumn("n", ranks).where(F.col("n") <= size).drop("n")


def first_lists(good: DataFrame, dtype: str, size: int, threshold: float, seed: int, lists: DataFrame | None = None) -> DataFrame:
    """Lists from projections (and from ``lists``). Sets of fresh ones follow each other until one
    tells almost nothing new of the links of lists with room, which hold all links known."""
    if lists is None:
        lists = materialize(_nearest(_first_lists(good, dtype, size, seed), size), "lists")
    while True:
        seed += 100
        fresh = _first_lists(good, dtype, size, seed)
        both = lists.select(*_EDGES.names, F.lit(1).alias("old"), F.lit(0).alias("met")).unionByName(
            fresh.select(*_EDGES.names, F.lit(0).alias("old"), F.lit(1).alias("met"))
        )
        merged = both.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("old").alias("old"), F.max("met").alias("met"))
        ranks = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
        merged = materialize(merged.withColumn("n", ranks).where(F.col("n") <= size).drop("n"), "lists")
        strong = merged.where(F.col("sim") >= threshold)
        by_list = strong.groupBy("u").agg(F.count("*").alias("n"), F.sum("met").alias("met"), F.sum(1 - F.col("old")).alias("new"))
        met, new = by_list.where(F.col("n") < size).agg(F.sum("met"), F.sum("new")).first()
        lists = merged.drop("old", "met")
        if (new or 0) <= FRESH * (met or 0):
            return lists


def descend(lists: DataFrame, good: DataFrame, dtype: str, size: int, threshold: float) -> DataFrame:
    while True:
        lists = materialize(_refine(lists, good, dtype, size), "lists")
        # Saturated lists are completed in blocks later, so what they gain does not count.
        strong = F.col("sim") >= threshold
        by_list = lists.groupBy("u").agg(
            F.count_if(strong).alias("strong"), F.count_if(strong & (F.col("old") == 0)).alias("gained"),
            F.count("*").alias("entries"), F.count_if(F.col("old") == 0).alias("changed"),
        ).where(F.col("strong") < size)
        gained, entries, changed = by_list.agg(F.sum("gained"), F.sum("entries"), F.sum("changed")).first()
        lists = lists.drop("old")
        if not gained and (changed or 0) <= CHANGED * (entries or 0):
            return lists


def _within(groups: DataFrame, good: DataFrame, dtype: str, threshold: float) -> DataFrame:
    """``u, root, links`` of all pairs inside each group ``u, g``, block against block."""
    counts = groups.groupBy("g").agg(F.count("*").alias("m"))
    placed = groups.join(counts, "g").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("u"), "blocks"))
    pieces = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pieces = pieces.select(
        "g", "u", "block", F.least("block", "other").cast("long").alias("i"), F.greatest("block", "other").cast("long").alias("j")
    )
    work = pieces.join(good.select("u", "vec"), "u").repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "u")
    schema = pa.schema([("u", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def compare(rows: pa.Table):
        u, block = rows.column("u").to_numpy(), rows.column("block").to_numpy()
        x = unit(rows.column("vec").to_pylist(), dtype)
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        if rows.column("i")[0].as_py() != rows.column("j")[0].as_py():
            linked &= block[:, None] != block[None]
        some = np.flatnonzero(linked.any(1))
        if len(some):
            yield batch_of(schema, u[some], u[forest(linked)[some]], linked[some].sum(1))

    rows = work.select("g", "i", "j", "block", "u", "vec")
    return rows.mapInArrow(lambda it: _streamed(it, ["g", "i", "j"], None, compare), "u long, root long, links long")


def _angle(cosine: float) -> float:
    return float(np.arccos(np.clip(cosine, -1, 1)))


def _near_groups(full: DataFrame, good: DataFrame, dtype: str, threshold: float, size: int, seed: int) -> DataFrame:
    """Pairs ``a, b`` of roots of saturated components that may share a link: their pivots
    are no further apart than a link and both radii allow."""
    at_root = good.select(F.col("u").alias("root"), F.col("vec").alias("pivot"), "grp")
    spread = full.join(good.select("u", "vec"), "u").join(at_root, "root")

    @F.pandas_udf("double")
    def cosine(a, b):
        return _rowwise(a, b, dtype)

    radii = spread.select("root", cosine("vec", "pivot").alias("s")).groupBy("root").agg(F.min("s").alias("s"))
    radii = materialize(radii.withColumn("r", F.acos(F.least(F.greatest("s", F.lit(-1.0)), F.lit(1.0)))), "radii")
    widest = radii.agg(F.max("r")).first()[0]
    pivots = radii.select(F.col("root").alias("u")).join(good, "u").select("u", "grp", "vec")
    pivots = materialize(pivots, "pivots")
    reach = float(np.cos(min(np.pi, _angle(threshold) + 2 * widest + 1e-9)))
    near = neighbour_links(pivots, dtype, reach, size, seed + 1)
    return near.select("a", "b")


def _rowwise(a, b, dtype: str):
    import pandas as pd

    out = [float(unit([x], dtype)[0] @ unit([y], dtype)[0]) for x, y in zip(a, b)]
    return pd.Series(out, dtype="float64")


def neighbour_links(good: DataFrame, dtype: str, threshold: float, size: int = LIST, seed: int = 3) -> DataFrame:
    """Edges ``a, b`` that connect what is linked: each link, or a path of links inside a
    saturated component; with ``links``, the links each edge's end ``a`` gains by it."""
    lists = first_lists(good, dtype, size, threshold, seed)
    while True:
        lists = descend(lists, good, dtype, size, threshold)
        strong = materialize(lists.where(F.col("sim") >= threshold), "strong")
        pairs = strong.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        sat = strong.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= size).select("u")
        sat = materialize(sat, "saturated")
        if sat.limit(1).count():
            roots = components(pairs)
            of = roots.select(F.col("v").alias("u"), "root")
            full_roots = of.join(sat, "u", "left_semi").select("root").distinct()
            full = materialize(of.join(full_roots, "root").select("u", "root"), "full")
            near = _near_groups(full, good, dtype, threshold, size, seed) if full_roots.count() > 1 else None
            groups = full.withColumnRenamed("root", "g")
            if near is not None and near.limit(1).count():
                merged = components(near).select(F.col("v").alias("g"), F.col("root").alias("top"))
                groups = groups.join(merged, "g", "left").select("u", F.coalesce("top", "g").alias("g"))
            groups = materialize(groups, "groups")
            inside = materialize(_within(groups, good, dtype, threshold), "inside")
            covered = groups.select(F.col("u").alias("a"))
            rest = pairs.join(covered, "a", "left_anti")
            whole = inside.groupBy("u").agg(F.min("root").alias("b"), F.sum("links").alias("links"))
            whole = whole.select(F.col("u").alias("a"), "b", "links")
            more = inside.select(F.col("u").alias("a"), F.col("root").alias("b"), F.lit(0).cast("long").alias("links"))
            both = _both_ways(rest).unionByName(whole).unionByName(more)
        else:
            both = _both_ways(pairs)
        both = materialize(both, "found")
        if min(recalls(both, sat, good, dtype, threshold)) >= TARGET:
            return both
        size *= 2
        # Longer lists start from what is known and from new projections.
        seed += 10_000
        lists = first_lists(good, dtype, size, threshold, seed, lists)


def _both_ways(pairs: DataFrame) -> DataFrame:
    one = F.lit(1).cast("long").alias("links")
    return pairs.select("a", "b", one).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), one))


def recalls(found: DataFrame, saturated: DataFrame, good: DataFrame, dtype: str, threshold: float) -> tuple[float, float]:
    """Mean share of its links that were found of each sampled vector with links: of vectors
    whose lists have room, and of the others. ``AUDIT`` vectors are compared with all rows."""
    sample = good.orderBy(F.xxhash64("u"), "u").limit(AUDIT).select("u", "grp", "vec").collect()
    if not sample:
        return 1.0, 1.0
    spark = good.sparkSession
    shared = spark.sparkContext.broadcast([(r["u"], r["grp"], bytes(r["vec"])) for r in sample])
    schema = pa.schema([("u", pa.int64()), ("n", pa.int64())])

    def count(batches):
        by_grp: dict[int, list] = {}
        for u, g, vec in shared.value:
            by_grp.setdefault(g, []).append((u, vec))
        ready = {g: (np.array([u for u, _ in own]), unit([v for _, v in own], dtype)) for g, own in by_grp.items()}
        totals = {u: 0 for u, _, _ in shared.value}
        for b in batches:
            grp, us = b.column("grp").to_numpy(), b.column("u").to_numpy()
            vecs = b.column("vec").to_pylist()
            for g, (su, sx) in ready.items():
                at = np.flatnonzero(grp == g)
                for a in range(0, len(at), 4096):
                    part = at[a : a + 4096]
                    hit = sx @ unit([vecs[i] for i in part], dtype).T >= threshold
                    hit &= su[:, None] != us[part][None]
                    for u, n in zip(su.tolist(), hit.sum(1).tolist()):
                        totals[u] += n
        yield batch_of(schema, list(totals), list(totals.values()))

    true = good.select("u", "grp", "vec").mapInArrow(count, "u long, n long").groupBy("u").agg(F.sum("n").alias("n"))
    mine = found.groupBy(F.col("a").alias("u")).agg(F.sum("links").alias("links"))
    full = saturated.select("u", F.lit(True).alias("full"))
    share = F.least(F.lit(1.0), F.coalesce("links", F.lit(0)) / F.col("n"))
    by_kind = true.where("n > 0").join(mine, "u", "left").join(full, "u", "left")
    means = {r["full"]: r["share"] for r in by_kind.groupBy(F.col("full").isNotNull().alias("full")).agg(F.avg(share).alias("share")).collect()}
    return means.get(False, 1.0), means.get(True, 1.0)


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row with ``vec_id, embedding, label``."""
    prepare(rows.sparkSession)
    keyed, good, dtype = vectors(rows)
    links = neighbour_links(good.select("u", "grp", "vec"), dtype, threshold)
    roots = components(links)
    counts = links.groupBy("a").agg(F.sum("links").alias("n_links"))
    names = good.select(F.col("u").alias("root"), F.col("key").alias("root_key"))
    known = good.select("u", "key", "fp").join(counts, F.col("a") == F.col("u"))
    known = known.join(roots, F.col("v") == F.col("u")).join(names, "root")
    known = known.select("key", "fp", "n_links", "root_key")
    out = keyed.join(known, ["key", "fp"], "left")
    root_id = F.when(F.col("root_key") != -(2**63), F.col("root_key"))
    alone = F.col("n_links").isNull()
    component = F.when(alone, F.col("vec_id").cast("long")).otherwise(root_id)
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
