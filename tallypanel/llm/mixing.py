"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, target / source size. The
expected copies are summed up along the documents of the source, ordered by size, from one
random offset; a document is taken once per whole number that the sum passes in it. So a
source's copies number its target in documents to within one, and, as neighbours have
similar sizes, its words come near the target as well.

Native: DataFrame functions only.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; documents of size 0 may get copies, which take no words; with no words at all every
target is 0; repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallypanel.llm.common import KEY, doc_key, pack_rows, ranked, same, word_count
from tallypanel.session import materialize

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, weight, target`` from rows with ``source, size``.

    A target is ``least(most * size, level * weight)``; the level starts at an even share
    and rises by what the stopped targets leave over, until none is above its limit. Only
    the two sums of each round come to the driver.
    """
    totals = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    order = F.col("source").asc_nulls_last()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    shares = materialize(ranked(totals, [order], out="at").withColumn("weight", weight).drop("at"), "shares")
    limit = F.col("source_size") * most
    everything = shares.agg(F.sum("source_size"), F.sum("weight")).first()
    level, words = 0.0, everything[0] or 0
    left, weight_left = words, everything[1] or 0
    while weight_left and left / weight_left > level:
        level = left / weight_left
        stopped = limit < F.lit(level) * F.col("weight")
        row = shares.agg(F.sum(F.when(stopped, limit)), F.sum(F.when(~stopped, F.col("weight")))).first()
        left, weight_left = words - (row[0] or 0), row[1] or 0
    target = F.least(limit.cast("double"), F.lit(level) * F.col("weight"))
    return shares.withColumn("target", target)


def _offset(seed: int) -> Column:
    """A number in [0, 1) for each source, in steps of 1/65536 so that sums stay exact."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    return F.conv(F.substring(F.md5(name), 1, 4), 16, 10).cast("double") / 65536


def mix(docs: DataFrame, seed: int = 0, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``doc_id, source, doc, fp, size, source_size, weight, target, copies, taken`` per row."""
    columns = {"source": F.col("source"), **doc_key(), "size": word_count()}
    rows = docs.select("doc_id", *[c.alias(k) for k, c in columns.items()])
    rows = materialize(rows, "sizes")
    targets = source_targets(rows, weights, most)
    placed = ranked(rows, ["size", "doc", "fp"], ["source"], "at")
    joined = placed.alias("r").join(targets.alias("t"), same("r", "t", ["source"]), "left")
    joined = joined.select("r.*", "t.source_size", "t.weight", "t.target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    passed = F.floor((F.col("at") + 1) * F.col("rate") + _offset(seed)) - F.floor(
        F.col("at") * F.col("rate") + _offset(seed)
    )
    out = joined.withColumn("rate", rate).withColumn("copies", passed.cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("at", "rate")


def mixed_documents(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The documents of the mix, each as many times as it has copies, with their columns."""
    copies = materialize(mix(docs, seed).groupBy(*KEY).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")), "copies")
    packed = pack_rows(docs, **doc_key())
    if copies.where("rows > 1").limit(1).count():
        # Repeated rows share their copies: one of them is emitted for all.
        packed = packed.dropDuplicates(KEY)
    taken = copies.where("copies > 0").drop("rows").hint("shuffle_hash")
    joined = packed.join(taken, KEY).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return joined.select(*[F.col("row")[c].alias(c) for c in docs.columns])
