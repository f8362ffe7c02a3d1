"""Sharding by jump consistent hashing.

A document's shard follows from its id and the number of shards alone. The key is a hash of
the id as text; it jumps from shard to shard, each jump as far as one appended shard after
another would leave the key where it is, and the last jump inside the shard count is the shard.
So there is no table of the ring, and with one more shard only the documents that the new
shard takes move. Shards hold equal numbers of documents as far as chance allows.

The slot is the place of a document in its shard, in order of id: shards are ranked by
range-partitioned rows and counts per part, so no shard is ever held by one task.

Defined results: null ids share one key of their own, and so one shard; repeated rows and
repeated ids share a shard and get slots of their own; a null text has size 1 and the checksum
of an empty one; an empty table gives no rows. With fewer than one shard the call fails.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallypanel.llm.common import prepare, ranked, text_bytes
from tallypanel.session import materialize

SHARDS = 8
# The multiplier of the generator and the width of what it deals, as published
# with the method.
MULTIPLIER = np.uint64(2862933555777941757)
DEALT = float(1 << 31)


def stable_key(doc_id: str = "doc_id") -> Column:
    """60 bits of the md5 of the id as text; a null id has the key of the text ``null``."""
    text = F.coalesce(F.concat(F.lit("#"), F.col(doc_id).cast("string")), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key: all keys jump at once until each has left the shard count."""
    state = keys.astype(np.uint64)
    shard, ahead = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    while len(going):
        shard[going] = ahead[going]
        state[going] = state[going] * MULTIPLIER + np.uint64(1)
        dealt = DEALT / ((state[going] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[going] = np.floor((shard[going] + 1) * dealt).astype(np.int64)
        going = going[ahead[going] < shards]
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def jumped(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(), shards))

    return jumped(key)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` per row of ``docs``."""
    prepare(docs.sparkSession)
    text = text_bytes()
    facts = docs.select(
        "doc_id",
        (F.length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        stable_key().alias("_key"),
    )
    dealt = facts.withColumns({"shard": shard_of(F.col("_key"), shards), "grown_shard": shard_of(F.col("_key"), shards + 1)})
    order = ["doc_id", "text_crc32", "size"]
    placed = ranked(dealt.drop("_key"), order, ["shard"], "slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """All columns of ``docs`` as Parquet below ``<path>/shard=<n>``, ordered by id inside each
    file. Rows are dealt by range of shard and id, so a shard is written by several tasks."""
    prepare(docs.sparkSession)
    names = [F.col(c) for c in docs.columns if c != "shard"]
    dealt = docs.select(*names, shard_of(stable_key(), shards).alias("shard"))
    order = ["shard", *[c for c in ("doc_id",) if c in docs.columns]]
    sorted_rows = dealt.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows.write.partitionBy("shard").mode("overwrite").parquet(path)


def moved(assigned: DataFrame) -> DataFrame:
    """The rows that one more shard would take, which are all that have to be copied."""
    return assigned.where(F.col("grown_shard") != F.col("shard"))


def shard_sizes(assigned: DataFrame) -> DataFrame:
    """``shard, documents, bytes, given``: what each shard holds and would give away."""
    gone = F.count_if(F.col("grown_shard") != F.col("shard"))
    return materialize(
        assigned.groupBy("shard").agg(F.count("*").alias("documents"), F.sum("size").alias("bytes"), gone.alias("given")),
        "shards",
    )
