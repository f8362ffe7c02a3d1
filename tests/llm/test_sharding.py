import zlib

import numpy as np
import pytest
from llm_helpers import documents, frame
from pyspark.sql import functions as F

from tallypanel.llm import sharding


def plain_jump(key, shards):
    shard, ahead = -1, 0
    while ahead < shards:
        shard = ahead
        key = (key * 2862933555777941757 + 1) % 2**64
        ahead = int((shard + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return shard


def test_jump_equals_the_loop():
    keys = np.random.default_rng(0).integers(0, 2**60, 2000)
    for shards in (1, 2, 8, 9, 1000):
        assert sharding.jump(keys, shards).tolist() == [plain_jump(int(k), shards) for k in keys]
    assert len(sharding.jump(np.zeros(0, np.int64), 8)) == 0


def test_appended_shards_only_take():
    keys = np.random.default_rng(1).integers(0, 2**60, 20_000)
    before = sharding.jump(keys, 1)
    for shards in range(2, 40):
        after = sharding.jump(keys, shards)
        assert ((after == before) | (after == shards - 1)).all()
        assert abs((after != before).mean() - 1 / shards) < 0.02
        assert np.bincount(after, minlength=shards).max() < 1.3 * len(keys) / shards + 60
        before = after


def test_edges(spark):
    rows = documents()
    got = sharding.assign(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    told = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == told
    by_id = {}
    for r in got:
        assert r["law"] == "key" and 0 <= r["shard"] < 8 and r["grown_shard"] in (r["shard"], 8)
        assert by_id.setdefault(r["doc_id"], r["shard"]) == r["shard"]
    for shard in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    again = sharding.assign(frame(spark, rows).repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_empty_and_bad(spark):
    assert sharding.assign(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(frame(spark, []), 0)


def test_moved_and_sizes(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    assigned = sharding.assign(docs)
    gone = sharding.moved(assigned)
    assert gone.where("grown_shard <> 8").count() == 0 and 300 < gone.count() < 600
    sizes = sharding.shard_sizes(assigned).collect()
    assert sum(r["documents"] for r in sizes) == 4000 and sum(r["bytes"] for r in sizes) == 8000
    assert sum(r["given"] for r in sizes) == gone.count()


def test_written_shards(spark, tmp_path):
    docs = frame(spark).withColumn("shard", F.lit("clash"))
    sharding.write_shards(docs, str(tmp_path / "shards"), 3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == docs.count() and set(back.columns) == set(docs.columns)
    want = {(r["doc_id"], r["shard"]) for r in sharding.assign(docs, 3).collect()}
    assert {(r["doc_id"], r["shard"]) for r in back.collect()} == want
