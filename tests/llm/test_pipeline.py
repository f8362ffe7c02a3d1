import os
import re

import corpus_pipeline
import public_tokenizers
from llm_helpers import documents, frame
from pyspark.sql import functions as F

from tallypanel.llm import bpe, queries

TABLES = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line dedup", "n-gram Jaccard join", "mixing", "byte-level BPE"
    ]


def test_run_on_edges(spark, tmp_path):
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2, 1) for i in range(0, 30, 3)]
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "n_tokens", "token_ids"} <= set(got.columns) and "text" not in got.columns
    ids = {r["doc_id"] for r in got.collect()}
    assert ids <= {r[0] for r in documents()}
    texts = bpe.decode_tokens(got, public_tokenizers.path(corpus_pipeline.VOCABULARY)).where(F.col("n_tokens") > 0)
    assert all(r["text"] for r in texts.collect())


def test_empty(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_operators_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"
