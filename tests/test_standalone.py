"""Queries that write to scratch under a cluster manager, with ``spark.checkpoint.dir`` a path without
a scheme that all executors share. The session of the tests stands for the cluster: it is told
another master."""

import json
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as contract
from helpers import spark_home
from oracle import compare, duck
from test_local_cluster import REPO, TABLES

from tallypanel import session

NAMES = [
    "pipeline",
    "op1_line_dedup",
    "op2_toxicity",
    "op3_lm_scoring",
    "op4_ngram_jaccard_join",
    "op5_embedding_near_dedup",
    "op6_preference_formatting",
    "op8_source_mixing",
    "op9_quality_rules",
    "op11_cross_tokenizer_alignment",
    "op12_sharding",
    "country_job",
    "csv_lookup",
    "country_job_segmented",
    "csv_roundtrip",
    "csv_text_roundtrip",
    "json_roundtrip",
    "map_feed_documents",
    "map_feed_lines",
    "observed_summary",
    "ordered_country_table",
    "raw_day_number",
    "raw_deltas",
    "raw_forward_fill",
    "raw_moving_average",
    "raw_repair",
    "replaced_month",
    "run_country_table",
    "run_regional_table",
    "run_history_table",
    "run_world_table",
]
WORDS = "['ba', 'ke', 'li', 'mo', 'nu', 'ra', 'se', 'ti', 'vo', 'du']"
MORE = {
    "documents": f"""SELECT d AS doc_id, string_agg({WORDS}[(d // 2 * 31 + p * p * 7 + p * (d // 2 % 9)) % 10 + 1]
  || CASE WHEN p % 12 = 0 THEN chr(10) ELSE '' END, ' ' ORDER BY p) || chr(10) || 'Shared line ' || d % 3 AS text,
  ['en', 'de'][d % 2 + 1] AS lang, 's' || d % 3 AS source, 300::BIGINT AS n_chars FROM range(60) r(d), range(1, 90) s(p) GROUP BY d""",
    "labels": "SELECT i AS doc_id, (i % 2)::INT AS quality, (i // 2 % 2)::INT AS toxic FROM range(60) r(i)",
    "embeddings": """SELECT i AS vec_id,
  [((i // 3 * 13 + d * d * 5) % 17 - 8 + i % 3 * 0.05)::FLOAT FOR d IN range(16)] AS embedding, (i % 2)::INT AS label FROM range(60) r(i)""",
    "conversations": """SELECT c AS conv_id, t AS turn, ['user', 'assistant'][t % 2 + 1] AS role,
  'said ' || CASE WHEN t < 2 THEN c % 4 ELSE c END || ' ' || t AS text FROM range(20) r(c), range(6) s(t)""",
}
CHILD = """
import json, sys
from pyspark.sql import SparkSession
from tallypanel import session
shared = sys.argv[1]
conf = {
    "spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "600m", "spark.ui.enabled": "false",
    "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"{shared}/scratch", "spark.sql.warehouse.dir": f"{shared}/warehouse",
    "spark.sql.legacy.setCommandRejectsSparkCoreConfs": "false",
}
spark = SparkSession.builder.config(map=conf).getOrCreate()
spark.conf.set("spark.master", "spark://cluster:7077")
told = {}
for base in (f"{shared}/scratch", "/proc/self/cwd/scratch"):
    spark.conf.set("spark.checkpoint.dir", base)
    told[base] = [session.all_share(spark, base), session.scratch_base(spark)]
with open(f"{shared}/told", "w") as out:
    json.dump(told, out)
spark.stop()
"""


def standing_in(spark, base):
    other = spark.newSession()
    other.conf.set("spark.sql.legacy.setCommandRejectsSparkCoreConfs", "false")
    other.conf.set("spark.master", "spark://cluster:7077")
    other.conf.set(session.SETTING, base)
    return other


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    con = duckdb.connect()
    for name, sql in (TABLES | MORE).items():
        con.execute(f"COPY ({sql}) TO '{root}/{name}.parquet' (FORMAT parquet)")
    return str(root)


@pytest.mark.parametrize("name", NAMES)
def test_query_with_a_plain_scratch_path(spark, tables, tmp_path, name):
    other, since = standing_in(spark, f"{tmp_path}/scratch"), session.mark(spark)
    result = contract.queries()[name](other, tables)
    assert os.listdir(f"{tmp_path}/scratch")
    if sql := contract.oracle_sql().get(name):
        assert compare(duck(tables), sql, result) is None
    else:
        ids = [r["doc_id"] for r in result.select("doc_id").collect()]
        assert ids and (name == "pipeline" or sorted(ids) == list(range(60)))
    session.release(spark, since)
    assert not os.listdir(f"{tmp_path}/scratch")


def test_a_folder_is_tried_before_it_is_taken(tmp_path):
    """Paths below ``/proc/self/cwd`` are another folder for each process, as those of a machine's own disk are."""
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "PYSPARK_DRIVER"))}
    env |= {"PYTHONPATH": REPO, "PYSPARK_PYTHON": sys.executable, "SPARK_HOME": spark_home(tmp_path), "SPARK_LOCAL_IP": "127.0.0.1"}
    run = subprocess.run([sys.executable, "-c", CHILD, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    shared, own = f"{tmp_path}/scratch", "/proc/self/cwd/scratch"
    with open(f"{tmp_path}/told") as told:
        found = json.load(told)
    assert found[shared] == [True, shared]
    assert found[own] == [False, f"file:{tmp_path}/warehouse/tallypanel-scratch"]


def test_a_folder_that_cannot_be_written(spark):
    other = standing_in(spark, "/proc/none/scratch")
    assert not session.all_share(other, "/proc/none/scratch")
