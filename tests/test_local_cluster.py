"""Queries that write to scratch, on a cluster of executors that are processes of their own, with
``spark.checkpoint.dir`` a path without a scheme."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as contract
from helpers import spark_home
from oracle import compare, duck

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = [
    "country_job_segmented",
    "csv_roundtrip",
    "csv_text_roundtrip",
    "csv_lookup",
    "json_roundtrip",
    "map_feed_documents",
    "map_feed_lines",
    "ordered_country_table",
    "observed_summary",
    "raw_day_number",
    "raw_forward_fill",
    "raw_deltas",
    "raw_moving_average",
    "replaced_month",
    "raw_repair",
    "run_country_table",
    "run_regional_table",
    "run_history_table",
]
TABLES = {
    "nation": "SELECT i::INT AS n_nationkey, 'NATION_' || i AS n_name, (i % 5)::INT AS n_regionkey FROM range(25) r(i)",
    "customer": """SELECT i AS c_custkey, 'Customer ' || i AS c_name, (i % 25)::INT AS c_nationkey,
  i * 1.5::DOUBLE AS c_acctbal, CASE WHEN i % 7 = 0 THEN 'BUILD, "ING"' ELSE 'AUTO' END AS c_mktsegment FROM range(60) r(i)""",
    "orders": """SELECT i AS o_orderkey, i * 7 % 60 AS o_custkey, ['F', 'O', 'P'][i % 3 + 1] AS o_orderstatus,
  i * 2.25::DOUBLE AS o_totalprice, TIMESTAMP '1996-06-20' + to_days((i * 11 % 60)::INT) AS o_orderdate,
  '1-URGENT' AS o_orderpriority FROM range(400) r(i)""",
    "events": """SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_hours((i * 37 % 700)::INT) AS ts, i * 13 % 11 AS user_id,
  ['view', 'click', 'error', 'purchase'][i * 5 % 4 + 1] AS event_type, (i * 17 % 101) / 4.0::DOUBLE AS value, '{"k": 1}' AS props
FROM range(500) r(i)""",
    "documents": """SELECT i AS doc_id, 'text ' || i || chr(10) || ' of "two" lines, ' AS text, 'en' AS lang, 's' AS source,
  20::BIGINT AS n_chars FROM range(20) r(i)""",
}
CHILD = """
import sys, traceback
from pyspark.sql import SparkSession
import __spark_entry__ as contract
shared, names = sys.argv[1], sys.argv[2:]
conf = {
    "spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "600m", "spark.ui.enabled": "false",
    "spark.driver.host": "127.0.0.1", "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "2",
    "spark.checkpoint.dir": f"{shared}/scratch", "spark.sql.warehouse.dir": f"{shared}/warehouse",
}
spark = SparkSession.builder.config(map=conf).getOrCreate()
for name in names:
    try:
        contract.queries()[name](spark, f"{shared}/tables").write.parquet(f"{shared}/out/{name}")
    except Exception:
        with open(f"{shared}/{name}.failed", "w") as told:
            told.write(traceback.format_exc())
spark.stop()
"""


@pytest.fixture(scope="module")
def cluster(tmp_path_factory):
    """The folder with the tables and, of each query, its result or why it has none."""
    root = tmp_path_factory.mktemp("cluster")
    for folder in ("tables", "out"):
        (root / folder).mkdir()
    con = duckdb.connect()
    for name, sql in TABLES.items():
        con.execute(f"COPY ({sql}) TO '{root}/tables/{name}.parquet' (FORMAT parquet)")
    # The session of the other tests stays as it is: this one has a driver of its own.
    inherited = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "PYSPARK_DRIVER"))}
    env = inherited | {"PYTHONPATH": REPO, "PYSPARK_PYTHON": sys.executable, "SPARK_HOME": spark_home(root), "SPARK_LOCAL_IP": "127.0.0.1"}
    run = subprocess.run([sys.executable, "-c", CHILD, str(root), *NAMES], env=env, cwd=root, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-2000:]
    return root


@pytest.mark.parametrize("name", NAMES)
def test_query_on_a_local_cluster(spark, cluster, name):
    failed = cluster / f"{name}.failed"
    assert not failed.exists(), failed.read_text()
    result = spark.read.parquet(f"{cluster}/out/{name}")
    assert result.count()
    assert compare(duck(f"{cluster}/tables"), contract.oracle_sql()[name], result) is None
