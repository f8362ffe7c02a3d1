"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
# Local mode only: the folder used while the setting is unset, by application.
_LOCAL: dict[str, str] = {}
# Clusters only: the folder that was tried and found to be shared, by application and setting.
_SHARED: dict[tuple[str, str | None], str] = {}
# Scratch paths that are not yet released, by application.
_PATHS: dict[str, list[str]] = {}


def build_session(
    app: str = "tallypanel", cpus: int | str = "*", extra: Mapping[str, str] | None = None
) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    partitions = "8" if cpus == "*" else str(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config(map=dict(extra or {}))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def all_share(spark: SparkSession, base: str) -> bool:
    """Whether the driver and the executors see each other's files in the folder: some small tasks
    for each core write a file each, and as many others must find all of them."""
    path = f"{base}/tried-{uuid.uuid4().hex}"
    tasks = 3 * max(2, spark.sparkContext.defaultParallelism)
    try:
        spark.range(0, tasks, 1, tasks).write.parquet(path)
        return spark.read.schema("id long").parquet(path).agg(F.count("id")).first()[0] == tasks
    except (Py4JJavaError, PySparkException):
        return False
    finally:
        _delete(spark, path)


def scratch_base(spark: SparkSession) -> str:
    """The folder for data between jobs: the one ``spark.checkpoint.dir`` names.

    Executors on other machines must see it. A path without a scheme can be a shared
    mount or a folder of each machine where the cluster's default file system is the
    machine's own, so there it is tried once (``all_share``). On YARN it is refused, as
    such a default means that Hadoop's settings are missing. What has a scheme is taken
    as it is. A local cluster's executors run on this machine, so there any path counts.
    While the setting is unset or does not serve, the warehouse does if it is shared, as
    Spark has its tables there. In local mode a temporary folder serves while the setting
    is unset.
    """
    base = spark.conf.get(SETTING, None)
    master = spark.conf.get("spark.master", "")
    app = spark.sparkContext.applicationId
    if master == "local" or master.startswith("local["):
        if not base and app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="tallypanel-")
        return base.rstrip("/") if base else _LOCAL[app]
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    plain = base and "://" not in base and not base.startswith("file:") and default.startswith("file:")
    if base and (not plain or master.startswith("local-cluster[")):
        return base.rstrip("/")
    if (app, base) in _SHARED:
        return _SHARED[app, base]
    tried = [base.rstrip("/")] if base and not master.startswith("yarn") else []
    if warehouse := spark.conf.get("spark.sql.warehouse.dir", None):
        tried.append(f"{warehouse.rstrip('/')}/tallypanel-scratch")
    for folder in tried:
        if all_share(spark, folder):
            return _SHARED.setdefault((app, base), folder)
    if not base:
        raise ValueError(f"set {SETTING} to a folder all executors share")
    raise ValueError(f"{SETTING}={base} is a folder of each machine; name a shared one")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the scratch folder; ``release`` deletes it."""
    path = f"{scratch_base(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to shared scratch and read it back, which fixes its
    content and cuts the lineage for good, also when executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark(spark: SparkSession) -> int:
    """How many scratch paths there are now; ``release`` can spare them."""
    return len(_PATHS.get(spark.sparkContext.applicationId, ()))


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the scratch written after ``mark`` gave ``since``; DataFrames that read it
    are of no use afterwards."""
    paths = _PATHS.get(spark.sparkContext.applicationId, [])
    for path in paths[since:]:
        _delete(spark, path)
    del paths[since:]
    if not since and (folder := _LOCAL.pop(spark.sparkContext.applicationId, None)):
        shutil.rmtree(folder, ignore_errors=True)
