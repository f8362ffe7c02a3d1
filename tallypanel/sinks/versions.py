"""Tables that are replaced as a whole, so that readers never meet half of one.

A table is a folder. Each replacement writes its files to a fresh folder below ``data`` and then
publishes it by one small file in ``manifests``, named by the number of the version: the highest
number is the table. A run that fails or is killed before that leaves the former version as it
was; two runs that publish the same number are told apart by the file system, and the later one
fails. The version before stays for its readers until the next replacement.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession
from py4j.protocol import Py4JJavaError

MANIFEST = re.compile(r"(\d{12})\.json")
KEPT = 2


class ReplacedMeanwhile(RuntimeError):
    """Another run published its version first."""


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    kinds: tuple[str, ...]


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    target, files = _file_system(spark, path)
    files.delete(target, True)


def _names(spark: SparkSession, folder: str) -> list[tuple[str, float]]:
    """Names in the folder and when each was changed, in seconds."""
    target, files = _file_system(spark, folder)
    if not files.exists(target):
        return []
    return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in files.listStatus(target)]


def versions(spark: SparkSession, table: str) -> list[Version]:
    """The published versions, the current one first."""
    out = []
    for name in sorted((n for n, _ in _names(spark, f"{table}/manifests") if MANIFEST.fullmatch(n)), reverse=True):
        target, files = _file_system(spark, f"{table}/manifests/{name}")
        stream = files.open(target)
        try:
            told = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        out.append(Version(told["version"], f"{table}/{told['folder']}", tuple(told["kinds"])))
    return out


def current_path(spark: SparkSession, table: str, kind: str) -> str:
    """Where the current version's files of ``kind`` are."""
    found = versions(spark, table)
    if not found:
        raise FileNotFoundError(f"{table} has no published version")
    if kind not in found[0].kinds:
        raise ValueError(f"{table} holds {', '.join(found[0].kinds)}, not {kind}")
    return f"{found[0].folder}/{kind}"


def _publish(spark: SparkSession, table: str, number: int, text: str) -> None:
    """The manifest appears whole under its number, or not at all."""
    jvm = spark.sparkContext._jvm
    draft, files = _file_system(spark, f"{table}/manifests/.draft-{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    stream.write(text.encode())
    stream.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{table}/manifests/{number:012d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        files.makeQualified(draft).toUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    # Without options an existing file is not replaced.
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(final), options)
    except (Py4JJavaError, PySparkException) as failed:
        files.delete(draft, False)
        if files.exists(final):
            raise ReplacedMeanwhile(f"version {number} of {table} exists") from failed
        raise


def replace(
    spark: SparkSession, table: str, writers: Mapping[str, Callable[[str], None]], keep: int = KEPT
) -> Version:
    """Write a new version by ``writers``, a function of a path for each kind of files, and publish
    it once all have ended. Versions older than the last ``keep`` are deleted afterwards."""
    before = versions(spark, table)
    number = before[0].number + 1 if before else 1
    folder = f"data/{number:012d}-{uuid.uuid4().hex}"
    try:
        for kind, write in writers.items():
            write(f"{table}/{folder}/{kind}")
        _publish(spark, table, number, json.dumps({"version": number, "folder": folder, "kinds": list(writers)}))
    except BaseException:
        _delete(spark, f"{table}/{folder}")
        raise
    for old in before[max(0, keep - 1) :]:
        _delete(spark, f"{table}/manifests/{old.number:012d}.json")
        _delete(spark, old.folder)
    return Version(number, f"{table}/{folder}", tuple(writers))


def sweep(spark: SparkSession, table: str, older_than: float = 86_400.0) -> list[str]:
    """Delete what killed runs left: folders of no version and drafts that have not changed for
    ``older_than`` seconds. Returns their names."""
    named = {v.folder.rsplit("/", 1)[-1] for v in versions(spark, table)}
    last = time.time() - older_than
    gone = [f"data/{n}" for n, at in _names(spark, f"{table}/data") if n not in named and at <= last]
    gone += [f"manifests/{n}" for n, at in _names(spark, f"{table}/manifests") if n.startswith(".draft-") and at <= last]
    for name in gone:
        _delete(spark, f"{table}/{name}")
    return gone
