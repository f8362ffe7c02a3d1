"""What the text operators share.

Words are runs of characters other than space and ``\\x09-\\x0D``. On UTF-8 bytes that is
exactly ``bytes.split()``, and ``bytes.lower()`` lower-cases exactly A-Z, so the Python
code works on bytes. A row of documents is known by ``doc`` (its id, 0 if null) and
``fp`` (a fingerprint of the text and of whether the id is null): rows equal in both are
one document, and each of them gets its result.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallypanel.operators.order import ranked, same  # noqa: F401  (used by the operators here)

WORD = r"[^\x20\x09-\x0D]+"
KEY = ["doc", "fp"]


# What an operator keeps in a worker process from task to task, by the operator's name. Workers are
# used again by later stages, so the next operator lets go what others have left.
_HELD: dict[str, dict] = {}


def held(operator: str) -> dict:
    """The operator's own store in this worker process; those of all others are emptied, and the
    memory they had goes back to the machine."""
    others = [store for name, store in _HELD.items() if name != operator and store]
    for store in others:
        store.clear()
    if others:
        give_back()
    return _HELD.setdefault(operator, {})


def give_back() -> None:
    """Free memory that Python no longer uses, where the C library can."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it. On a cluster
    without that folder it is installed on the machines or sent by ``--py-files``."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit("").cast("binary"))


def doc_key(doc_id: str = "doc_id", text: str = "text") -> dict[str, Column]:
    return {
        "doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(0).cast("long")),
        "fp": F.xxhash64(F.isnull(doc_id), F.col(text)),
    }


def held_out(modulus: int, doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2; a null id counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus == 2


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def pack_rows(df: DataFrame, **keys: Column) -> DataFrame:
    """All columns as one struct ``row`` beside the named ones, so names cannot clash."""
    return df.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in keys.items()])


def with_text(df: DataFrame, columns: Sequence[str], text: str = "text") -> DataFrame:
    """Unpack ``row`` with its text replaced by ``new_text``; ``n_chars`` follows it."""
    out = []
    for name in columns:
        if name == text:
            out.append(F.col("new_text").alias(name))
        elif name == "n_chars":
            out.append(F.length("new_text").cast("long").alias(name))
        else:
            out.append(F.col("row")[name].alias(name))
    return df.select(*out)


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of ``column`` (characters, if it is text); a longer
    value stays whole. No value is read for it."""
    values = batch.column(column)
    length = pc.utf8_length if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else pc.binary_length
    size = length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(size):
        return
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(size)]):
        yield batch.slice(a, b - a)


def batch_of(schema: pa.Schema, *columns: Iterable) -> pa.RecordBatch:
    arrays = [pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
