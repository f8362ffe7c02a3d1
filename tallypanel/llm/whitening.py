"""Whitening of embeddings by a polarisation covariance.

Vectors become whole numbers, and the sums of a first pass centre them without a fraction: with
``n`` vectors of sums ``S``, ``d = n*x - S``. A second pass adds up exact squares: of every
dimension, and of the sum of every two dimensions. As ``(a + b)^2 - a^2 - b^2 = 2ab``, the
differences of those variances are all cross-covariances, without a product of two dimensions
ever being added up. The matrix is assembled from whole numbers, each entry rounded once, and
its eigenvectors are found on the driver: it has a row per dimension, whatever the table's size.
A third pass measures the covariance of the whitened vectors.

Squares are added in two halves of bits, so 64-bit sums stay exact; blocks whose numbers are too
large for that are added as Python's whole numbers. Partial sums are two decimals of 38 digits.

Defined results: rows whose vector is null, empty or holds null or non-finite entries, or entries
too large for a 64-bit ``x``, are left out, as are vectors of another length than the commonest
(of equals the longest); repeated rows count each and null ids are kept. Directions without
variance (below 1e-12 of the largest) are no components, so equal vectors and single ones give no
rows. ``deviation`` is null where it does not fit a long. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallypanel.llm.common import batch_of, prepare

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
FLAT = 1e-12  # of the largest eigenvalue: no variance
BLOCK = 1024  # vectors that are squared at a time
HALF = 24  # bits of the lower half of a centred value
LONG = 2**63 - 1
DECIMAL = pa.decimal128(38, 0)
LOWER = 10**30  # a sum is ``high * LOWER + low``


def whole_vectors(batch: pa.RecordBatch, length: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the batch and their ``x`` as a matrix, once for each length of vectors."""
    column = batch.column("embedding")
    sizes = np.array([-1 if s is None else s for s in column.value_lengths().to_pylist()], np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = np.flatnonzero(sizes > 0)
    begins = np.concatenate([[0], np.cumsum(sizes[rows])[:-1]]) if len(rows) else rows
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(SCALE * values) + SHIFT
    # Null entries came as NaN, which fails this as well.
    fits = np.abs(scaled) < 2.0**62
    for size in np.unique(sizes[rows]):
        if length is not None and size != length:
            continue
        own = sizes[rows] == size
        at = begins[own][:, None] + np.arange(size)
        good = fits[at].all(1)
        if good.any():
            yield rows[own][good], scaled[at[good]].astype(np.int64)


def _rows_of(rows: DataFrame) -> DataFrame:
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def _split(totals) -> tuple[list[Decimal], list[Decimal]]:
    """``high`` and ``low`` of whole numbers of any size."""
    both = [divmod(int(v), LOWER) for v in totals]
    return [Decimal(h) for h, _ in both], [Decimal(v) for _, v in both]


def _added(parts: DataFrame, *keys: str) -> list:
    return parts.groupBy(*keys).agg(F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy(*keys).collect()


def _total(row) -> int:
    return int(row["high"]) * LOWER + int(row["low"])


def sums_by_length(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Of each length of vectors their number and the sums of their dimensions. A row per
    dimension comes to the driver."""
    schema = pa.schema([("size", pa.int64()), ("i", pa.int64()), ("high", DECIMAL), ("low", DECIMAL)])

    def add(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for at, x in whole_vectors(batch):
                have = sums.setdefault(x.shape[1], [0, 0])
                have[0] += len(at)
                have[1] = have[1] + x.astype(object).sum(0) if np.abs(x).max() > 2**40 else have[1] + x.sum(0).astype(object)
        for size, (n, total) in sums.items():
            yield batch_of(schema, [size] * (size + 1), range(-1, size), *_split([n, *total]))

    parts = _rows_of(rows).mapInArrow(add, "size long, i long, high decimal(38,0), low decimal(38,0)")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in _added(parts, "size", "i"):
        if r["i"] < 0:
            out[r["size"]] = (_total(r), [])
        else:
            out[r["size"]][1].append(_total(r))
    return out


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n*x - S``, as 64-bit numbers where all of them are small enough, else Python's."""
    if n * int(np.abs(x).max(initial=1)) < 2**61 and max(map(abs, sums.tolist()), default=0) < 2**61:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def squares(d: np.ndarray) -> np.ndarray:
    """Exact sum of squares of every column, as Python's whole numbers."""
    if d.dtype == object or int(np.abs(d).max(initial=0)) >= 1 << 46:
        return (d.astype(object) ** 2).sum(0)
    high, low = d >> HALF, d & ((1 << HALF) - 1)
    parts = [np.einsum("ij,ij->j", a, b).astype(object) for a, b in ((high, high), (high, low), (low, low))]
    return (parts[0] << 2 * HALF) + (parts[1] << HALF + 1) + parts[2]


def covariance(rows: DataFrame, size: int, n: int, sums: list[int]) -> np.ndarray:
    """The covariance of the vectors, from variances of dimensions and of sums of two."""
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("high", DECIMAL), ("low", DECIMAL)])
    total_of = np.array(sums, object)

    def add(batches):
        # Row i: the squares of i itself, then of i + j for the j after it.
        have = [np.zeros(size - i, object) for i in range(size)]
        seen = False
        for batch in batches:
            for _, x in whole_vectors(batch, size):
                for a in range(0, len(x), BLOCK):
                    d = centred(x[a : a + BLOCK], n, total_of)
                    seen = True
                    for i in range(size):
                        of_sums = d[:, i:] + d[:, i : i + 1]
                        of_sums[:, 0] = d[:, i]
                        have[i] = have[i] + squares(of_sums)
        if seen:
            for i in range(size):
                yield batch_of(schema, [i] * (size - i), range(i, size), *_split(have[i]))

    parts = _rows_of(rows).mapInArrow(add, "i int, j int, high decimal(38,0), low decimal(38,0)")
    variance = {(r["i"], r["j"]): _total(r) for r in _added(parts, "i", "j")}
    out = np.zeros((size, size))
    for (i, j), total in variance.items():
        if i == j:
            out[i, i] = total / n**3
        else:
            # Whole numbers until the one division, which rounds correctly.
            out[i, j] = out[j, i] = (total - variance[i, i] - variance[j, j]) / (2 * n**3)
    return out


@dataclass
class Whitening:
    size: int
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    axes: np.ndarray  # a column per component
    trace: float

    def project(self, d: np.ndarray) -> np.ndarray:
        return (d.astype(np.float64) / self.n) @ self.axes / np.sqrt(self.values)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the vectors of the commonest length; None without variance."""
    prepare(rows.sparkSession)
    by_length = sums_by_length(rows)
    if not by_length:
        return None
    size = max(by_length, key=lambda s: (by_length[s][0], s))
    n, sums = by_length[size]
    matrix = covariance(rows, size, n, sums)
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1], axes[:, ::-1]
    real = values > FLAT * max(values[0], 0.0)
    if not real.any() or values[0] <= 0:
        return None
    most = min(components, int(real.sum()))
    # One sign for all rows: the largest entry of an axis is positive.
    axes = axes[:, :most]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(most)] < 0, -1.0, 1.0)
    return Whitening(size, n, sums, values[:most], axes, float(np.trace(matrix)))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, over all of them.
    Whitened values have mean 0 but for rounding, which the sums take off."""
    k = len(model.values)
    schema = pa.schema([("at", pa.int32()), ("total", pa.float64())])
    total_of = np.array(model.sums, object)

    def add(batches):
        mean, product = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, x in whole_vectors(batch, model.size):
                for a in range(0, len(x), BLOCK):
                    w = model.project(centred(x[a : a + BLOCK], model.n, total_of))
                    mean += w.sum(0)
                    product += w.T @ w
        yield batch_of(schema, range(k + k * k), np.concatenate([mean, product.ravel()]))

    parts = _rows_of(rows).mapInArrow(add, "at int, total double")
    total = np.zeros(k + k * k)
    for r in parts.groupBy("at").agg(F.sum("total").alias("total")).collect():
        total[r["at"]] = r["total"] / model.n
    got = total[k:].reshape(k, k) - np.outer(total[:k], total[:k])
    return float(np.abs(got - np.eye(k)).max())


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row per
    vector and component."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    model = fit(rows, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, {OUT}")
    error = identity_error(rows, model)
    k, total_of = len(model.values), np.array(model.sums, object)
    names = ["vec_id", *[p.split()[0] for p in OUT.split(", ")]]

    def project(batches):
        for batch in batches:
            for at, x in whole_vectors(batch, model.size):
                for a in range(0, len(x), BLOCK):
                    d = centred(x[a : a + BLOCK], model.n, total_of)
                    # 64-bit sums only where they cannot overflow.
                    small = d.dtype != object and model.size * int(np.abs(d).max()) ** 2 <= LONG
                    far = (d * d).sum(1) if small else (d.astype(object) ** 2).sum(1)
                    deviation = [int(v) if v <= LONG else None for v in far]
                    ids = batch.column("vec_id").take(pa.array(np.repeat(at[a : a + BLOCK], k)))
                    m = len(d)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids,
                            pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                            pa.array(np.full(m * k, model.n, np.int64)),
                            pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                            pa.array(model.project(d).ravel()),
                            pa.array(np.tile(model.values / model.trace, m)),
                            pa.array(np.full(m * k, error)),
                        ],
                        names=names,
                    )

    return _rows_of(rows).mapInArrow(project, f"vec_id {kind}, {OUT}")
