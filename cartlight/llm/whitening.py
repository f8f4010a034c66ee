"""Whitening of embeddings on principal components of double precision.

The vectors are counted in 1/256 steps, so sums are exact. The covariance of
the distinct vectors is summed by Spark in centred blocks. The driver solves
it in single precision and corrects the eigenvectors by Ogita-Aishima steps,
which need matrix products only, in extended precision. Eigenvalues that a
step cannot tell apart form a cluster, whose small block of the covariance is
solved on its own, at its own scale, before the next step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlight.llm.common import narrow
from cartlight.session import materialize

#: Partial sums of the covariance: so many tasks a core at most, as each sends d * d numbers.
TASKS_PER_CORE = 4
#: Up to so many dimensions the products of the steps use extended precision, above it double.
EXTENDED = 512
#: Eigenvalues below this share of the trace count as zero: their components have no whitened values.
ZERO = 1e-13

SCHEMA = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


# --- eigenvectors -------------------------------------------------------------------------------


def clusters_of(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Indices of eigenvalues that no gap above ``gap`` divides, for groups of two and more."""
    order = np.argsort(values, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(values[order]) > gap) + 1)
    return [g for g in groups if len(g) > 1]


def refined_eigenvectors(matrix: np.ndarray, max_steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues by falling size, unit eigenvectors as columns) of a symmetric matrix, to double precision."""
    d = len(matrix)
    high = np.longdouble if d <= EXTENDED else np.float64
    scale = float(np.abs(matrix).max(initial=0.0))
    if scale == 0:
        return np.zeros(d), np.eye(d)
    a = (matrix / scale).astype(high)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(high)
    norm = float(np.linalg.norm(a.astype(np.float64), 2))
    one, eps = np.eye(d, dtype=high), float(np.finfo(high).eps)
    last = np.inf
    for _ in range(max_steps):
        r = one - x.T @ x
        s = x.T @ a @ x
        r, s = (r + r.T) / 2, (s + s.T) / 2  # rounding must not differ across the diagonal: it is divided by small distances
        values = np.diag(s) / (1 - np.diag(r))
        off = (s - np.diag(values)).astype(np.float64)
        gap = 2 * float(np.linalg.norm(off, 2) + norm * np.linalg.norm(r.astype(np.float64), 2))
        distance = values[None, :] - values[:, None]
        apart = np.abs(distance) > gap
        step = np.where(apart, (s + values[None, :] * r) / np.where(apart, distance, 1), r / 2)
        x = x + x @ step
        size = float(np.abs(step).max())
        groups = clusters_of(values.astype(np.float64), gap)
        coupled = [g for g in groups if np.abs(off[np.ix_(g, g)]).max() > 8 * eps * norm]
        if coupled and size < 1e-5:
            for g in coupled:
                x[:, g] = _solved_cluster(a, x[:, g], values[g].mean())
            last = np.inf
        elif size <= 64 * eps or (size < 1e-14 and size >= last):
            break
        else:
            last = size
    values = np.diag(x.T @ a @ x) / np.diag(x.T @ x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(d)] < 0, -1, 1)  # a sign of its own for each component
    return (values[order] * scale).astype(np.float64), x.astype(np.float64)


def _solved_cluster(a: np.ndarray, x: np.ndarray, middle) -> np.ndarray:
    """The vectors of a cluster turned to the eigenvectors of their own block, which is shifted and scaled to the cluster's width."""
    block = x.T @ (a @ x - middle * x)
    block = (block + block.T) / 2
    width = np.abs(block).max()
    return x if width == 0 else x @ np.linalg.eigh((block / width).astype(np.float64))[1].astype(a.dtype)


# --- distributed sums ---------------------------------------------------------------------------


def _packed(dtype: np.dtype, scale: int):
    """Function of Arrow batches (vec_id, vector): the vectors in steps of 1/scale, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                flat = np.floor(scale * batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(dtype)
                size = flat.nbytes // batch.num_rows
                ends = np.arange(batch.num_rows + 1, dtype=np.int64) * size
                packed = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(flat.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0), packed.cast(pa.binary())], ["vec_id", "x"])

    return run


def _rows(column: pa.Array, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), -1)


def _sums(fit: DataFrame, dtype: np.dtype) -> list[int]:
    """Sum of every dimension, one row each to the driver."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = _rows(batch.column(0), dtype).sum(axis=0, dtype=np.int64)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "total"])

    rows = fit.mapInArrow(run, "i int, total bigint").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    return [int(r["total"]) for r in sorted(rows, key=lambda r: r["i"])]


class Centre:
    """n * x - S, exactly: in 64-bit integers where they suffice, else in Python's."""

    def __init__(self, n: int, sums: list[int], largest: int):
        self.n, self.wide = n, 2 * n * (largest + 1) >= 1 << 62
        self.sums = np.array(sums, dtype=object if self.wide else np.int64)
        self.squares_wide = self.wide or len(sums) * (2 * n * (largest + 1)) ** 2 >= 1 << 62

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.n * x.astype(object if self.wide else np.int64) - self.sums

    def centred(self, moved: np.ndarray) -> np.ndarray:
        return (moved / self.n).astype(np.float64)

    def squares(self, moved: np.ndarray) -> pa.Array:
        out = (moved.astype(object) ** 2 if self.squares_wide else moved**2).sum(axis=1)
        return pa.array([int(v) for v in out]).cast(pa.decimal128(38, 0)) if not self.squares_wide else pa.array([_decimal(v) for v in out], pa.decimal128(38, 0))


def _decimal(value: int):
    from decimal import Decimal

    return Decimal(int(value))


def _covariance(fit: DataFrame, dtype: np.dtype, centre: Centre, d: int) -> np.ndarray:
    """Covariance of the fit list: centred products summed by task, then by Spark; d * d / 2 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                y = centre.centred(centre(_rows(batch.column(0), dtype)))
                total += y.T @ y
        for i in range(d):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i, i:].tolist()], pa.list_(pa.float64()))], ["i", "row"])

    tasks = TASKS_PER_CORE * fit.sparkSession.sparkContext.defaultParallelism
    parts = fit.coalesce(tasks).mapInArrow(run, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "value")).groupBy("i", "j").agg(F.sum("value").alias("value"))
    out = np.zeros((d, d))
    for chunk in cells.toArrow().to_batches():
        i, j, value = (c.to_numpy(zero_copy_only=False) for c in chunk.columns)
        out[i, i + j] = out[i + j, i] = value
    return out / centre.n


# --- operator -----------------------------------------------------------------------------------


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """One row a vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries
    drop out; so do those whose length is not that of most rows (ties: the
    longer). Entries count in steps of 1/``scale``, rounded down; they must
    stay below 2**52 steps, or a ValueError tells so. The fit list is each
    distinct vector once: a repeated or hot vector weighs no more than any
    other. Components are numbered from 1 by falling eigenvalue of the fit
    list's covariance, with the largest entry positive. ``whitened`` is null
    where the eigenvalue is zero (a constant table, fewer vectors than
    components); ``explained`` is null where all are. ``identity_error`` is
    the largest departure of the whitened covariance from the identity over
    the components that are not null. Null ids stay null, repeated ids are
    rows of their own, an empty table gives an empty one.
    """
    spark = df.sparkSession
    rows = narrow(df, vec_id=id_col, vector=vector_col).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & ~bad)
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("vector", F.abs))).alias("largest"))
    first = sizes.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not first:
        return spark.createDataFrame([], SCHEMA)
    d, steps = first[0]["d"], first[0]["largest"] * scale
    if steps >= 2.0**52:
        raise ValueError(f"entries of {steps:.3g} steps are beyond exact counting")
    largest = int(steps) + 1
    dtype = np.dtype("<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8")
    counted = rows.filter(F.size("vector") == d).mapInArrow(_packed(dtype, scale), "vec_id bigint, x binary")
    fit = materialize(counted.select("x").distinct(), "whitening-fit")
    n = fit.count()
    centre = Centre(n, _sums(fit, dtype), largest)
    covariance = _covariance(fit, dtype, centre, d)
    values, vectors = refined_eigenvectors(covariance)
    trace, k = float(np.trace(covariance)), min(components, d)
    kept = [c for c in range(k) if values[c] > ZERO * trace]
    project = vectors[:, kept] / np.sqrt(values[kept])
    error = _identity_error(fit, dtype, centre, project)
    explained = [max(float(values[c]), 0.0) / trace if trace > 0 else None for c in range(k)]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                moved = centre(_rows(part.column(1), dtype))
                white = np.full((len(moved), k), np.nan)
                white[:, kept] = centre.centred(moved) @ project
                m, each = len(moved), np.repeat(np.arange(part.num_rows), k)
                none = np.tile([c not in kept for c in range(k)], m)
                columns = [
                    part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), centre.squares(moved).take(pa.array(each)),
                    pa.array(white.ravel(), mask=none), pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return counted.mapInArrow(run, SCHEMA)


def _identity_error(fit: DataFrame, dtype: np.dtype, centre: Centre, project: np.ndarray) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, centred before multiplying."""
    k = project.shape[1]
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                white = centre.centred(centre(_rows(batch.column(0), dtype))) @ project
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(white[:, c])) for c in range(k)], [f"w{c}" for c in range(k)])

    white = fit.mapInArrow(run, ", ".join(f"w{c} double" for c in range(k)))
    means = white.agg(*(F.avg(f"w{c}") for c in range(k))).first()
    cells = [(a, b) for a in range(k) for b in range(a, k)]
    found = white.agg(*(F.avg((F.col(f"w{a}") - means[a]) * (F.col(f"w{b}") - means[b])) for a, b in cells)).first()
    return max(abs(v - (a == b)) for (a, b), v in zip(cells, found))
