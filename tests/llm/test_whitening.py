"""Whitening against plain numpy, eigenvectors against residuals in extended precision."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlight.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def spread(values, seed=1):
    """Symmetric matrix with these eigenvalues."""
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0].astype(np.longdouble)
    for _ in range(3):  # orthonormal to extended precision
        q = q + q @ (np.eye(len(values), dtype=np.longdouble) - q.T @ q) / 2
    m = (q * np.array(values, dtype=np.longdouble)) @ q.T
    return ((m + m.T) / 2).astype(np.float64)


@pytest.mark.parametrize(
    "values",
    [
        [9, 7, 5, 3, 1],
        [*range(1, 65)],
        [5, 5 + 1e-6, 5 + 3e-6, 2, 2 + 1e-9, 1, 0.5],
        [4, 4, 4, 1, 1, 0, 0],
        [1e12, 1e12 + 1, 1, 1e-3],
        [3 * 1e-8 * k + 1 for k in range(20)] + [50, 60],
        [0, 0, 0],
        [7],
    ],
)
def test_eigenvectors(values):
    a = spread(values)
    found, x = whitening.refined_eigenvectors(a)
    size = np.abs(a).max() or 1
    wide, y = a.astype(np.longdouble), x.astype(np.longdouble)
    assert np.allclose(found, sorted(values, reverse=True), rtol=0, atol=4e-15 * len(values) * size)
    assert np.abs(wide @ y - y * found).max() <= 4e-15 * size
    assert np.abs(y.T @ y - np.eye(len(values))).max() <= 2e-15


def test_close_eigenvalues_have_right_vectors():
    """A float32 solver mixes vectors whose eigenvalues differ by 1e-7; a double one errs by 1e-16 / 1e-7."""
    q = spread([3, 2, 1], 4)
    x = np.linalg.eigh(q)[1][:, ::-1].astype(np.longdouble)
    for _ in range(4):
        x = x + x @ (np.eye(3, dtype=np.longdouble) - x.T @ x) / 2
    a = (x * np.array([1 + 2.0**-22, 1, 0.25], dtype=np.longdouble)) @ x.T
    _, found = whitening.refined_eigenvectors(a.astype(np.float64))
    rough = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1]
    away = lambda v: max(min(np.abs(v[:, c] - x[:, c]).max(), np.abs(v[:, c] + x[:, c]).max()) for c in range(3))
    assert away(found) < 1e-8 and (away(rough) > 1e-3 or away(rough) > 1e4 * away(found))


def plain(rows):
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[c - t / n for c, t in zip(x, s)] for x in fit])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    return good, n, s, e[::-1], u[:, ::-1], np.trace(v)


def check(rows, got, count=4):
    good, n, s, e, u, trace = plain(rows)
    k = min(count, len(e))
    assert len(got) == k * len(good)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {}).setdefault(r.component, r)
    signs = {}
    for i, x in good:
        for c in range(k):
            r = by_id[i][c + 1]
            assert (r.n, int(r.deviation)) == (n, sum((n * a - t) ** 2 for a, t in zip(x, s)))
            assert abs(r.explained - e[c] / trace) <= 1e-9 and r.identity_error <= 1e-9
            expected = float((np.array(x) - np.array(s) / n) @ u[:, c] / math.sqrt(e[c]))
            if abs(expected) > 0.1:
                signs.setdefault(c, set()).add(math.copysign(1, expected * r.whitened))
            assert abs(abs(r.whitened) - abs(expected)) < 1e-8
    assert all(len(v) == 1 for v in signs.values())


def frame(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return df.withColumn("n", F.lit("x")).withColumn("COMPONENT", F.lit(0)).withColumn("x", F.lit(None).cast("int"))


def some_rows(d=6, n=200, seed=2):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d))
    vectors = np.round(rng.normal(size=(n, d)) @ mix + 3, 3).astype(np.float32).astype(float).tolist()
    return [(i, v) for i, v in enumerate(vectors)]


def test_against_numpy(spark):
    """Repeated vectors count once, bad ones not at all; extra columns clash."""
    rows = some_rows() + [(1000 + i, some_rows()[0][1]) for i in range(400)]
    bad = [(-1, None), (-2, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (-3, [float("nan")] * 6), (-4, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (-5, [])]
    mixed = rows + bad
    got = whitening.whiten(frame(spark, mixed + [(-6, [1.0])]).repartition(5)).collect()
    check(mixed, got)
    assert not {r.vec_id for r in got} & {-1, -2, -3, -4, -5, -6}


def test_null_and_repeated_ids(spark):
    rows = some_rows(n=30)
    got = whitening.whiten(frame(spark, rows + [(None, rows[3][1]), (None, rows[4][1]), (5, rows[6][1])])).collect()
    assert len(got) == 4 * 33 and sum(r.vec_id is None for r in got) == 8 and sum(r.vec_id == 5 for r in got) == 8


def test_few_dimensions_and_degenerate_tables(spark):
    check(rows := some_rows(d=2), whitening.whiten(frame(spark, rows)).collect())
    assert whitening.whiten(frame(spark, [])).count() == 0 and whitening.whiten(frame(spark, [(1, None)])).count() == 0
    [a, b] = whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).collect()
    assert (a.n, a.deviation, a.whitened, a.explained, a.identity_error, b.component) == (1, 0, None, None, None, 2)
    line = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in line) and abs(line[0].identity_error) < 1e-12


def test_large_entries_are_exact(spark):
    rows = [(i, [1e9 * i + 0.25 * j for j in range(5)]) for i in range(7)] + [(9, [-3e12, 1.0, 2.0, 3.0, 4.5])]
    good, n, s, *_ = plain(rows)
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(frame(spark, rows, "double")).filter("component = 1").collect()}
    assert got == {i: sum((n * a - t) ** 2 for a, t in zip(x, s)) for i, x in good}
    with pytest.raises(ValueError):
        whitening.whiten(frame(spark, [(1, [1e300])], "double"))


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    df = queries.op13_embedding_whitening(spark, SF)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    check(rows, df.collect())
