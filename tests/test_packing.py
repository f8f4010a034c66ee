"""Bins of bounded size against a serial first fit decreasing."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from cartlight.operators import balance


def serial(sizes, limit):
    loads, out = [], {}
    for key, size in sorted(sizes, key=lambda r: (-(r[1] or 0), r[0])):
        at = next((i for i, load in enumerate(loads) if load + (size or 0) <= limit), len(loads))
        if at == len(loads):
            loads.append(0)
        loads[at] += size or 0
        out[key] = at
    return out


def expand(found):
    return {(length, i): first + (i - before - 1) // each for length, before, upto, first, each in found for i in range(before + 1, upto + 1)}


@pytest.mark.parametrize("seed", range(40))
def test_counts_equal_a_serial_pass(seed):
    rng = random.Random(seed)
    limit = rng.choice([1, 7, 50, 1000])
    kinds = [rng.randint(0, limit) for _ in range(rng.randint(1, 30))]
    sizes = [(i, rng.choice(kinds)) for i in range(rng.randint(1, 600))]
    lengths, counts = np.unique([s for _, s in sizes], return_counts=True)
    found = expand(balance.first_fit_decreasing(lengths, counts, limit))
    order, seen, got = sorted(sizes), {}, {}
    for key, size in order:
        seen[size] = seen.get(size, 0) + 1
        got[key] = found[size, seen[size]]
    assert got == serial(sizes, limit)


def test_many_rows_of_few_lengths():
    """Counts far beyond what rows could be listed."""
    found = balance.first_fit_decreasing(np.array([30, 20, 10, 7]), np.array([10**12, 10**12, 10**12, 5]), 64)
    last = max(first + -(-(upto - before) // each) for _, before, upto, first, each in found)
    assert len(found) < 30 and last <= 11 / 9 * (6 * 10**13 / 64) + 1


def test_rows(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 0, 5, 9, 9, 9, 9, 31, 64])) for i in rng.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "k long, size int")
    expected = serial(rows, 64)
    got = balance.pack_micro_batches(df, key="k", length="size", max_tokens=64).collect()
    assert {r.k: r.bin for r in got} == expected and {r.bin_count for r in got} == {max(expected.values()) + 1}
    assert balance.pack_micro_batches(df.limit(0), key="k", length="size", max_tokens=64).count() == 0
    for bad in (-1, 65):
        with pytest.raises(PySparkException):
            balance.pack_micro_batches(spark.createDataFrame([(1, bad)], "k long, size int"), key="k", length="size", max_tokens=64).collect()


def test_pieces_grow_with_the_rows(spark, monkeypatch):
    """A task's rows are bounded: more rows give more pieces, and the same bins."""
    sizes = [(i, i % 5 + 1) for i in range(400)]
    df = spark.createDataFrame(sizes, "id long, n long")
    plain = {r.id: r.bin for r in balance.pack_micro_batches(df, key="id", length="n", max_tokens=12).collect()}
    monkeypatch.setattr(balance, "PIECE_ROWS", 10)
    packed = balance.pack_micro_batches(df, key="id", length="n", max_tokens=12)
    assert packed.rdd.getNumPartitions() == 40
    assert {r.id: r.bin for r in packed.collect()} == plain == serial(sizes, 12)
