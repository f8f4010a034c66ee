"""Nearest matching by proposals against a serial pass."""

import hashlib
import random

import pytest

from cartlight.operators import matching, splits

NAMES = ["kind", "place", "count"]
DISTANCE = [("kind", "equal"), ("count", "number"), ("place", "equal")]
SCHEMA = "query_id long, kind string, place string, count long"


def digest(text):
    return hashlib.md5(text.encode()).hexdigest()


def serial(wanted, candidates, seed="0"):
    """Every key in order takes the best unused candidate."""
    left, out = list(candidates), {}
    for w in sorted(wanted):
        def far(c):
            gap = 0 if w[3] is None and c[3] is None else float("inf") if None in (w[3], c[3]) else abs(w[3] - c[3])
            name = "|".join("~" if v is None else str(v) for v in c[1:])
            return (w[1] != c[1] or w[2] != c[2], w[1] != c[1], gap, w[2] != c[2], digest(f"{seed}:class:{name}"), digest(f"{seed}:candidate:{c[0]}"))

        best = min(left, key=far, default=None)
        out[w[0]] = (None, None) if best is None else (best[0], not far(best)[0])
        if best is not None:
            left.remove(best)
    return out


def match(spark, wanted, candidates):
    df = matching.match_nearest(spark.createDataFrame(wanted, SCHEMA), spark.createDataFrame(candidates, SCHEMA), key="query_id", stratum=["kind", "place"], distance=DISTANCE)
    rows = df.collect()
    out = {r.query_id: (r.match, r.exact) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize(("n_wanted", "n_candidates", "classes"), [(60, 200, 4), (80, 60, 3), (50, 50, 1), (30, 0, 3), (0, 30, 3), (70, 90, 9)])
def test_equal_to_a_serial_pass(spark, n_wanted, n_candidates, classes):
    rng = random.Random(n_wanted)
    feature = lambda: (rng.choice("abcdefghi"[:classes]), rng.choice(["x", "y", None][: max(1, classes - 1)]), rng.choice([None, *range(classes)]))
    wanted = [(i, *feature()) for i in rng.sample(range(1000), n_wanted)]
    candidates = [(i, *feature()) for i in rng.sample(range(1000, 3000), n_candidates)]
    assert match(spark, wanted, candidates) == serial(wanted, candidates)


def test_one_class_of_rows_and_many_classes_of_candidates(spark):
    """All rows have the same choices, each class has one place: no round for every class."""
    wanted = [(i, "a", "x", 0) for i in range(40)]
    candidates = [(100 + i, "a", "x", i) for i in range(60)]
    assert match(spark, wanted, candidates) == serial(wanted, candidates) == {i: (100 + i, True) for i in range(40)}


def test_swap_repair_reports_what_is_left(spark):
    rows = [(1, "a", "test", "p"), (2, "a", "test", "q"), (3, "b", "train", "p"), (4, "b", "train", "q"), (5, "a", "train", "r"), (6, "a", "validation", "s")]
    base = spark.createDataFrame(rows, "query_id long, lang string, split string, product_id string")
    got = splits.swap_repair(base, base, split="split", stratum=["lang"], reserved=("validation",)).collect()
    assert {(r.removed, r.replacement, r.exact) for r in got} == {(1, 5, True), (2, None, None)}
