"""Positions, running sums and quantiles: hot and plain paths agree."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cartlight.functions import hashing, ranking, stats
from cartlight.operators import search as C


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 900
    # one group holds a third of all rows
    g = np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 20, n))
    pdf = pd.DataFrame({"g": g, "i": np.arange(n), "x": rng.integers(0, 40, n)})
    return spark.createDataFrame(pdf).repartition(7), pdf


def test_ordered_sum_is_a_row_number(rows):
    df, pdf = rows
    got = ranking.ordered_sum(df, [F.col("x"), F.col("i")]).toPandas().sort_values(["x", "i"])
    assert got["idx"].tolist() == list(range(1, len(pdf) + 1))


def test_ordered_sum_by_group_with_weight(rows):
    df, pdf = rows
    got = ranking.ordered_sum(df, [F.col("i")], by=("g",), weight=F.col("x"), name="s").toPandas().set_index("i")["s"]
    want = pdf.sort_values("i").groupby("g")["x"].cumsum()
    assert (got.sort_index() == want.sort_index()).all()


@pytest.mark.parametrize("upto", ["before", "current"])
def test_running_hot_equals_window(rows, upto):
    df, _ = rows
    cols = {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "lo": ("min", F.col("x")), "n": ("count", F.col("x"))}
    plain = ranking.running(df, ["g"], [F.col("i")], cols, upto=upto, hot=False).toPandas().sort_values("i")
    hot = ranking.running(df, ["g"], [F.col("i")], cols, upto=upto, hot=True).toPandas().sort_values("i")
    for c in ("s", "m", "lo"):
        assert plain[c].fillna(-1).tolist() == hot[c].fillna(-1).tolist(), c
    assert plain["n"].fillna(0).tolist() == hot["n"].fillna(0).tolist()


def test_neighbour_hot_equals_window(rows):
    df, _ = rows
    cols = {"prev": (F.col("x"), -1), "next2": (F.col("x"), 2)}
    plain = ranking.neighbour(df, ["g"], [F.col("i")], cols, hot=False).toPandas().sort_values("i")
    hot = ranking.neighbour(df, ["g"], [F.col("i")], cols, hot=True).toPandas().sort_values("i")
    for c in cols:
        assert plain[c].fillna(-1).tolist() == hot[c].fillna(-1).tolist()


def test_hot_group_is_found(rows):
    df, _ = rows
    assert ranking.has_hot_group(df, ["g"], limit=200)
    assert not ranking.has_hot_group(df, ["g"], limit=1000)


def test_hash_index_is_a_permutation_on_any_partitioning(rows):
    df, pdf = rows
    a = hashing.hash_index(df, "i").toPandas().set_index("i")["idx"]
    b = hashing.hash_index(df.repartition(1), "i").toPandas().set_index("i")["idx"]
    assert sorted(a) == list(range(1, len(pdf) + 1))
    assert (a.sort_index() == b.sort_index()).all()


@pytest.mark.parametrize("rule", ["linear", "nearest_rank", "upper_median"])
def test_quantiles(rows, rule):
    df, pdf = rows
    qs = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = stats.quantiles(df, "x", qs, by=("g",), rule=rule).toPandas()
    for row in got.itertuples():
        s = np.sort(pdf[pdf.g == row.g]["x"].to_numpy())
        if rule == "linear":
            want = np.quantile(s, row.q)
        elif rule == "nearest_rank":
            want = s[round((len(s) - 1) * row.q)]
        else:
            want = s[len(s) // 2]
        assert row.value == pytest.approx(want)
    assert len(got) == pdf.g.nunique() * (1 if rule == "upper_median" else len(qs))


def test_ranked_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """Short rows that open to many pairs are not put into few tasks; the ranks stay."""
    docs = spark.createDataFrame([(i, f"common w{i % 3} x{i}") for i in range(40)], "id int, contents string")
    asked = spark.createDataFrame([(i, f"common w{i} x{2 * i}") for i in range(5)], "query_id int, q string")
    usual = sorted(map(tuple, C.bm25_topk(asked, docs, k=3).collect()))
    monkeypatch.setattr(C, "TASK_PAIRS", 10)
    out = C.bm25_topk(asked, docs, k=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and ", 20), REPARTITION_BY_NUM" in plan and len(usual) == 15
    assert sorted(map(tuple, out.collect())) == usual
