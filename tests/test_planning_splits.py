"""Plans, splits and selections: invariants and brute force."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlight.operators import groups as K
from cartlight.operators import planning as D
from cartlight.operators import splits as J
from cartlight.operators import validation as M


def test_quota_numbers():
    assert sum(D.quota_numbers(101, D.PRODUCT_VOUCHER_WEIGHTS).values()) == 101
    assert D.quota_numbers(10, {"a": 0.25, "b": 0.45, "c": 0.30}) == {"a": 2, "b": 5, "c": 3}
    assert D.quota_numbers(0, {"a": 1.0}) == {"a": 0}


def test_voucher_text_round_trip(spark, tables):
    v = D.build_voucher(tables.v_voucher_base).withColumn("text", D.budget_sentence())
    p = D.parse_voucher_text(v, text="text")
    same = (
        F.col("parse_ok")
        & (F.col("scope") == F.col("voucher_type"))
        & (F.col("parsed_threshold") == F.col("threshold"))
        & (F.col("parsed_budget") == F.col("budget"))
        & F.col("parsed_value").eqNullSafe(F.col("face_value").cast("double"))
        & F.col("parsed_cap").eqNullSafe(F.col("cap").cast("double"))
    )
    assert p.filter(~same).isEmpty() and p.count() > 1000
    assert v.filter("price_after_voucher > budget or threshold > total").isEmpty()


def test_incomplete_voucher_text(spark):
    df = spark.createDataFrame([("I want a ring",), ("My budget is only `5`, but I have a voucher: 10% off",)], "t string")
    assert [r.parse_ok for r in D.parse_voucher_text(df, text="t").collect()] == [False, False]


def test_assignment_is_disjoint_on_any_partitioning(spark):
    specs = D.build_specs(spark.range(40).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("sample_id")), key="sample_id")
    products = spark.range(600).select(F.col("id").cast("string").alias("product_id"), (F.col("id") % 9).cast("string").alias("shop_id"))
    excluded = products.filter("product_id in ('1', '2', '3')")
    a = D.assign_products(specs, products, excluded=excluded)
    b = D.assign_products(specs.repartition(1), products.repartition(13), excluded=excluded)
    rows = a.collect()
    assert sorted(rows) == sorted(b.collect())
    assert len({r.product_id for r in rows}) == len(rows) and not {"1", "2", "3"} & {r.product_id for r in rows}
    want = {r.sample_id: (r.n_products, r.voucher_type) for r in specs.collect()}
    by = {}
    for r in rows:
        by.setdefault(r.sample_id, []).append(r)
    assert set(by) == set(want)
    for s, lines in by.items():
        assert len(lines) == want[s][0] and sorted(r.pos for r in lines) == list(range(1, len(lines) + 1))
        assert want[s][1] == "platform" or len({r.shop_id for r in lines}) == 1


@pytest.mark.parametrize("n_specs", [0, 30, 400])
def test_nobody_waits_while_products_would_do(spark, n_specs):
    """A hot shop, shops of one product, products without a shop; more specs than products can serve."""
    specs = spark.createDataFrame([(f"s{i}", 1 + i % 5, "platform" if i % 3 == 0 else "shop") for i in range(n_specs)], "sample_id string, n_products int, voucher_type string")
    shop = lambda i: "hot" if i % 3 == 0 else None if i % 10 == 1 else f"s{i % 40}"
    products = spark.createDataFrame([(i, shop(i)) for i in range(300)], "product_id long, shop_id string")
    rows = D.assign_products(specs, products, excluded=products.filter("product_id < 20")).collect()
    assert len({r.product_id for r in rows}) == len(rows) and all(r.product_id >= 20 and r.shop_id == shop(r.product_id) for r in rows)
    want = {r.sample_id: (r.n_products, r.voucher_type) for r in specs.collect()}
    by = {}
    for r in rows:
        by.setdefault(r.sample_id, []).append(r)
    for s, lines in by.items():
        assert sorted(r.pos for r in lines) == list(range(1, want[s][0] + 1))
        assert want[s][1] == "platform" or (len({r.shop_id for r in lines}) == 1 and lines[0].shop_id)
    free = [shop(i) for i in range(20, 300) if i not in {r.product_id for r in rows}]
    most = max((free.count(x) for x in set(free) if x), default=0)
    for s in set(want) - set(by):
        assert want[s][0] > (len(free) if want[s][1] == "platform" else most)
    assert n_specs > 100 or len(by) == n_specs


def test_maximin_against_brute_force(tables):
    rows = tables.embeddings.orderBy("vec_id").collect()
    vecs = np.array([r.embedding for r in rows], dtype=float)
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    chosen = [0]
    while len(chosen) < 6:
        near = np.round((vecs @ vecs[chosen].T), 9).max(axis=1)
        near[chosen] = 9
        chosen.append(int(near.argmin()))
    got = D.maximin_select(tables.embeddings, key="vec_id", embedding="embedding", k=6, every=2)
    assert got == [rows[i].vec_id for i in chosen]


def test_coverage_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"a{rng.integers(3)}", f"b{rng.integers(4)}", float(rng.integers(3)) / 10) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a string, b string, bonus double")
    got = {r.id: r.pick for r in J.coverage_select(df, key="id", dimensions=["a", "b"], bonus=F.col("bonus"), k=7, tie=[]).collect()}
    covered, left, want = {}, list(rows), []
    for _ in range(7):
        best = max(left, key=lambda r: (round(sum(1 / (1 + covered.get(k, 0)) for k in r[1:3]) + r[3], 9), -r[0]))
        want.append(best[0])
        left.remove(best)
        for k in best[1:3]:
            covered[k] = covered.get(k, 0) + 1
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == want


def test_maximin_coreset(spark):
    """One piece: the serial choice. Many pieces: within the stated factor of the best of all subsets, repeated vectors included."""
    rng = np.random.default_rng(3)
    vecs = np.round(rng.normal(size=(300, 5)), 2)
    vecs[100:200] = vecs[0]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)] + [(999, [0.0] * 5)], "id int, v array<double>")
    assert D.maximin_select(df, key="id", embedding="v", k=12) == [r.id for r in sorted(D.maximin_coreset(df, key="id", embedding="v", k=12).collect(), key=lambda r: r.pick)]
    many = D.maximin_select(df, key="id", embedding="v", k=100)
    assert len(set(many)) == 100 and 999 not in many
    few = vecs[:22]
    unit = few / np.linalg.norm(few, axis=1, keepdims=True)
    angle = np.arccos(np.clip(unit @ unit.T, -1, 1))
    least = lambda ids: min(angle[a, b] for a, b in itertools.combinations(ids, 2))
    best = max(map(least, itertools.combinations(range(22), 4)))
    small = df.filter("id < 22")
    got = [r.id for r in D.maximin_coreset(small, key="id", embedding="v", k=4, piece_rows=8).collect()]  # pieces of 16 at least
    assert len(set(got)) == 4 and least(got) >= best / 6
    assert D.maximin_coreset(small.limit(0), key="id", embedding="v", k=4).count() == 0


@pytest.mark.parametrize(("k", "classes", "depth"), [(150, 2, 1), (40, 1, 1), (200, None, 2), (0, None, 2)])
def test_coverage_of_many_rows(spark, k, classes, depth):
    """Fetches that must widen give what a pass over all rows gives; more asked for than there are; nulls and ties."""
    rng = np.random.default_rng(2)
    pick = lambda n: f"v{n}" if n else None
    rows = [(i, pick(int(rng.integers(9))), pick(int(rng.integers(6))), float(rng.integers(4)) / 8, int(rng.integers(2))) for i in range(180)]
    df = spark.createDataFrame(rows, "id int, a string, b string, bonus double, t int")
    out = J.coverage_select(df, key="id", dimensions=["a", "b"], bonus=F.col("bonus"), k=k, tie=[F.col("t")], classes=classes, depth=depth).collect()
    covered, left, want = {}, list(rows), []
    for _ in range(min(k, len(rows))):
        best = min(left, key=lambda r: (-round(sum(1 / (1 + covered.get((d, r[d]), 0)) for d in (1, 2)) + r[3], 9), r[4], r[0]))
        want.append(best[0])
        left.remove(best)
        for d in (1, 2):
            covered[d, best[d]] = covered.get((d, best[d]), 0) + 1
    assert [r.id for r in sorted(out, key=lambda r: r.pick)] == want


def test_swap_repair(spark):
    # test queries 0..9 share products with train 100..109; 200.. are free
    lines = [(q, f"p{q % 100}", "test" if q < 50 else "train") for q in [*range(20), *range(100, 110)]] + [(200 + i, f"free{i}", "train") for i in range(15)]
    feats = [(q, "x" if q % 2 else "y", s) for q, _, s in lines]
    f = spark.createDataFrame(feats, "query_id int, kind string, split string")
    li = spark.createDataFrame(lines, "query_id int, product_id string, split string")
    rows = J.swap_repair(f, li, split="split", stratum=["kind"]).collect()
    assert {r.removed for r in rows} == set(range(10))
    assert len({r.replacement for r in rows}) == 10 and all(r.replacement >= 200 for r in rows)
    kinds = {q: k for q, k, _ in feats}
    assert all(kinds[r.removed] == kinds[r.replacement] for r in rows if r.exact) and sum(r.exact for r in rows) >= 9


def test_split_is_a_disjoint_cover(tables):
    out = J.stratified_split(tables.v_strata, key="doc_id", strata=["lang", "quality"], val_size=0.25)
    n = tables.v_strata.count()
    assert out.count() == n and out.filter("split = 'val'").count() == round(n * 0.25)
    assert J.stratified_split(tables.v_strata, key="doc_id", strata=["lang"], val_size=0.0).filter("split = 'val'").isEmpty()


def test_joint_panels_are_disjoint(tables):
    f = J.query_features(tables.v_plan)
    rows = J.joint_panels(f, key="order_id", strata=["voucher_type", "discount_type"], size=40).collect()
    assert len({r.order_id for r in rows}) == len(rows) == 80
    assert sum(r.panel == "validation" for r in rows) == 40


@pytest.mark.parametrize("seed", range(12))
def test_balanced_counts_keep_every_margin(seed):
    rng = np.random.default_rng(seed)
    shape = (3, 4, 5, 2)
    cells = rng.permutation(np.stack(np.unravel_index(np.arange(np.prod(shape)), shape), axis=1))[:80]
    sizes = rng.integers(1, 9, len(cells))
    sizes[0] = sizes[1:].sum() // 2  # a third of all rows
    keys = [tuple(np.unique(cells[:, d], return_inverse=True)[1]) for d in range(4)] + [tuple(np.unique(cells[:, :2], axis=0, return_inverse=True)[1].ravel())]
    member = np.concatenate([np.eye(max(k) + 1)[list(k)] for k in keys], axis=1)
    for size in (1, 37, sizes.sum() // 2):
        got = J.balanced_counts(sizes, member, int(size))
        off = got @ member - member.T @ sizes * (size / sizes.sum())
        assert (got.sum(axis=1) == size).all() and (got >= 0).all() and (got.sum(axis=0) <= sizes).all()
        assert np.abs(off).max() < 1, (size, np.abs(off).max())


def test_margin_panels(spark, tables):
    f = J.query_features(tables.v_plan)
    margins = [["voucher_type"], ["discount_type"], ["product_count"], ["voucher_type", "product_count"]]
    rows = J.margin_panels(f, key="order_id", margins=margins, size=60)
    report = J.margin_report(f, rows, margins=margins, size=60).collect()
    assert max(abs(x) for r in report for x in (r.calibration_off, r.validation_off)) < 1
    got = [(r.order_id, r.panel) for r in rows.collect()]
    assert len(dict(got)) == len(got) == 120 and sum(p == "validation" for _, p in got) == 60
    few = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, None)], "k int, d string")
    assert sorted(r.panel for r in J.margin_panels(few, key="k", margins=[["d"]], size=2).collect()) == ["calibration"] * 2 + ["validation"] * 2
    assert J.margin_panels(few.limit(0), key="k", margins=[["d"]], size=0).collect() == []
    with pytest.raises(ValueError):
        J.margin_panels(few, key="k", margins=[["d"]], size=3)


def groups(spark):
    data = {"fail": [0] * 8, "mixed1": [0, 1] * 4, "win": [1] * 8, "mixed2": [1] + [0] * 7, "mixed3": [1, 1] + [0] * 6}
    rows = [(u, i, x, n * 10 + i) for n, (u, xs) in enumerate(data.items()) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "uid string, sample int, outcome int, position int")


def test_mixed_selection(spark):
    df = groups(spark)
    rows = K.mixed_selection(df, by="uid", order="position", max_groups=2).collect()
    assert {r.uid for r in rows} == {"mixed1", "mixed2"} and len(rows) == 16
    states = {r.uid: r.state for r in K.group_state(df, by=["uid"]).collect()}
    assert states["fail"] == "all_fail" and states["win"] == "all_success" and states["mixed3"] == "mixed"
    with pytest.raises(Exception, match="wrong group size"):
        K.mixed_selection(df.filter("not (uid = 'win' and sample = 7)"), by="uid", order="position").collect()


def test_bootstrap_is_centred(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 4 == 0).cast("int").alias("x"))
    row = K.bootstrap_ci(df, by=[], key="id", value="x", draws=300).first()
    assert row.ci_low < row["mean"] == 0.25 < row.ci_high and 0.08 < row.ci_high - row.ci_low < 0.16


def test_bootstrap_state_is_summed_before_the_shuffle(spark):
    """Draws of 5,000 rows: what is exchanged are sums by draw, and their distribution is that of resampling."""
    df = spark.range(0, 5000, 1, 6).select("id", (F.col("id") % 10).cast("double").alias("x"))
    means = K.bootstrap_means(df, by=[], key="id", value="x", draws=402)
    plan = means._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.index("Exchange") :]
    assert plan.count("Exchange") == 1 and "partial_sum" in before and "Generate explode" in before
    got = [r["mean"] for r in means.collect()]
    assert len(got) == 402 and abs(np.mean(got) - 4.5) < 0.01 and abs(np.std(got) / (8.25 / 5000) ** 0.5 - 1) < 0.2
    one = K.bootstrap_means(spark.createDataFrame([(1, None), (2, 7.0)], "id int, x double"), by=[], key="id", value="x", draws=40).collect()
    assert {r["mean"] for r in one} == {None, 7.0} and K.bootstrap_means(df.limit(0), by=[], key="id", value="x", draws=5).count() == 0


def test_weights_are_poisson():
    steps = [int(s, 16) / 2**32 for s in K.poisson_steps()]
    share = np.diff([0, *steps, 1])
    assert abs(share[0] - np.exp(-1)) < 1e-9 and abs((share * np.arange(len(share))).sum() - 1) < 1e-8


def test_votes_of_hot_keys_are_the_same(spark, monkeypatch):
    rows = [(k, i, "abc"[(i * 7 + k) % 3] if i % 5 else None, float(i % 4)) for k, n in ((1, 1), (2, 9), (3, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, sample int, pred string, value double")
    vote = lambda: sorted(map(tuple, M.majority_vote(df, keys=["k"], sample="sample", pred="pred", value="value", n=6, draws=50).collect()))
    usual = vote()
    for limit in (0, 10):
        monkeypatch.setattr(M, "KEY_SAMPLES", limit)
        assert [tuple(round(v, 9) for v in r) for r in vote()] == [tuple(round(v, 9) for v in r) for r in usual]


def test_resamples_draw_with_replacement_as_many_rows_as_there_are(spark):
    """Each draw takes 12 rows at hashed positions, some repeatedly; the means are those of a plain replay."""
    rows = [(i, "ab"[i % 2], float(i * i)) for i in range(24)]
    df = spark.createDataFrame(rows, "id int, g string, x double")
    digits = lambda text: hashlib.md5(text.encode()).hexdigest()
    want = {}
    for g in "ab":
        xs = [x for _, _, x in sorted((r for r in rows if r[1] == g), key=lambda r: digits(f"0:{r[0]}"))]
        want |= {(g, d): np.mean([xs[int(int(digits(f"0:{d}:{i}")[:8], 16) / 2**32 * 12)] for i in range(1, 13)]) for d in range(1, 31)}
    got = {(r.g, r.draw): r["mean"] for r in K.resample_means(df, by=["g"], key="id", value="x", draws=30).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    row = K.bootstrap_ci(df, by=["g"], key="id", value="x", draws=30).filter("g = 'a'").first()
    assert abs(row.ci_low - np.percentile([m for (g, _), m in want.items() if g == "a"], 2.5)) < 1e-9
    # right - left is the same for both keys of a pair: its resamples are those of the differences
    pair = K.paired_bootstrap(df.withColumn("x", F.lit(0.0)), df.filter("g = 'b'"), key="id", value="x", draws=30).first()
    only = {d: m for (g, d), m in want.items() if g == "b"}
    assert pair.n == 12 and abs(pair.ci_high - np.percentile([*only.values()], 97.5)) < 1e-9


def test_reports_read_their_rows_once(spark, tmp_path):
    """Both reports come from counts that were written once, not from their input again; nulls are a value of their own."""
    rows = [(i, "ab"[i % 2] if i % 5 else None, i % 3) for i in range(90)]
    spark.createDataFrame(rows, "id long, a string, b int").write.parquet(f"{tmp_path}/features")
    features = spark.read.parquet(f"{tmp_path}/features")
    chosen = features.filter("id < 40").withColumn("panel", F.when(F.col("id") < 20, "calibration").otherwise("validation"))
    report = J.margin_report(features, chosen, margins=[["a"], ["a", "b"], ["b"]], size=20)
    assert all("margin-cells" in f for f in report.inputFiles())
    got = {(r.margin, r.value): (r.n, round(r.share, 9), round(r.calibration_off, 9), round(r.validation_off, 9)) for r in report.collect()}
    expected = {}
    for name, value in (("a", lambda r: r[1] or "null"), ("a,b", lambda r: f"{r[1] or 'null'}|{r[2]}"), ("b", lambda r: str(r[2]))):
        for v in {value(r) for r in rows}:
            held = [r[0] for r in rows if value(r) == v]
            share = 20 * len(held) / 90
            expected[name, v] = (len(held), round(share, 9), round(sum(i < 20 for i in held) - share, 9), round(sum(20 <= i < 40 for i in held) - share, 9))
    assert got == expected
    spark.createDataFrame([(i % 4 > 0, " ".join("x" * (1 + i % 7))) for i in range(50)], "eligible boolean, query string").write.parquet(f"{tmp_path}/audit")
    report = J.audit_report(spark.read.parquet(f"{tmp_path}/audit"))
    assert all("audit-words" in f for f in report.inputFiles())
    words = sorted(1 + i % 7 for i in range(50) if i % 4)
    at = lambda q: words[round((len(words) - 1) * q)]
    assert tuple(report.first()) == (50, len(words), 50 - len(words), len(words) / 50, words[0], at(0.5), at(0.95), words[-1])
    none = J.audit_report(spark.createDataFrame([], "eligible boolean, query string")).first()
    assert tuple(none) == (0, 0, 0, None, None, None, None, None)
