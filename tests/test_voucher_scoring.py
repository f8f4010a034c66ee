"""Hand cases for voucher arithmetic and constraint matching."""

import random

import duckdb
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cartlight.operators import advantage as L
from cartlight.operators import scoring as S
from cartlight.operators import voucher as V
from cartlight.plans import catalogue
from cartlight.plans.registry import oracle_text

catalogue.load()

PRODUCTS = [("1", "A", 60.0), ("2", "A", 50.0), ("3", "B", 50.0)]


def verdict(spark, ids, **voucher):
    products = spark.createDataFrame(PRODUCTS, "product_id string, shop_id string, price double")
    lines = spark.createDataFrame([(1, i) for i in ids], "order_id bigint, product_id string")
    base = {"face_value": None, "discount": None, "cap": None, **voucher}
    v = spark.createDataFrame([Row(order_id=1, **base)], "order_id bigint, face_value double, discount double, cap double, " + ", ".join(
        f"{k} {'string' if k.endswith('type') else 'double'}" for k in voucher if k not in ("face_value", "discount", "cap")))
    # column order follows the schema text
    v = spark.createDataFrame([tuple([1, base["face_value"], base["discount"], base["cap"]] + [voucher[k] for k in voucher if k not in ("face_value", "discount", "cap")])], v.schema)
    totals = V.basket_totals(lines, products).join(v, "order_id")
    return V.within_budget(V.payable_total(totals)).first()


def test_platform_fixed(spark):
    row = verdict(spark, ["1", "2"], voucher_type="platform", discount_type="fixed", threshold=100.0, face_value=20.0, budget=100.0)
    assert (row.within_budget, row.payable, row.voucher_used) == (1, 90.0, True)


def test_threshold_not_reached(spark):
    assert verdict(spark, ["1", "2"], voucher_type="platform", discount_type="fixed", threshold=111.0, face_value=20.0, budget=100.0).within_budget == 0


def test_percentage_with_cap(spark):
    row = verdict(spark, ["1", "2"], voucher_type="platform", discount_type="percentage", threshold=100.0, discount=0.2, cap=15.0, budget=95.0)
    assert (row.within_budget, row.payable) == (1, 95.0)


@pytest.mark.parametrize("ids,ok", [(["1", "2"], 1), (["1", "3"], 0)])
def test_shop_voucher(spark, ids, ok):
    assert verdict(spark, ids, voucher_type="shop", discount_type="fixed", threshold=100.0, face_value=20.0, budget=100.0).within_budget == ok


def test_missing_product_fails_budget(spark):
    row = verdict(spark, ["1", "9"], voucher_type="platform", discount_type="fixed", threshold=10.0, face_value=5.0, budget=1000.0)
    assert (row.n_missing, row.within_budget) == (1, 0)


def test_budget_orders_agree(tables):
    totals = V.basket_totals(tables.v_recommended, tables.v_product).join(tables.v_voucher, "order_id")
    priced = V.payable_total(totals)
    a = V.within_budget(priced).select("order_id", F.col("within_budget").alias("a"))
    b = V.discount_first_budget(priced).select("order_id", F.col("within_budget").alias("b"))
    assert a.join(b, "order_id").filter("a <> b").isEmpty()


CONSTRAINT = "product_id string, title array<string>, price array<struct<mode:string,lo:double,hi:double>>, service array<string>, sku_options array<map<string,string>>, attributes array<map<string,array<string>>>"
PRODUCT = "product_id string, shop_id string, title string, price double, service array<string>, sku_options map<int,map<string,string>>, attributes map<string,array<string>>"


def rule(spark, constraint, similarity=(0.9,)):
    product = ("p", "A", "ring", 100.0, ["COD"], {1: {"size": "s"}, 2: {"size": "m"}}, {"color": ["red", "blue"]})
    df = spark.createDataFrame([(product, constraint, list(similarity))], f"product struct<{struct(PRODUCT)}>, constraint struct<{struct(CONSTRAINT)}>, title_similarity array<double>")
    return S.rule_score(df).first()


def struct(text):
    # "a b, c d" -> "a:b,c:d" at the top level
    out, depth, part = [], 0, ""
    for ch in text + ",":
        depth += ch in "<"
        depth -= ch in ">"
        if ch == "," and depth == 0:
            name, kind = part.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            part = ""
        else:
            part += ch
    return ",".join(out)


FULL = ("q", ["a ring"], [("between", 90.0, 110.0)], ["COD"], [{"size": "m"}], [{"color": ["red"]}])


def test_all_requirements_hold(spark):
    assert rule(spark, FULL).rule == 1.0


def test_one_of_four_fails(spark):
    row = rule(spark, ("q", ["a ring"], [("less than", None, 50.0)], ["COD"], [{"size": "m"}], []))
    assert row.rule == 0.75 and row.price_hits == 0


def test_variant_hits_are_the_best_single_variant(spark):
    row = rule(spark, ("q", [], [], [], [{"size": "s"}, {"size": "m"}], []))
    assert (row.sku_attrs_hits, row.sku_attrs_total) == (1, 2)


def test_exact_id_scores_one_with_empty_counters(spark):
    row = rule(spark, ("p", ["other"], [("less than", None, 1.0)], ["x"], [], []), similarity=(0.0,))
    assert row.rule == 1.0 and row.title_total == 0 and row.gt == 1


def test_no_requirement_scores_zero(spark):
    assert rule(spark, ("q", [], [], [], [], []), similarity=()).rule == 0.0


def test_success_rates(spark):
    df = spark.createDataFrame([(1.0, 1, True), (1.0, 1, False), (0.75, 1, True)], "rule double, within_budget int, terminate_success boolean")
    got = [(r.paper_asr, r.terminal_asr) for r in S.success_rates(df).collect()]
    assert sorted(got) == [(0, 0), (1, 0), (1, 1)]


def test_tool_call_similarity(spark):
    same = '[{"name": "find", "parameters": {"q": "red ring"}}]'
    near = '[{"name": "find", "parameters": {"q": "red bolt"}}]'
    other = '[{"name": "end", "parameters": {}}]'
    df = spark.createDataFrame([(same, same), (same, near), (same, other)], "a string, b string")
    got = [r.s for r in df.select(S.tool_call_similarity("a", "b").alias("s")).collect()]
    # near: names 1, parameter names 1, words 1 of 3; at most 3
    assert got[0] == 3.0 and got[1] == pytest.approx(6 * (2 + 1 / 3) / 3 - 3) and got[2] == -3.0


def test_advantages_only_in_mixed_groups(spark):
    rows = [(g, i, s) for g, scores in {1: [0.0] * 4, 2: [1.0] * 4, 3: [1.0, 0.0, 0.0, 1.0]}.items() for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "uid int, sample int, score double")
    got = {(r.uid, r.sample): r.advantage for r in L.advantage("grpo", df).collect()}
    assert all(got[g, i] == 0 for g in (1, 2) for i in range(4))
    assert got[3, 0] > 0 > got[3, 1]
    assert sum(got[3, i] for i in range(4)) == pytest.approx(0)
    with pytest.raises(KeyError):
        L.advantage("nothing", df)


def test_group_of_one(spark):
    df = spark.createDataFrame([(1, 0, 0.7, 5)], "uid int, sample int, score double, response_tokens int")
    assert L.grpo(df).first().advantage == pytest.approx(0.7, abs=1e-5)
    assert L.rloo(df).first().advantage == pytest.approx(0.7)
    assert L.opo(df).first().advantage == pytest.approx(0.7)
    with pytest.raises(Exception, match="at least two"):
        L.grpo_passk(df).collect()


def test_attribute_hits_once_a_row(spark):
    """Attributes are listed once a row, not for every wanted value of every variant; repeats and null maps as before."""
    rows = [
        ([{"size": "1"}], [{"brand": ["a", "b"]}, {"color": ["r"]}], {1: {"size": "1"}, 2: {"size": "2", "color": "r"}}, {"brand": ["b"], "x": ["a"]}),
        ([{"size": "2"}, {"size": "2"}], [{"brand": ["b", "b"]}], {1: {"size": "1"}, 2: {"size": "2"}}, {"brand": ["b"], "size": ["2"]}),
        ([], [], {}, {}),
        ([{"size": "1"}], [{"brand": ["a"]}], {1: {"size": "1"}}, None),
        ([{"size": "1"}], [{"brand": ["a"]}], None, {"brand": ["a"]}),
    ]
    schema = "i int, c struct<sku_options:array<map<string,string>>,attributes:array<map<string,array<string>>>>, p struct<sku_options:map<int,map<string,string>>,attributes:map<string,array<string>>>"
    df = spark.createDataFrame([(i, (a, b), (c, d)) for i, (a, b, c, d) in enumerate(rows)], schema)
    hits, total = S.sku_attr_hits(F.col("p"), F.col("c"))
    out = df.select("i", hits.alias("h"), total.alias("n"))

    def brute(sku, attributes, options, attrs):
        wanted = [kv for m in sku for kv in m.items()] + [(k, v) for m in attributes for k, vs in m.items() for v in vs]
        own = {(k, v) for k, vs in (attrs or {}).items() for v in vs}
        if options is None:
            return None, len(wanted)
        return max(sum(w in own or w in s for w in wanted) for s in [set(), *(set(o.items()) for o in options.values())]), len(wanted)

    assert [(r.h, r.n) for r in out.orderBy("i").collect()] == [brute(*r) for r in rows]
    assert "array_contains(flatten" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_set_overlap_pieces_grow_with_the_rows(spark, monkeypatch, tmp_path):
    """A task's rows are bounded: more lines give more pieces, and the same rows; one order holds most lines."""
    from cartlight.plans import catalogue

    catalogue.load()
    lines = [(1, i, "R" if i % 5 == 0 else "N") for i in range(300)] + [(i // 3, i % 7, "RN"[i % 2]) for i in range(60)] + [(None, 4, "N"), (5, None, "R"), (5, 1, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    plain = sorted(catalogue.QUERIES["set_overlap"](spark, str(tmp_path)).collect(), key=str)
    monkeypatch.setattr(S, "PIECE_ROWS", 10)
    out = catalogue.QUERIES["set_overlap"](spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == 37
    assert sorted(out.collect(), key=str) == plain
    expected = set()
    for order in {o for o, _, _ in lines}:
        gold = {p for o, p, _ in lines if o == order}
        back = {p for o, p, f in lines if o == order and f == "R"}
        n = len(gold - back)
        recall, precision = n / len(gold), float(n > 0)
        expected.add((order, round(recall, 6), precision, round(2 * recall * precision / (recall + precision), 6) if n else 0.0))
    assert {tuple(r) for r in plain} == expected


def test_pairs_travel_without_lists_and_maps(spark, tmp_path, monkeypatch):
    """Baskets with repeated products: rows equal the twins', and what is paired and shuffled holds plain columns only."""
    rng = random.Random(5)
    lines = [(i // 5, rng.randint(1, 8), rng.randint(1, 3), 1.0 + i % 4, rng.choice("RNA")) for i in range(150)] + [(2, 1, 1, 1.0, "R"), (2, 1, 1, 1.0, "N")]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string"),
        "part": ([(i, f"color{i % 3} kind{i % 4} x", f"Brand#{i % 2}", f"TYPE {i % 3}", 5 * i, 20.0 * i) for i in range(1, 9)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": ([(i, "FOP"[i % 3], ["1-URGENT", "3-MEDIUM", "5-LOW"][i // 3 % 3]) for i in range(32)], "o_orderkey long, o_orderstatus string, o_orderpriority string"),
    }
    duck = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        duck.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    seen, pair = [], S.pair_by_position
    monkeypatch.setattr(S, "pair_by_position", lambda *frames: seen.extend(frames) or pair(*frames))
    for name in ("eval_shop", "eval_voucher", "success_rates", "evaluation_report"):
        got = catalogue.QUERIES[name](spark, str(tmp_path))
        cursor = duck.execute(oracle_text(catalogue.ORACLES[name]))
        order = [d[0] for d in cursor.description]
        assert sorted(map(tuple, got.select(*order).collect())) == sorted(cursor.fetchall())
    assert seen and not any("map<" in f.schema.simpleString() or "array<" in f.schema.simpleString() for f in seen)
