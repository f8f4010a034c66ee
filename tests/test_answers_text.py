"""Answer scorers, formula clean-up, text and catalogue helpers."""

import pytest
from pyspark.sql import functions as F

from cartlight.functions import text as X
from cartlight.operators import answers as N
from cartlight.operators import catalog as B
from cartlight.operators import training as O


def value(spark, fn, *texts):
    df = spark.createDataFrame([texts], ", ".join(f"c{i} string" for i in range(len(texts))))
    return df.select(fn(*[F.col(f"c{i}") for i in range(len(texts))]).alias("v")).first().v


@pytest.mark.parametrize(
    "text,want",
    [
        ("\\frac12", "\\frac{1}{2}"),
        ("\\dfrac1{72}", "\\frac{1}{72}"),
        ("\\sqrt3 + x", "\\sqrt{3}+x"),
        ("0.5", "\\frac{1}{2}"),
        ("3/4", "\\frac{3}{4}"),
        ("03/4", "03/4"),
        ("k = .5", "\\frac{1}{2}"),
        (" .5", "\\frac{1}{2}"),
        ("90^\\circ", "90"),
        ("5 \\text{ meters}", "5"),
        ("\\left( 1 \\right)", "(1)"),
        ("10\\%", "10"),
    ],
)
def test_formula(spark, text, want):
    assert value(spark, N.normalize_formula, text) == want


@pytest.mark.parametrize(
    "text,want",
    [("x = 1,000 dollars", "1000"), ("$5$", "5"), ("\\text{yes}", "yes"), ("\\fracab", "\\frac{a}{b}"), ("\\boxed{7}", "7"), ("a cat", "cat")],
)
def test_final_answer(spark, text, want):
    assert value(spark, N.normalize_final, text) == want


def test_last_boxed(spark):
    assert value(spark, N.last_boxed, "a \\boxed{1} b \\boxed{x^{2}} c") == "x^{2}"
    assert value(spark, N.last_boxed, "a \\boxed{1") is None
    assert value(spark, lambda c: N.last_boxed(c, tail=5), "\\boxed{1} and more text") is None


def test_numbers(spark):
    assert value(spark, N.last_number, "so 5 #### 1,234 end") == "1234"
    assert value(spark, N.last_number, "so 5") is None
    assert value(spark, lambda c: N.last_number(c, strict=False), "5 then 7 .") == "7"


def test_qa(spark):
    em = lambda s: N.score_qa_em(s, F.array(F.lit("The Eiffel tower"), F.lit("x")))
    assert value(spark, em, "<answer>no</answer> <answer>eiffel  tower!</answer>") == 1.0
    assert value(spark, em, "<answer>eiffel tower</answer>" * 11) == 0.25
    assert value(spark, em, "eiffel tower") == 0.0
    sub = lambda s: N.score_qa_subem(s, F.array(F.lit("tower")), format_score=0.1)
    assert value(spark, sub, "<answer>an eiffel tower view</answer>") == 1.0
    assert value(spark, sub, "<answer>none</answer>") == 0.1


def test_unknown_source_is_an_error(spark):
    df = spark.createDataFrame([("nobody", "s", "t")], "source string, solution string, truth string")
    with pytest.raises(Exception, match="no scorer"):
        N.score_table(df).collect()


def test_entities(spark):
    assert value(spark, X.unescape_html, "a &lt;b&gt; &amp;amp; &quot;") == 'a <b> &amp; "'
    assert value(spark, X.unescape_html_full, "caf&eacute; &#65; plain") == "café A plain"
    assert value(spark, B.clean_text, "  " + "x" * 2100) == "x" * 2000


def test_sku_last_value_wins_and_renumbers(spark):
    s1, s2 = "\u0001", "\u0002"
    packed = s2.join([f"b{s1}Size{s1}L", f"a{s1}Size{s1}No", f"b{s1}Size{s1}M", f"c{s1}Color{s1}Red", "broken"])
    assert value(spark, B.unpack_sku, packed) == {1: {"size": "m"}, 2: {"color": "red"}}
    many = s2.join(f"{i}{s1}k{s1}v{i}" for i in range(12))
    assert sorted(value(spark, B.unpack_sku, many)) == list(range(1, 10))


def test_category(spark):
    assert value(spark, B.category_level1, "Home > Bath") == "Home" and value(spark, B.category_level1, "") == "Other"


def test_loss_mask_errors(spark):
    schema = "messages array<struct<role:string,content:string>>, keep array<int>"
    good = ([("system", "s"), ("user", "u"), ("assistant", "a"), ("tool", "t"), ("assistant", "b")], [0, 1])
    df = spark.createDataFrame([good], schema)
    assert O.message_loss_mask(df, messages="messages", assistant_mask="keep").first().loss_mask == [0, 0, 0, 0, 1]
    assert O.message_loss_mask(df, messages="messages").first().loss_mask == [0, 0, 1, 0, 1]
    late = spark.createDataFrame([([("user", "u"), ("system", "s")], [])], schema)
    with pytest.raises(Exception, match="system message"):
        O.message_loss_mask(late, messages="messages").collect()
    short = spark.createDataFrame([([("assistant", "a")], [])], schema)
    with pytest.raises(Exception, match="does not match"):
        O.message_loss_mask(short, messages="messages", assistant_mask="keep").collect()
