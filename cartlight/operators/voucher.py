"""Voucher arithmetic on baskets (E family).

A voucher has the columns ``voucher_type, threshold, discount_type,
face_value, discount, cap, budget``. Money is double, rounded to 2 places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOUCHER_COLUMNS = ["voucher_type", "threshold", "discount_type", "face_value", "discount", "cap", "budget"]


def money(x: Column) -> Column:
    return F.round(x, 2)


def basket_totals(lines: DataFrame, products: DataFrame, *, key: str = "order_id") -> DataFrame:
    """Total, known and missing products and shops per basket.

    One shuffle by basket: "one shop" needs only the smallest and largest shop,
    so neither a distinct count nor a collected list is built.
    """
    priced = lines.select(key, "product_id").join(
        products.select("product_id", "shop_id", "price"), "product_id", "left"
    )
    known = F.col("price").isNotNull() & F.col("shop_id").isNotNull()
    return priced.groupBy(key).agg(
        F.count("*").alias("n_items"),
        F.count_if(~known).alias("n_missing"),
        money(F.coalesce(F.sum(F.when(known, F.col("price"))), F.lit(0.0))).alias("total"),
        F.min(F.when(known, F.col("shop_id"))).alias("shop_min"),
        F.max(F.when(known, F.col("shop_id"))).alias("shop_max"),
        F.count(F.when(known, 1)).alias("n_known"),
    )


def missing_products(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Basket lines whose product is unknown or has no price or shop."""
    known = products.filter(F.col("price").isNotNull() & F.col("shop_id").isNotNull())
    return lines.join(known.select("product_id"), "product_id", "left_anti")


def voucher_used(
    total: Column, one_shop: Column, *, null_threshold: str = "ineligible", all_known: Column | None = None
) -> Column:
    """Whether the voucher applies.

    ``null_threshold``: ``ineligible`` (never applies), ``met`` (always met) or
    ``zero`` (counts as 0). ``all_known`` adds the rule that a shop voucher
    needs every shop of the basket.
    """
    threshold = F.col("threshold")
    if null_threshold == "ineligible":
        met = F.coalesce(total >= threshold, F.lit(False))
    elif null_threshold == "met":
        met = F.coalesce(total >= threshold, F.lit(True))
    elif null_threshold == "zero":
        met = total >= F.coalesce(threshold, F.lit(0.0))
    else:
        raise ValueError(f"unknown null_threshold: {null_threshold}")
    shop_ok = one_shop if all_known is None else one_shop & all_known
    scope = (F.col("voucher_type") == "platform") | ((F.col("voucher_type") == "shop") & shop_ok)
    kind = F.col("discount_type").isin("fixed", "percentage")
    return F.coalesce(scope & met & kind, F.lit(False))


def discounted(total: Column) -> Column:
    """Total after the discount, when the voucher applies."""
    fixed = total - F.coalesce("face_value", F.lit(0.0))
    percent = F.greatest(
        total * (1 - F.coalesce("discount", F.lit(0.0))), total - F.coalesce("cap", F.lit(0.0))
    )
    return F.when(F.col("discount_type") == "fixed", fixed).otherwise(percent)


def payable_total(
    baskets: DataFrame, *, null_threshold: str = "ineligible", require_all_known: bool = False
) -> DataFrame:
    """Add ``voucher_used`` and ``payable`` to baskets that carry a voucher."""
    one_shop = F.coalesce(F.col("shop_min") == F.col("shop_max"), F.lit(False))
    all_known = (F.col("n_missing") == 0) if require_all_known else None
    used = voucher_used(F.col("total"), one_shop, null_threshold=null_threshold, all_known=all_known)
    return baskets.withColumn("voucher_used", used).withColumn(
        "payable",
        money(F.when(F.col("voucher_used"), discounted(F.col("total"))).otherwise(F.col("total"))),
    )


def within_budget(baskets: DataFrame, *, expected: str | None = None) -> DataFrame:
    """1 when the undiscounted total fits, else when the discounted one does.

    With ``expected`` the basket must hold exactly that many known products.
    """
    fits = (F.col("total") <= F.col("budget")) | (F.col("payable") <= F.col("budget"))
    complete = F.col("n_missing") == 0
    if expected:
        complete = complete & (F.col("n_known") == F.col(expected))
    return baskets.withColumn("within_budget", F.coalesce(fits & complete, F.lit(False)).cast("int"))


def discount_first_budget(baskets: DataFrame) -> DataFrame:
    """The other order of the same test: discount whenever possible, then compare."""
    return baskets.withColumn(
        "within_budget",
        F.coalesce((F.col("payable") <= F.col("budget")) & (F.col("n_missing") == 0), F.lit(False)).cast("int"),
    )


def normalize_voucher(df: DataFrame, *, flat: str = "flat", nested: str = "nested") -> DataFrame:
    """Flat or nested voucher struct to flat columns.

    The nested form is ``scope, threshold, budget, discount{type,value,rate,cap}``.
    Zero face values and caps fall back to the nested form, as falsy values do.
    """
    f, n = F.col(flat), F.col(nested)
    d = n["discount"]

    def first_true(a: Column, b: Column) -> Column:
        return F.coalesce(F.when(a != 0, a), b)

    return df.withColumns(
        {
            "voucher_type": F.coalesce(f["voucher_type"], n["scope"]),
            "threshold": F.coalesce(f["threshold"], n["threshold"]).cast("double"),
            "discount_type": F.coalesce(f["discount_type"], d["type"]),
            "face_value": first_true(f["face_value"], d["value"]).cast("double"),
            "discount": F.when(d.isNotNull(), d["rate"]).otherwise(f["discount"]).cast("double"),
            "cap": first_true(f["cap"], d["cap"]).cast("double"),
            "budget": F.coalesce(f["budget"], n["budget"]).cast("double"),
        }
    )


def numeric_match_score(claimed: Column, expected: Column) -> Column:
    """1 within 0.05 or 1 %, 0.5 within 5 %, else 0."""
    error = F.abs(claimed - expected)
    relative = error / F.greatest(F.abs(expected), F.lit(1.0))
    return (
        F.when(claimed.isNull() | expected.isNull(), 0.0)
        .when((error <= 0.05) | (relative <= 0.01), 1.0)
        .when(relative <= 0.05, 0.5)
        .otherwise(0.0)
    )


def budget_claim_score(
    df: DataFrame,
    *,
    total_keys: list[str],
    payable_keys: list[str],
    verdict_keys: list[str],
) -> DataFrame:
    """Mean agreement of claimed total, payable and verdict; a missing key scores 0."""
    total = F.coalesce(*[F.col(c).cast("double") for c in total_keys])
    payable = F.coalesce(*[F.col(c).cast("double") for c in payable_keys])
    text = F.lower(F.trim(F.coalesce(*[F.col(c).cast("string") for c in verdict_keys])))
    verdict = F.when(text.isin("true", "yes", "y", "1", "within", "ok"), 1).when(
        text.isin("false", "no", "n", "0", "over", "exceed", "exceeds"), 0
    )
    score = (
        numeric_match_score(total, F.col("total"))
        + numeric_match_score(payable, F.col("payable"))
        + (verdict == F.col("within_budget").cast("int")).cast("double")
    ) / 3
    ready = total.isNotNull() & payable.isNotNull() & verdict.isNotNull() & (F.col("n_missing") == 0)
    return df.withColumn("claim_score", F.when(ready, score).otherwise(0.0))


def budget_claim_trusted(
    claims: DataFrame, claim_lines: DataFrame, candidates: DataFrame, *, key: str = "order_id"
) -> DataFrame:
    """Claims that agree with the candidates' own prices to the cent.

    ``claims``: key, claimed_total, claimed_payable, claimed_budget,
    claimed_used, claimed_within and the voucher columns. ``claim_lines``: key,
    product_id, claimed_shop.
    """
    checked = (
        claim_lines.join(candidates.select("product_id", "shop_id", "price"), "product_id", "left")
        .groupBy(key)
        .agg(
            F.bool_and(
                F.coalesce(
                    F.col("price").isNotNull() & (F.col("shop_id") == F.col("claimed_shop")), F.lit(False)
                )
            ).alias("lines_ok"),
            money(F.sum("price")).alias("total"),
            F.min("shop_id").alias("shop_min"),
            F.max("shop_id").alias("shop_max"),
            F.count_if(F.col("shop_id").isNull()).alias("n_missing"),
        )
    )
    joined = payable_total(claims.join(checked, key, "left"), null_threshold="met", require_all_known=True)

    def close(a: str, b: Column) -> Column:
        return F.abs(F.col(a) - b) <= 0.01

    trusted = (
        F.col("lines_ok")
        & close("claimed_total", F.col("total"))
        & close("claimed_payable", F.col("payable"))
        & close("claimed_budget", F.col("budget"))
        & (F.col("claimed_used") == F.col("voucher_used"))
        & (F.col("claimed_within") == (F.col("payable") <= F.col("budget")))
    )
    return joined.withColumn("trusted", F.coalesce(trusted, F.lit(False)))


def same_shop(baskets: DataFrame) -> DataFrame:
    """1 for a platform voucher; any unknown shop gives 0; else one shop."""
    one = (F.col("n_missing") == 0) & (F.col("shop_min") == F.col("shop_max"))
    return baskets.withColumn(
        "same_shop",
        F.when(F.col("voucher_type") == "platform", 1).when(F.coalesce(one, F.lit(False)), 1).otherwise(0),
    )


def count_penalty(recommended: Column, expected: Column) -> Column:
    """0.08 per product too many or too few, at most 0.24; 0 when a side is empty."""
    return F.when((recommended <= 0) | (expected <= 0), 0.0).otherwise(
        F.least(F.lit(0.24), 0.08 * F.abs(recommended - expected))
    )


def budget_report(baskets: DataFrame, *, by: list[str]) -> DataFrame:
    """Rates per group after ``within_budget``."""
    return baskets.groupBy(*by).agg(
        F.count("*").alias("n_baskets"),
        F.round(F.avg(F.col("voucher_used").cast("int")), 6).alias("voucher_rate"),
        F.round(F.avg("within_budget"), 6).alias("budget_rate"),
        F.round(F.avg("payable"), 4).alias("mean_payable"),
    )
