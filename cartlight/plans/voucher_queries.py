"""E: voucher arithmetic."""

from pyspark.sql import functions as F

from cartlight.operators import voucher as V
from cartlight.plans.registry import Tables, query, view

view("x_totals", """
select r.order_id, count(*) as n_items,
       sum(case when p.price is null or p.shop_id is null then 1 else 0 end) as n_missing,
       round(coalesce(sum(case when p.shop_id is not null then p.price end), 0.0), 2) as total,
       count(distinct case when p.price is not null then p.shop_id end) as n_shops,
       min(p.shop_id) as shop_min
from v_recommended r left join v_product p on p.product_id = r.product_id
group by r.order_id
""")

view("x_payable", """
select b.*, case when b.used then
         round(case when b.discount_type = 'fixed' then b.total - b.face_value
                    when b.total * (1 - b.discount) > b.total - b.cap then b.total * (1 - b.discount)
                    else b.total - b.cap end, 2)
       else b.total end as payable
from (select t.*, v.voucher_type, v.discount_type, v.threshold, v.face_value, v.discount, v.cap, v.budget,
             v.threshold is not null and t.total >= v.threshold
               and (v.voucher_type = 'platform' or t.n_shops = 1) as used
      from x_totals t join v_voucher v on v.order_id = t.order_id) b
""")

view("v_claim", """
select order_id, case when order_id % 7 < 5 then round(gold_total * (1 + (order_id % 8) / 100.0), 4) end as total_before_voucher,
       case when order_id % 7 = 5 then gold_total end as subtotal,
       round(gold_total * 0.8, 2) as payable_total,
       case when order_id % 3 = 0 then 'yes' when order_id % 3 = 1 then 'over' else 'unclear' end as verdict_text
from v_gold_total
""")

view("v_claim_line", """
select l.order_id, l.product_id,
       case when l.order_id % 5 = 0 then 'x' else p.shop_id end as claimed_shop
from v_basket_line l left join v_product p on p.product_id = l.product_id
""")


def priced_baskets(t: Tables):
    totals = V.basket_totals(t.v_recommended, t.v_product)
    return V.payable_total(totals.join(t.v_voucher, "order_id"))


@query("basket_totals", "select order_id, n_items, cast(n_missing as bigint) as n_missing, total, n_shops = 1 as one_shop from x_totals")
def basket_totals(t):
    out = V.basket_totals(t.v_recommended, t.v_product)
    return out.select("order_id", "n_items", "n_missing", "total",
                      F.coalesce(F.col("shop_min") == F.col("shop_max"), F.lit(False)).alias("one_shop"))


@query("payable_total", "select order_id, used as voucher_used, payable from x_payable")
def payable_total(t):
    return priced_baskets(t).select("order_id", "voucher_used", "payable")


@query("payable_null_threshold", """
select order_id, sum(used_met) as used_met, sum(used_zero) as used_zero from (
select t.order_id,
       cast(case when (v.threshold is null or t.total >= v.threshold) and (v.voucher_type = 'platform' or t.n_shops = 1)
            then 1 else 0 end as bigint) as used_met,
       cast(case when t.total >= coalesce(v.threshold, 0) and (v.voucher_type = 'platform' or (t.n_shops = 1 and t.n_missing = 0))
            then 1 else 0 end as bigint) as used_zero
from x_totals t join v_voucher v on v.order_id = t.order_id) u group by order_id
""".replace("sum(used_met)", "cast(sum(used_met) as bigint)").replace("sum(used_zero)", "cast(sum(used_zero) as bigint)"))
def payable_null_threshold(t):
    base = V.basket_totals(t.v_recommended, t.v_product).join(t.v_voucher, "order_id")
    met = V.payable_total(base, null_threshold="met").withColumn("used_met", F.col("voucher_used").cast("bigint"))
    both = V.payable_total(met, null_threshold="zero", require_all_known=True)
    return both.select("order_id", "used_met", F.col("voucher_used").cast("bigint").alias("used_zero"))


WITHIN = """
select x.order_id, case when x.n_missing = 0 and x.n_items = g.gold_count
         and (x.total <= x.budget or x.payable <= x.budget) then 1 else 0 end as within_budget
from x_payable x join v_gold_total g on g.order_id = x.order_id
"""


@query("within_budget", WITHIN)
def within_budget(t):
    base = priced_baskets(t).join(t.v_gold_total.select("order_id", "gold_count"), "order_id")
    return V.within_budget(base, expected="gold_count").select("order_id", "within_budget")


@query("discount_first_budget", """
select order_id, case when n_missing = 0 and payable <= budget then 1 else 0 end as within_budget from x_payable
""")
def discount_first_budget(t):
    return V.discount_first_budget(priced_baskets(t)).select("order_id", "within_budget")


@query("normalize_voucher", """
select order_id, voucher_type, threshold, discount_type, face_value, discount, cap, budget from v_voucher
""")
def normalize_voucher(t):
    v = t.v_voucher
    nested_row = F.col("voucher_type") == "shop"
    flat = F.when(~nested_row, F.struct("voucher_type", "threshold", "discount_type", "face_value", "discount", "cap", "budget"))
    nested = F.when(nested_row, F.struct(
        F.col("voucher_type").alias("scope"), "threshold", "budget",
        F.struct(F.col("discount_type").alias("type"), F.col("face_value").alias("value"),
                 F.col("discount").alias("rate"), "cap").alias("discount")))
    packed = v.select("order_id", flat.alias("flat"), nested.alias("nested"))
    return V.normalize_voucher(packed).select("order_id", *V.VOUCHER_COLUMNS)


@query("budget_claim_score", """
select c.order_id, round(case when coalesce(c.total_before_voucher, c.subtotal) is null or c.verdict_text = 'unclear' or x.n_missing > 0 then 0.0
  else (case when abs(coalesce(c.total_before_voucher, c.subtotal) - x.total) <= 0.05
               or abs(coalesce(c.total_before_voucher, c.subtotal) - x.total) / greatest(x.total, 1.0) <= 0.01 then 1.0
             when abs(coalesce(c.total_before_voucher, c.subtotal) - x.total) / greatest(x.total, 1.0) <= 0.05 then 0.5 else 0.0 end
      + case when abs(c.payable_total - x.payable) <= 0.05 or abs(c.payable_total - x.payable) / greatest(x.payable, 1.0) <= 0.01 then 1.0
             when abs(c.payable_total - x.payable) / greatest(x.payable, 1.0) <= 0.05 then 0.5 else 0.0 end
      + case when (c.verdict_text = 'yes') = (coalesce(x.total <= x.budget or x.payable <= x.budget, false)) then 1.0 else 0.0 end) / 3.0 end, 6) as claim_score
from v_claim c join x_payable x on x.order_id = c.order_id
""".replace("1.0", "1.0::double").replace("0.5", "0.5::double").replace("0.0 ", "0.0::double "))
def budget_claim_score(t):
    base = V.within_budget(priced_baskets(t)).join(t.v_claim, "order_id")
    scored = V.budget_claim_score(
        base, total_keys=["total_before_voucher", "subtotal"], payable_keys=["payable_total"],
        verdict_keys=["verdict_text"])
    return scored.select("order_id", F.round("claim_score", 6).alias("claim_score"))


@query("budget_claim_trusted", """
with lines as (
  select l.order_id, min(case when p.price is not null and p.shop_id = l.claimed_shop then 1 else 0 end) as ok,
         round(sum(p.price), 2) as total, count(distinct p.shop_id) as n_shops,
         sum(case when p.shop_id is null then 1 else 0 end) as n_missing
  from v_claim_line l left join v_product p on p.product_id = l.product_id group by l.order_id),
calc as (
  select x.*, v.budget, v.discount_type, v.face_value, v.discount, v.cap,
         (v.threshold is null or x.total >= v.threshold) and (v.voucher_type = 'platform' or (x.n_shops = 1 and x.n_missing = 0)) as used
  from lines x join v_voucher v on v.order_id = x.order_id),
pay as (
  select *, case when not used then total when discount_type = 'fixed' then round(total - face_value, 2)
            else round(greatest(total * (1 - discount), total - cap), 2) end as payable from calc)
select p.order_id, p.ok = 1 and abs(c.payable_total - p.payable) <= 0.01 as trusted
from pay p join v_claim c on c.order_id = p.order_id
""")
def budget_claim_trusted(t):
    totals = t.v_gold_total.select("order_id", F.col("gold_total").alias("claimed_total"))
    claims = (
        t.v_claim.select("order_id", F.col("payable_total").alias("claimed_payable"))
        .join(totals, "order_id")
        .join(t.v_voucher, "order_id")
        .withColumn("claimed_budget", F.col("budget"))
    )
    # flags are claimed as the recomputed ones would be
    one = F.lit(True)
    lines = t.v_claim_line
    probe = V.budget_claim_trusted(
        claims.withColumn("claimed_used", one).withColumn("claimed_within", one), lines, t.v_product)
    honest = probe.select("order_id", F.col("voucher_used").alias("claimed_used"),
                          (F.col("payable") <= F.col("budget")).alias("claimed_within"))
    return V.budget_claim_trusted(claims.join(honest, "order_id"), lines, t.v_product).select("order_id", "trusted")


@query("same_shop", """
select order_id, case when voucher_type = 'platform' then 1 when n_missing > 0 then 0 when n_shops = 1 then 1 else 0 end as same_shop
from x_payable
""")
def same_shop(t):
    return V.same_shop(priced_baskets(t)).select("order_id", "same_shop")


@query("count_penalty", """
select x.order_id, round(case when x.n_items = g.gold_count then 0.0 when abs(x.n_items - g.gold_count) >= 3 then 0.24
       else 0.08 * abs(x.n_items - g.gold_count) end, 6)::double as count_penalty
from x_totals x join v_gold_total g on g.order_id = x.order_id
""")
def count_penalty(t):
    base = V.basket_totals(t.v_recommended, t.v_product).join(t.v_gold_total, "order_id")
    return base.select("order_id", F.round(V.count_penalty(F.col("n_items"), F.col("gold_count")), 6).alias("count_penalty"))


@query("basket_budget_report", """
select x.voucher_type, x.discount_type, count(*) as n_baskets,
       round(avg(case when x.used then 1.0 else 0.0 end), 6) as voucher_rate,
       round(avg(w.within_budget), 6) as budget_rate, round(avg(x.payable), 4) as mean_payable
from x_payable x join (%s) w on w.order_id = x.order_id group by 1, 2
""" % WITHIN)
def basket_budget_report(t):
    base = priced_baskets(t).join(t.v_gold_total.select("order_id", "gold_count"), "order_id")
    return V.budget_report(V.within_budget(base, expected="gold_count"), by=["voucher_type", "discount_type"])
