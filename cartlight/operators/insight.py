"""Dataset and trajectory reports (Q family)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlight.functions.stats import quantiles
from cartlight.operators.catalog import category_level1

MAX_FIELDS = 25


def summary(df: DataFrame, values: list[str]) -> DataFrame:
    """min, max, mean and upper median per column, by counts of distinct values."""
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("x")) for v in values])).alias("_m")
    ).select("_m.*")
    stats = long.groupBy("metric").agg(
        F.count("x").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean")
    )
    medians = quantiles(long, "x", [0.5], by=("metric",), rule="upper_median").select("metric", F.col("value").alias("median"))
    return stats.join(medians, "metric")


def shares(df: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Count and share per bucket of each dimension; null buckets are left out.

    Two aggregations: the buckets, then their totals (one row per dimension).
    """
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), c.cast("string").alias("bucket")) for d, c in dimensions.items()])
    counts = (
        df.select(F.explode(cells).alias("c"))
        .select("c.*")
        .filter("bucket is not null")
        .groupBy("dimension", "bucket")
        .agg(F.count("*").alias("n"))
    )
    totals = counts.groupBy("dimension").agg(F.sum("n").alias("_t"))
    return counts.join(totals, "dimension").select("dimension", "bucket", "n", (F.col("n") / F.col("_t")).alias("share"))


def query_insight(queries: DataFrame, lines: DataFrame) -> DataFrame:
    """Distributions of basket size, level-1 category, field count and price mode.

    ``queries``: product_count; ``lines``: category, n_fields, price_mode.
    """
    a = shares(queries, {"product_count": F.col("product_count")})
    b = shares(
        lines,
        {
            "category": category_level1(F.col("category")),
            "n_fields": F.col("n_fields"),
            "price_mode": F.coalesce("price_mode", F.lit("no")),
        },
    )
    return a.unionByName(b)


def catalog_insight(products: DataFrame, *, approximate: bool = False) -> DataFrame:
    """Distinct products and (key, value) fields of a catalogue.

    Distinct counts go through a grouped aggregation (or a sketch), so no set
    is held in one place.
    """
    fields = catalog_fields(products)
    if approximate:
        n_fields = fields.agg(F.approx_count_distinct(F.struct("k", "v")).alias("unique_fields"))
        n_products = products.agg(F.approx_count_distinct("product_id").alias("unique_products"))
    else:
        n_fields = fields.select("k", "v").distinct().agg(F.count("*").alias("unique_fields"))
        n_products = products.select("product_id").distinct().agg(F.count("*").alias("unique_products"))
    return n_products.withColumn("unique_fields", n_fields.scalar())


def catalog_fields(products: DataFrame) -> DataFrame:
    """``product_id, k, v`` of attributes, services (key null) and SKU options."""
    attr = products.select("product_id", F.explode("attributes").alias("k", "vs")).select("product_id", "k", F.explode("vs").alias("v"))
    sku = products.select("product_id", F.explode(F.map_values("sku_options")).alias("o")).select("product_id", F.explode("o").alias("k", "v"))
    service = products.select("product_id", F.lit(None).cast("string").alias("k"), F.explode("service").alias("v"))
    return attr.unionByName(sku).unionByName(service)


def field_count_distribution(products: DataFrame) -> DataFrame:
    """Products per number of fields, capped at 25; counted inside each row."""
    attrs = F.aggregate(F.map_values("attributes"), F.lit(0), lambda acc, v: acc + F.size(v))
    skus = F.aggregate(F.map_values("sku_options"), F.lit(0), lambda acc, o: acc + F.size(o))
    n = F.least(attrs + skus + F.size("service"), F.lit(MAX_FIELDS))
    return shares(products, {"n_fields": n})


def rollout_counts(calls: DataFrame, *, by: str = "traj_id") -> DataFrame:
    """Steps, distinct queries, page turns, in-shop searches, views and web searches per trajectory."""
    name = F.col("name")
    find = name == "find_product"
    digits = F.coalesce(F.col("shop_param").rlike(r"^[0-9]+$"), F.lit(False))
    page = F.coalesce(F.col("page").try_cast("int"), F.lit(1))
    per_step = calls.groupBy(by, "step", F.when(find, F.col("q")).alias("q")).agg(
        F.count_if(find & (page > 1)).alias("page_turns"),
        F.count_if(find & digits).alias("in_shop"),
        F.count_if(name == "view_product_information").alias("views"),
        F.count_if(name == "web_search").alias("web"),
    )
    sums = per_step.groupBy(by).agg(
        F.sum("page_turns").alias("page_turns"),
        F.sum("in_shop").alias("in_shop_searches"),
        F.sum("views").alias("views"),
        F.sum("web").alias("web_searches"),
    )
    steps = per_step.select(by, "step").distinct().groupBy(by).agg(F.count("*").alias("steps"))
    queries = per_step.filter("q is not null and q <> ''").select(by, "q").distinct().groupBy(by).agg(F.count("*").alias("queries"))
    return sums.join(steps, by).join(queries, by, "left").withColumn("queries", F.coalesce("queries", F.lit(0)))


def model_pivot(metrics: DataFrame, *, metric: str = "metric", model: str = "model", value: str = "value", models: list[str] | None = None) -> DataFrame:
    """Metric by model table."""
    return metrics.groupBy(metric).pivot(model, models).agg(F.first(value))


def context_audit(steps: DataFrame, limits: dict[str, int], *, id_columns: list[str], by: list[str] = ()) -> DataFrame:
    """Per measure: limit, maximum and where it is, failures, and whether all steps pass."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("measure"), F.col(c).cast("bigint").alias("tokens"), F.lit(n).alias("limit")) for c, n in limits.items()]
    )
    long = steps.select(*by, *id_columns, F.explode(cells).alias("m")).select(*by, *id_columns, "m.*")
    # the first of equal maxima: ids are compared the other way round
    at = F.max_by(F.struct(*id_columns), F.struct("tokens", *[(-F.col(c)).alias(f"_{c}") for c in id_columns]))
    return long.groupBy(*by, "measure", "limit").agg(
        F.max("tokens").alias("max_tokens"),
        at.alias("_at"),
        F.count_if(F.col("tokens") > F.col("limit")).alias("failures"),
    ).select(*by, "measure", "limit", "max_tokens", *[F.col(f"_at.{c}").alias(f"max_{c}") for c in id_columns], "failures", (F.col("failures") == 0).alias("passes"))


def quality_ratios(trajectories: DataFrame, *, by: list[str] = ()) -> DataFrame:
    """Share of trajectories with empty text, null results, no terminate call."""
    return trajectories.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.col("has_empty").cast("int")).alias("empty_ratio"),
        F.avg(F.col("has_null_result").cast("int")).alias("null_result_ratio"),
        F.avg((~F.col("has_terminate")).cast("int")).alias("unterminated_ratio"),
    )
