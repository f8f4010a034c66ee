"""Catalogue cleaning (B family).

Raw feed rows carry packed attribute strings: parts are joined by the control
characters 1, 2 and 3. All cleaning is per row on small arrays; only the
long-tail cut needs counts over the whole catalogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlight.functions.text import unescape_html, unescape_html_full
from cartlight.session import materialize

# fixed values: words that mean "no value", compared without case
JUNK_WORDS = [
    "nobrand",
    "no brand",
    "notbrand",
    "not brand",
    "notbranded",
    "not branded",
    "na",
    "n/a",
    "null",
    "no",
    "nospecified",
    "no specified",
    "notspecified",
    "not specified",
    "other",
    "others",
    "unknown",
    "miscellaneous",
    "new",
]

# fixed values: separators of the packed fields
S1, S2, S3 = "\u0001", "\u0002", "\u0003"
MAX_SKUS = 9
MAX_TEXT = 2000


def is_junk(x: Column) -> Column:
    return F.lower(x).isin(JUNK_WORDS)


def drop_junk_value(x: Column) -> Column:
    """Empty string for junk or null."""
    return F.when(x.isNull() | is_junk(x), "").otherwise(x)


def clean_text(x: Column, *, full: bool = False) -> Column:
    """Unescape, trim, keep the first 2000 characters (a rule of the catalogue)."""
    text = unescape_html_full(x) if full else unescape_html(x)
    return F.substring(F.trim(F.coalesce(text, F.lit(""))), 1, MAX_TEXT)


def _parts(packed: Column, outer: str, inner: str, n: int) -> Column:
    split = F.transform(F.split(F.coalesce(packed, F.lit("")), outer, -1), lambda p: F.split(p, inner, -1))
    return F.filter(split, lambda p: F.size(p) == n)


def _last_wins(entries: Column) -> Column:
    """Map from (key, value) structs: first position of a key, last value."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    return F.map_from_entries(
        F.transform(
            keys,
            lambda k: F.struct(
                k.alias("key"), F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"].alias("value")
            ),
        )
    )


def unpack_sku(packed: Column) -> Column:
    """``id 1 key 1 value`` joined by 2 -> map of 1..9 to its key/value map."""
    rows = F.transform(
        _parts(packed, S2, S1, 3),
        lambda p: F.struct(F.lower(p[0]).alias("id"), F.lower(p[1]).alias("k"), F.lower(p[2]).alias("v")),
    )
    rows = F.filter(rows, lambda r: ~is_junk(r["v"]))
    ids = F.slice(F.array_distinct(F.transform(rows, lambda r: r["id"])), 1, MAX_SKUS)
    return F.map_from_entries(
        F.transform(
            ids,
            lambda i, n: F.struct(
                (n + 1).alias("key"), _last_wins(F.filter(rows, lambda r: r["id"] == i)).alias("value")
            ),
        )
    )


def unpack_spu(packed: Column) -> Column:
    """``key 1 value`` joined by 2 -> map of key to its distinct values, sorted."""
    rows = F.transform(
        _parts(packed, S2, S1, 2), lambda p: F.struct(F.lower(p[0]).alias("k"), F.lower(p[1]).alias("v"))
    )
    rows = F.filter(rows, lambda r: ~is_junk(r["v"]))
    keys = F.array_distinct(F.transform(rows, lambda r: r["k"]))
    return F.map_from_entries(
        F.transform(
            keys,
            lambda k: F.struct(
                k.alias("key"),
                F.sort_array(
                    F.array_distinct(F.transform(F.filter(rows, lambda r: r["k"] == k), lambda r: r["v"]))
                ).alias("value"),
            ),
        )
    )


def unpack_cpv(packed: Column) -> Column:
    """``name 2 values 2 important 2 key`` joined by 3; keeps important key attributes."""
    rows = F.transform(
        _parts(packed, S3, S2, 4),
        lambda p: F.struct(
            F.lower(p[0]).alias("k"),
            F.filter(F.split(F.lower(p[1]), S1, -1), lambda v: ~is_junk(v)).alias("v"),
            ((F.lower(p[2]) == "y") & (F.lower(p[3]) == "y")).alias("keep"),
        ),
    )
    return _last_wins(F.filter(rows, lambda r: r["keep"]))


def merge_attributes(spu: Column, cpv: Column) -> Column:
    """Union of both maps; values of ``cpv`` first, no value twice."""
    empty = F.array().cast("array<string>")
    return F.map_zip_with(
        cpv, spu, lambda _, a, b: F.array_union(F.coalesce(a, empty), F.coalesce(b, empty))
    )


def clean_feed(feed: DataFrame, *, full_unescape: bool = False) -> DataFrame:
    """Raw feed rows to products with ``sku_options`` and ``attributes`` maps."""
    return feed.select(
        "product_id",
        "shop_id",
        drop_junk_value(F.col("brand_name")).alias("brand"),
        F.replace(F.col("category_hierarchy"), F.lit("-"), F.lit(" > ")).alias("category"),
        clean_text(F.col("title"), full=full_unescape).alias("title"),
        F.col("price").try_cast("double").alias("price"),
        F.col("sold_cnt").try_cast("bigint").alias("sold_count"),
        unpack_sku(F.col("sku")).alias("sku_options"),
        merge_attributes(unpack_spu(F.col("spu")), unpack_cpv(F.col("cpv"))).alias("attributes"),
    )


def catalog_casts(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows with numeric price and count, rejected rows)."""
    typed = feed.withColumns(
        {
            "price_value": F.col("price").try_cast("double"),
            "sold_value": F.col("sold_cnt").try_cast("bigint"),
        }
    )
    bad = F.col("price_value").isNull() | F.col("sold_value").isNull()
    return typed.filter(~bad), typed.filter(bad)


def _sku_entries(products: DataFrame) -> DataFrame:
    return products.select(
        "product_id", F.explode("sku_options").alias("sku_no", "options")
    ).select("product_id", "sku_no", F.explode("options").alias("k", "v"))


def attribute_frequency(products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key counts, value counts): keys count once per product attribute and once per SKU entry."""
    attrs = products.select("product_id", F.explode("attributes").alias("k", "values"))
    sku = _sku_entries(products)
    keys = attrs.select("k").unionByName(sku.select("k")).groupBy("k").agg(F.count("*").alias("n"))
    values = (
        attrs.select(F.explode("values").alias("v"))
        .unionByName(sku.select("v"))
        .groupBy("v")
        .agg(F.count("*").alias("n"))
    )
    return keys, values


def filter_longtail(products: DataFrame, *, threshold: int = 20) -> DataFrame:
    """Drop entries whose key or value is rare, empty groups, and renumber the SKUs.

    The entries are exploded and semi-joined with the frequent keys and values
    (AQE picks broadcast or shuffle by their real size), then regrouped per
    product. The cleaned catalogue is read several times, so it is written
    once: the packed fields are parsed once, and each scan takes its columns.
    """
    products = materialize(products, "products")
    keys, values = attribute_frequency(products)
    keys = keys.filter(F.col("n") >= threshold).select("k")
    values = values.filter(F.col("n") >= threshold).select("v")
    entries = products.select("product_id", F.posexplode("attributes").alias("grp", "k", "vs")).select(
        "product_id", F.lit(0).alias("kind"), "grp", "k", F.posexplode("vs").alias("pos", "v")
    )
    sku = products.select("product_id", F.explode("sku_options").alias("grp", "o")).select(
        "product_id", F.lit(1).alias("kind"), "grp", F.posexplode("o").alias("pos", "k", "v")
    )
    kept = (
        entries.unionByName(sku)
        .join(keys, "k", "left_semi")
        .join(values, "v", "left_semi")
        .groupBy("product_id")
        .agg(F.sort_array(F.collect_list(F.struct("kind", "grp", "pos", "k", "v"))).alias("rows"))
    )
    attr_rows = F.filter("rows", lambda r: r["kind"] == 0)
    attr_keys = F.array_distinct(F.transform(attr_rows, lambda r: r["k"]))
    attributes = F.map_from_entries(
        F.transform(
            attr_keys,
            lambda k: F.struct(
                k.alias("key"),
                F.transform(F.filter(attr_rows, lambda r: r["k"] == k), lambda r: r["v"]).alias("value"),
            ),
        )
    )
    sku_rows = F.filter("rows", lambda r: r["kind"] == 1)
    groups = F.array_distinct(F.transform(sku_rows, lambda r: r["grp"]))
    options = F.map_from_entries(
        F.transform(
            groups,
            lambda g, n: F.struct(
                (n + 1).alias("key"),
                F.map_from_entries(
                    F.transform(
                        F.filter(sku_rows, lambda r: r["grp"] == g),
                        lambda r: F.struct(r["k"].alias("key"), r["v"].alias("value")),
                    )
                ).alias("value"),
            ),
        )
    )
    kept = kept.select("product_id", attributes.alias("_a"), options.alias("_s"))
    none_a = F.create_map().cast("map<string,array<string>>")
    none_s = F.create_map().cast("map<int,map<string,string>>")
    return (
        products.join(kept, "product_id", "left")
        .withColumns(
            {
                "attributes": F.coalesce("_a", none_a),
                "sku_options": F.coalesce("_s", none_s),
            }
        )
        .drop("_a", "_s")
    )


def build_search_document(products: DataFrame) -> DataFrame:
    """``id, contents, product``: title, distinct SKU values, distinct attribute values."""
    sku = F.array_join(
        F.sort_array(F.array_distinct(F.flatten(F.transform(F.map_values("sku_options"), F.map_values)))), " "
    )
    attrs = F.array_join(F.sort_array(F.array_distinct(F.flatten(F.map_values("attributes")))), " ")
    return products.select(
        F.col("product_id").alias("id"),
        F.concat_ws("\n", "title", sku, attrs).alias("contents"),
        F.struct(*[F.col(c) for c in products.columns]).alias("product"),
    )


def category_level1(category: Column) -> Column:
    """Text before the first " > "; empty becomes Other."""
    head = F.trim(F.split_part(F.coalesce(category, F.lit("")), F.lit(" > "), F.lit(1)))
    return F.coalesce(F.nullif(head, F.lit("")), F.lit("Other"))
