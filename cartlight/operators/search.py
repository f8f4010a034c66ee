"""Ranked catalogue search over tables of queries (C family).

The ranking is text-match scoring (BM25) as joins and aggregates: terms of
the corpus meet terms of the queries in an equi-join, scores add up per
(query, document), and a rank limit keeps the best k before the last shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlight.functions.ranking import is_small, top_k
from cartlight.functions.text import normalize_space, tokens
from cartlight.functions.vectors import dot, unit_vector

# fixed values: paging and capacity of the search sandbox
PAGE_SIZE, MAX_PAGE, CAPACITY = 10, 5, 5000
# fixed values: services a search may ask for
SERVICES = ["official", "freeShipping", "COD", "flashsale"]
# fixed values: projections of a search row and of a detail row
SEARCH_FIELDS = ["product_id", "shop_id", "title", "price", "service", "sold_count"]
DETAIL_FIELDS = ["product_id", "short_description", "description", "sku_options", "attributes"]
# fixed values: search parameters that a signature looks at
SEARCH_PARAMETERS = ["q", "page", "shop_id", "price", "sort", "service"]
OPTIONAL_FILTERS = ["shop_id", "price", "sort", "service"]


#: Pairs of a query and a document that one task may score.
TASK_PAIRS = 500_000


def postings(
    corpus: DataFrame, *, id_col: str = "id", text_col: str = "contents", terms: DataFrame | None = None, partitions: int | None = None
) -> DataFrame:
    """``term, id, tf, dl`` rows; with ``terms`` only those terms are kept, in ``partitions`` pieces if given.

    The semi-join comes first, so terms no query asks for never reach a
    shuffle. Rows are partitioned by document, which the count by
    (term, document) and later sums per document reuse.
    """
    words = corpus.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("words"))
    rows = words.select("id", F.size("words").alias("dl"), F.explode("words").alias("term"))
    if terms is not None:
        rows = rows.join(terms, "term", "left_semi")
    dealt = rows.repartition(partitions, "id") if partitions else rows.repartition("id")
    return dealt.groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def bm25_topk(
    queries: DataFrame,
    corpus: DataFrame,
    *,
    k: int = CAPACITY,
    query_id: str = "query_id",
    query_text: str = "q",
    id_col: str = "id",
    text_col: str = "contents",
    k1: float = 0.9,
    b: float = 0.4,
) -> DataFrame:
    """Best k documents per query: ``query_id, id, score, rank``."""
    qterms = (
        queries.select(query_id, F.explode(tokens(F.col(query_text))).alias("term"))
        .groupBy(query_id, "term")
        .agg(F.count("*").alias("qtf"))
    )
    # few query terms: they are sent to the documents, and the sums per
    # (query, document) stay where the document is; else terms meet in a shuffle
    small = is_small(qterms)
    asked = qterms.select("term").distinct()
    partitions = None
    if small:
        # scores are summed where the documents are: pieces by what they may open to, as the short rows that come in tell nothing of it
        n_pairs = queries.count() * corpus.count()
        partitions = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_pairs // TASK_PAIRS))
    post = postings(corpus, id_col=id_col, text_col=text_col, terms=F.broadcast(asked) if small else asked, partitions=partitions)
    lengths = corpus.select(F.size(tokens(F.col(text_col))).alias("dl"))
    # one pass for both numbers; they are read as a scalar subquery
    stats = lengths.agg(F.struct(F.count("*").alias("n"), F.avg("dl").alias("dl"))).scalar()
    n_docs, mean_dl = stats["n"], stats["dl"]
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    weighted = qterms.join(df, "term")
    if small:
        weighted = F.broadcast(weighted)
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / mean_dl))
    scored = (
        post.join(weighted, "term")
        .groupBy(query_id, "id")
        .agg(F.round(F.sum(F.col("qtf") * idf * gain), 6).alias("score"))
    )
    return top_k(scored, [query_id], [F.desc("score"), F.asc("id")], k, name="rank")


def price_bounds(price: Column) -> tuple[Column, Column]:
    """(low, high) of "lo-hi"; a side may be open; anything else is no bound."""
    parts = F.split(price, "-", -1)
    ok = F.size(parts) == 2
    return (
        F.when(ok, F.get(parts, F.lit(0)).try_cast("double")),
        F.when(ok, F.get(parts, F.lit(1)).try_cast("double")),
    )


def price_ok(product_price: Column, asked: Column) -> Column:
    low, high = price_bounds(asked)
    return (low.isNull() | (product_price >= low)) & (high.isNull() | (product_price <= high))


def asked_services(service: Column) -> Column:
    """Distinct known services of a comma list."""
    known = F.array(*[F.lit(s) for s in SERVICES])
    return F.array_intersect(F.split(F.coalesce(service, F.lit("")), ",", -1), known)


def service_ok(product_service: Column, asked: Column) -> Column:
    """The product has every asked service."""
    return F.size(F.array_except(asked_services(asked), product_service)) == 0


def shop_ok(product_shop: Column, asked: Column) -> Column:
    no_shop = asked.isNull() | (asked == "")
    return no_shop | F.coalesce(product_shop == asked, F.lit(False))


def page_number(page: Column) -> Column:
    """1..5, or null for anything else."""
    number = F.when(page.rlike("^[0-9]+$"), page.try_cast("int"))
    return F.when(number.between(1, MAX_PAGE), number)


def sort_key(sort: Column) -> list[Column]:
    """Order of a result list; ties and no sort fall back to the rank."""
    return [
        F.when(sort == "order", -F.col("sold_count").cast("double"))
        .when(sort == "priceasc", F.col("price_value"))
        .when(sort == "pricedesc", -F.col("price_value"))
        .otherwise(F.lit(0.0)),
        F.col("rank"),
    ]


def search(
    requests: DataFrame,
    products: DataFrame,
    *,
    text_col: str = "contents",
    capacity: int = CAPACITY,
    paged: bool = True,
) -> DataFrame:
    """Answer every request: rank, filter, keep 50, sort, take the page.

    ``requests`` has ``q, page, shop_id, price, sort, service`` strings. Equal
    requests are answered once. Output: the request columns, ``position`` in
    the sorted list (from 1) and the product's search fields.
    """
    asked = requests.select(*SEARCH_PARAMETERS).distinct()
    if paged:
        asked = asked.filter(page_number(F.col("page")).isNotNull())
    texts = asked.select("q").distinct()
    ranked = bm25_topk(
        texts, products, k=capacity, query_id="q", query_text="q", id_col="product_id", text_col=text_col
    )
    hits = ranked.join(
        products.select(
            F.col("product_id").alias("id"),
            F.col("shop_id").alias("product_shop"),
            F.col("price").alias("price_value"),
            F.col("service").alias("product_service"),
            "title",
            "sold_count",
        ),
        "id",
    )
    joined = asked.join(hits, "q").filter(
        shop_ok(F.col("product_shop"), F.col("shop_id"))
        & price_ok(F.col("price_value"), F.col("price"))
        & service_ok(F.col("product_service"), F.col("service"))
    )
    kept = top_k(joined, SEARCH_PARAMETERS, [F.col("rank")], MAX_PAGE * PAGE_SIZE)
    order = Window.partitionBy(*SEARCH_PARAMETERS).orderBy(*sort_key(F.col("sort")))
    placed = kept.withColumn("position", F.row_number().over(order))
    if not paged:
        return placed
    page = page_number(F.col("page"))
    return placed.filter(
        (F.col("position") > (page - 1) * PAGE_SIZE) & (F.col("position") <= page * PAGE_SIZE)
    )


def project_fields(products: DataFrame, *, detail: bool = False) -> DataFrame:
    wanted = DETAIL_FIELDS if detail else SEARCH_FIELDS
    return products.select(*[c for c in wanted if c in products.columns])


def lookup_products(calls: DataFrame, products: DataFrame, *, ids: str = "product_ids") -> DataFrame:
    """One row per known id of a comma list, ``pos`` keeps the asked order."""
    asked = calls.select("*", F.posexplode(F.split(F.col(ids), ",")).alias("pos", "product_id"))
    return asked.join(products, "product_id")


def product_cache(needed: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(products that a query set needs, needed ids without a product)."""
    ids = needed.select("product_id").distinct()
    return products.join(ids, "product_id", "left_semi"), ids.join(products, "product_id", "left_anti")


def search_variants(requests: DataFrame) -> DataFrame:
    """Original, next page, each optional filter dropped, all dropped."""

    def given(c: str) -> Column:
        return F.col(c).isNotNull() & (F.col(c) != "")

    def variant(name: str, when: Column, drop: list[str] = (), page: Column | None = None) -> Column:
        fields = []
        for c in SEARCH_PARAMETERS:
            value = F.lit(None).cast("string") if c in drop else F.col(c)
            if c == "page" and page is not None:
                value = page
            fields.append(value.alias(c))
        return F.when(when, F.struct(F.lit(name).alias("variant"), *fields))

    page = F.coalesce(F.col("page").try_cast("int"), F.lit(1))
    options = [
        variant("original", F.lit(True)),
        variant("next_page", page >= 1, page=(page + 1).cast("string")),
        *[variant(f"drop_{c}", given(c), [c]) for c in OPTIONAL_FILTERS],
        variant(
            "drop_all_optional_filters",
            given("shop_id") | given("price") | given("sort") | given("service"),
            OPTIONAL_FILTERS,
        ),
    ]
    rest = [c for c in requests.columns if c not in SEARCH_PARAMETERS]
    exploded = requests.select(*rest, F.explode(F.filter(F.array(*options), lambda v: v.isNotNull())).alias("v"))
    return exploded.select(*rest, "v.*")


def ablation_recovery(requests: DataFrame, products: DataFrame, missing: DataFrame, *, key: str) -> DataFrame:
    """Missing wanted products each variant finds: ``key, variant, product_id``.

    ``requests``: key and search parameters; ``missing``: key, product_id.
    """
    variants = search_variants(requests)
    answers = search(variants, products)
    same = [F.col(f"v.{c}").eqNullSafe(F.col(f"a.{c}")) for c in SEARCH_PARAMETERS]
    found = variants.alias("v").join(answers.alias("a"), same).select(
        F.col(f"v.{key}").alias(key), "v.variant", F.col("a.id").alias("product_id")
    )
    return found.join(missing, [key, "product_id"], "left_semi").distinct()


def semantic_match(
    pairs: DataFrame, vectors: DataFrame, *, left: str, right: str, threshold: float = 0.5
) -> DataFrame:
    """Cosine of each distinct pair of texts by their stored vectors.

    Only distinct pairs are scored, and each vector is fetched by key.
    """
    distinct = pairs.select(left, right).distinct()
    # unit length once per text, so a pair costs one product
    unit = vectors.select("text_id", unit_vector(F.col("embedding")).alias("_u"))
    a = unit.select(F.col("text_id").alias(left), F.col("_u").alias("_a"))
    b = unit.select(F.col("text_id").alias(right), F.col("_u").alias("_b"))
    scored = distinct.join(a, left).join(b, right).withColumn("similarity", dot(F.col("_a"), F.col("_b")))
    return scored.drop("_a", "_b").withColumn("matched", (F.col("similarity") >= threshold).cast("int"))


def search_signature(df: DataFrame, *, parameters: list[str] = SEARCH_PARAMETERS) -> Column:
    """Canonical JSON of the given, non-default parameters, keys sorted."""
    entries = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(c).isNotNull() & ~F.col(c).isin("", "default"),
                    F.struct(F.lit(c).alias("key"), F.lower(F.trim(F.col(c))).alias("value")),
                )
                for c in sorted(parameters)
                if c in df.columns
            ]
        )
    )
    return F.to_json(F.map_from_entries(entries))


def repeated_searches(df: DataFrame, *, by: str) -> DataFrame:
    """Per trajectory: searches, distinct searches, searches asked more than once."""
    counted = df.withColumn("signature", search_signature(df)).groupBy(by, "signature").agg(F.count("*").alias("n"))
    return counted.groupBy(by).agg(
        F.sum("n").alias("total_searches"),
        F.count("*").alias("unique_searches"),
        F.count_if(F.col("n") > 1).alias("repeated_searches"),
    )


def keyword_match(keyword: Column, *texts: Column) -> Column:
    """1 when the keyword occurs in any text, without case."""
    hits = [F.coalesce(F.contains(F.lower(t), F.lower(keyword)), F.lit(False)).cast("int") for t in texts]
    return F.greatest(*hits) if len(hits) > 1 else hits[0]


def query_expansion(df: DataFrame, *, title: str, values: str) -> DataFrame:
    """Candidate queries of a product, cleaned and distinct: one row each with ``pos``."""
    words = F.split(normalize_space(F.col(title)), " ")
    n_words, given = F.size(words), F.size(values) > 0

    def joined(x: Column) -> Column:
        return F.array_join(x, " ")

    options = [F.col(title)]
    options += [F.when(n_words >= n, joined(F.slice(words, 1, n))) for n in (12, 8, 5, 3)]
    options.append(F.when(given, joined(F.concat(F.slice(words, 1, 5), F.slice(values, 1, 5)))))
    options.append(F.when(given, joined(F.slice(values, 1, 6))))
    cleaned = F.transform(F.array_compact(F.array(*options)), normalize_space)
    distinct = F.array_distinct(F.filter(cleaned, lambda c: c != ""))
    return df.select("*", F.posexplode(distinct).alias("pos", "candidate"))


def overlap_rank(df: DataFrame, *, key: list[str], segments: str, title: str, values: str, k: int = 4) -> DataFrame:
    """Best k segments by words shared with the title plus twice those shared with the values."""
    rows = df.select(*key, title, values, F.posexplode(segments).alias("pos", "segment")).filter(
        normalize_space(F.col("segment")) != ""
    )
    words = F.array_distinct(tokens(F.col("segment")))
    score = F.size(F.array_intersect(words, tokens(F.col(title)))) + 2 * F.size(
        F.array_intersect(words, tokens(F.array_join(values, " ")))
    )
    scored = rows.select(*key, "pos", "segment", score.alias("overlap"))
    return top_k(scored, key, [F.desc("overlap"), F.asc("pos")], k, name="rank")
