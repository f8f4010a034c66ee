"""A corpus pipeline of five stages over `documents`.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartlight.llm import byte_bpe, mixing, near_copies, quality_classifier, quality_rules, simhash_golay
from cartlight.llm.components import connected_components
from cartlight.llm.queries import MIX_SEED, OTHER, RANKS, TARGETS, graded
from cartlight.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: SQL cannot express the stages; tests/llm checks them against brute force.
ORACLE_SQL = None


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, trained on the rated ones among ``docs``, rates good. A null text counts as empty."""
    model = quality_classifier.train(docs, graded(spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")))
    return quality_classifier.classify(docs, model).filter("kept").select(*COLUMNS)


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that failed; n_chars follows the text. Null and empty texts go."""
    judged = quality_rules.quality_rules(docs.select(*COLUMNS)).filter("kept")
    return judged.withColumn("text", F.col("clean_text")).withColumn("n_chars", F.length("clean_text").cast("bigint")).select(*COLUMNS)


def _together(groups: DataFrame, others: DataFrame) -> DataFrame:
    """(row, component): rows that one of two groupings (row, component) puts together, directly or through other rows."""
    by_name = [g.join(g.groupBy("component").agg(F.min("row").alias("name")), "component").select("row", "name") for g in (groups, others)]
    # both name a group by its smallest row, so that equal names mean groups with a row in common
    named = materialize(by_name[0].join(by_name[1].select("row", F.col("name").alias("other")), "row"), "copies-named")
    whole = connected_components(named.select(F.col("name").alias("a"), F.col("other").alias("b")))
    return named.join(whole.withColumnRenamed("node", "name"), "name", "left").select("row", F.coalesce("component", "name").alias("component"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Linked are documents whose SimHash fingerprints differ in 4 bits or fewer
    (``op7_simhash_golay``), and those whose sets of 5-word shingles have a
    Jaccard similarity of 0.8 or more. Rows without an id get a stand-in hashed
    from their text, above all real ids. Rows are told apart by id and text, so
    different texts under one id are documents of their own; of rows with the
    same id and text one stays. No text is lost where two of them have the same
    hash.
    """
    stand_in = F.lit(1 << 62) + F.xxhash64("text") % F.lit(1 << 60)
    keyed = docs.select(*COLUMNS).withColumn("group_key", F.coalesce("doc_id", stand_in)).withColumn("row", F.xxhash64("group_key", "text"))
    prints = simhash_golay.near_duplicates(keyed, id_col="row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    groups = _together(near_copies.near_copies(keyed), prints.distinct())
    ids = keyed.select("row", "group_key").distinct()
    first = ids.join(groups, "row").groupBy("component").agg(F.min(F.struct("group_key", "row")).alias("least")).select("least.row")
    order = Window.partitionBy("row", "group_key", "text").orderBy("source", "lang", "n_chars")
    kept = keyed.join(first, "row", "left_semi").withColumn("place", F.row_number().over(order))
    return kept.filter("place = 1").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in global random order."""
    return mixing.mix_sources(docs.select(*COLUMNS), TARGETS, OTHER, seed=MIX_SEED).select(*COLUMNS)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; ``exact`` tells whether decoding gives the text's bytes again."""
    encoded = byte_bpe.encode_texts(docs.select(*COLUMNS), RANKS, public_tokenizers.PATTERN)
    exact = byte_bpe.decode_ids(F.col("ids"), RANKS) == F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", exact.alias("exact"))


STAGES = [
    ("quality classifier", classifier_stage),
    ("quality rules", rules_stage),
    ("near-duplicates", dedup_stage),
    ("source mixing", mixing_stage),
    ("byte-level BPE", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written below the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
