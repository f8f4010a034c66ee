"""Registered queries of the training-data operators, with their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlight.llm import byte_bpe, chat_format, lm_scoring, mixing, piece_bpe, quality_classifier, quality_rules, simhash_golay, spelling, token_files, topk_search, url_filter, whitening

#: Target shares of characters: named sources, and all others together.
TARGETS = {"src0": 0.2, "src1": 0.1, "src2": 0.05, "src3": 0.05}
OTHER = 0.6
MIX_SEED = "mix-1"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, with the size and digest of its cleaned text."""
    judged = quality_rules.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_removed",
        F.length("clean_text").cast("bigint").alias("clean_chars"), F.sha2("clean_text", 256).alias("clean_sha256"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of every document under a network trained on all documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scoring.train_and_score(docs, keep=["doc_id"]).select("doc_id", "n_words", "log_probability", "mean_log_probability")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "p_block")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), TARGETS, OTHER, seed=MIX_SEED)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, whose texts hold control strings; every figure is read back from the output."""
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    chats = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat_format.read_chats(chat_format.format_chats(chats))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def graded(labels: DataFrame) -> DataFrame:
    """Ratings of `labels` as grades: 0 toxic, 1 poor, 2 good."""
    return labels.select("doc_id", quality_classifier.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, graded(_table(spark, sf_dir, "labels")))
    return quality_classifier.classify(docs, model).select("doc_id", "expected_grade", "p_tail", "kept")


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_golay.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = byte_bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode_ids(F.col("ids"), RANKS)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(_table(spark, sf_dir, "documents"), WORD_TOKENIZER)
    return token_files.read_token_files(manifest, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = piece_bpe.encode_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)
    decoded = piece_bpe.decode_ids(encoded.select("doc_id", "n_tokens", "ids"), PIECES)
    return decoded.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("bigint"))


OPERATORS = (
    op1_quality_rules, op2_lm_scoring, op3_url_filter, op4_source_mixing, op5_chat_format, op6_quality_classifier, op7_simhash_golay, op8_byte_bpe, op9_topk_search,
    op10_token_files, op11_sentencepiece, op12_spelling_variants, op13_embedding_whitening,
)
QUERIES = {f.__name__: f for f in OPERATORS}

_named = ", ".join(f"('{s}', {w})" for s, w in TARGETS.items())

OP4 = f"""
WITH weights(g, weight) AS (VALUES {_named}, (NULL, {OTHER})),
keyed AS (
  SELECT *, coalesce(doc_id::VARCHAR, 'null') || CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1
    THEN '#' || row_number() OVER (PARTITION BY doc_id ORDER BY text NULLS FIRST, lang NULLS FIRST, source NULLS FIRST, n_chars NULLS FIRST) ELSE '' END AS row_key,
    CASE WHEN source IN ({", ".join(f"'{s}'" for s in TARGETS)}) THEN source END AS g FROM documents),
sizes AS (SELECT g, sum(coalesce(length(text), 0) + 1)::DOUBLE AS size FROM keyed GROUP BY g),
means AS (
  SELECT s.g, w.weight / sum(w.weight) OVER () * sum(s.size) OVER () / s.size AS mean
  FROM sizes s JOIN weights w ON s.g IS NOT DISTINCT FROM w.g),
split AS (SELECT g, greatest(1, ceil(mean / 16.0))::BIGINT AS parts, mean / greatest(1, ceil(mean / 16.0)) AS each FROM means),
steps AS (
  SELECT g, k, sum(exp(k * ln(each) - each - lgamma(k + 1))) OVER (PARTITION BY g ORDER BY k) AS below
  FROM split, (SELECT unnest(range(0, 200)) AS k)),
drawn AS (
  SELECT d.row_key, d.g, j,
    ('0x' || substr(md5('{MIX_SEED}:' || d.row_key || ':' || j), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM (SELECT k.*, unnest(range(1, s.parts + 1)) AS j FROM keyed k JOIN split s ON k.g IS NOT DISTINCT FROM s.g) d),
counted AS (
  SELECT d.row_key, count(s.k) AS copies FROM drawn d LEFT JOIN steps s ON d.g IS NOT DISTINCT FROM s.g AND s.below <= d.u GROUP BY d.row_key)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.copy::INTEGER AS copy,
  md5('{MIX_SEED}-order:' || d.row_key || ':' || c.copy) AS shuffle_key
FROM keyed d JOIN (SELECT row_key, unnest(range(1, copies + 1)) AS copy FROM counted) c ON d.row_key = c.row_key
"""

_escaped = r"regexp_replace({0}, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')"

OP5 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM turns),
sized AS (
  SELECT *, length({_escaped.format("text")}) + CASE WHEN before = role THEN {len(chat_format.NEXT)}
    ELSE {len(chat_format.START) + len(chat_format.SEP) + len(chat_format.END)} + length({_escaped.format("role")}) END AS chars
  FROM marked)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLES = {"op4_source_mixing": OP4, "op5_chat_format": OP5, "op9_topk_search": OP9}
