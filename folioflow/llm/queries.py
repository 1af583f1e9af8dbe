"""The queries op1 to op13 over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from ._shared import shared_dir, table

WORD = r"[^\x20\x09-\x0D]+"


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.verdicts(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with a cache that starts empty, so that the query's cost is that of a cold cache."""
    import public_tokenizers

    from . import tokens

    counted = tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}", public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    every = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(every))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm.score(docs, docs.where(~lm.held_out(F.col("doc_id"))).select("text"))
    return scored.select("doc_id", lm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = lambda c: F.coalesce(F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    model = langid.fit(langid.sample(docs.where(~held("doc_id"))))
    return langid.predict(docs, model).select("doc_id", held("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring

    return substring.removed(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True).withColumnRenamed("kept_text", "kept_sha256")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), into="found")
    base = F.filter("found", lambda s: s["kind"].isin(*[k.name for k in pii.KINDS if k.base]))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(pii.span_list(base), 256).alias("base_sha256"), pii.span_list(F.col("found")).alias("spans"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.plan(mixing.sizes_of(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import manifest

    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", oracles.UPPER, oracles.LOWER)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, manifest.leaf_of(*[lowered if c == "text" else F.col(c) for c in fields]))
    return manifest.manifest(table(spark, sf_dir, "documents"), fields, "lang", "doc_id", seen=tampered, as_digest=True).withColumnRenamed("proof", "proof_sha256")


OP2_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\\', '')) + (length(text) - length(replace(text, '<turn ', ''))) // 6 + (length(text) - length(replace(text, '</turn>', ''))) // 7
    + length(role) + length(role) - length(regexp_replace(role, '[<>\\\\\\n]', '', 'g')) + 17 AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  cast(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_chat_formatting, op3_lm_scoring, op4_language_id, op5_substring_dedup, op6_pii, op7_decontamination, op8_quality_rules, op9_mixing, op10_ngram_jaccard, op11_exact_topk, op12_hard_negatives, op13_merkle_manifest)}
ORACLES: dict[str, str] = {"op2_chat_formatting": OP2_SQL, "op5_substring_dedup": oracles.OP5, "op7_decontamination": oracles.OP7, "op8_quality_rules": oracles.OP8, "op9_mixing": oracles.OP9, "op11_exact_topk": oracles.OP11, "op12_hard_negatives": oracles.OP12, "op13_merkle_manifest": oracles.OP13}
