"""The queries of this subpackage, one for each operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import audit, byte_bpe, chat, decontaminate, lexical, licenses, packing, pii, quality, sharding, simhash, substrings, token_counts
from quire.llm.common import spread, table

BPE_FILE, PIECE_FILE, PACK_FILE = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model", "byte_bpe_50k.json"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path(PIECE_FILE), limit=4096)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.detect(documents(spark, sf_dir))

    def digest(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(count, pii.BASE_KINDS), F.sha2(digest("base"), 256).alias("base_sha256"), digest("spans").alias("spans"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), [1.0] * 24).withColumn("law", F.lit("key"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.replay(audit.failures(documents(spark, sf_dir), table(spark, sf_dir, "labels")))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(PACK_FILE))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_byte_bpe, op2_substrings, op3_quality, op4_decontaminate, op5_token_counts, op6_chat, op7_simhash, op8_pii, op9_licenses, op10_sharding, op11_filter_audit, op12_packing, op13_search)}


def oracle_sql() -> dict[str, str]:
    return {"op2_substrings": substrings.ORACLE, "op4_decontaminate": decontaminate.ORACLE, "op6_chat": chat.ORACLE, "op9_licenses": licenses.ORACLE, "op10_sharding": sharding.oracle(24), "op11_filter_audit": audit.ORACLE, "op13_search": lexical.ORACLE}
