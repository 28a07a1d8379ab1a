"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before kept. All but the last return the columns of documents. Ids
identify documents; rows that repeat one are taken as repeats of the same document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import byte_bpe, decontaminate, pii, quality, simhash
from quire.llm.common import table
from quire.llm.registry import BPE_FILE, documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    return simhash.keep_one(docs, similarity=0.8, k=5)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage: no window of 13 words of an item, however long the document."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), share=0.0)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars counts the new text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids binary, round_trip): ids as little-endian unsigned 32-bit integers."""
    return byte_bpe.encode_checked(docs, public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: The stages hold iterative fits and tokenizer merges that SQL does not express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
