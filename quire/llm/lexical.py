"""Ranked lexical search over term-bucketed postings.

The postings are a DataFrame with a row for each distinct term of a document: (bucket, term, id, row, n, tf), bucket being a hash of the term, and in
bucket -1 one row for each document with its number of terms. Saved by ``save`` with a folder for each bucket, a search reads the buckets of its terms alone. The items' terms,
each with its weight, are joined to the postings by bucket and term, every match is scored in integers, the scores are summed by item and document, and
a window keeps each item's best.

Where the items' terms take up to ``BROADCAST_BYTES`` (counted first), they are broadcast, and the matching postings are dealt by document before they are matched: a
document's matches meet where they arise and only each task's best rows travel further, so a term that every document holds costs its postings, not its matches, in shuffles. Beyond,
postings and terms are shuffled by term, with a lane that splits a hot term. Both ways give the same rows.

Every row of the documents is a document, whether or not its id is repeated; rows of one item id are one item with the terms of all its
texts, null being an id. Texts without a term and null texts count for nothing. Equal scores are ordered by id, nulls first. Of the documents id and text are read,
of the items the same, so other columns do not matter. An empty table on either side gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import map_texts, written

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BUCKETS, BROADCAST_BYTES, LANES = 8, 32 << 20, 16
#: Postings of a task that sums scores.
TASK_POSTINGS = 500_000
POSTING = ["bucket", "term", "id", "row", "n", "tf"]


def _terms(utf8: bytes, _: str = "") -> tuple[int, list[str | None], list[int]]:
    """(terms with repeats, distinct terms after a null, their counts after one)."""
    found = Counter(_TERM.findall(utf8.lower()))
    return sum(found.values()), [None, *(t.decode("utf-8") for t in found)], [1, *found.values()]


def _bucket(term: Column) -> Column:
    return F.when(term.isNull(), -1).otherwise(F.pmod(F.xxhash64(term), F.lit(BUCKETS))).cast("int")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (item, term), once each."""
    listed = map_texts(items, {"item": F.col(id_col)}, F.col(text_col), lambda utf8, _: (_terms(utf8)[1][1:],), [("terms", "array<string>", pa.list_(pa.string()))])
    return listed.select("item", F.explode("terms").alias("term")).distinct()


def _small(terms: DataFrame, limit: int) -> bool:
    """Whether rows (…, term), with some bytes for what else is in them, keep below the limit."""
    return (terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0) <= limit


def postings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: DataFrame | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The postings (bucket, term, id, row, n, tf) of all documents and, with a null term, the documents themselves.

    only: a table with a column term; postings of other terms are left out where it is small enough to be broadcast.
    """
    fields = [("n", "long", pa.int64()), ("terms", "array<string>", pa.list_(pa.string())), ("tfs", "array<bigint>", pa.list_(pa.int64()))]
    listed = map_texts(df, {"id": F.col(id_col), "row": F.monotonically_increasing_id()}, F.col(text_col), _terms, fields).where("n > 0")
    rows = listed.select("id", "row", "n", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))
    if only is not None and _small(only.select("term").distinct(), broadcast_bytes):
        wanted = only.select("term").distinct().withColumn("wanted", F.lit(True))
        rows = rows.join(F.broadcast(wanted), "term", "left").where("term IS NULL OR wanted")
    return rows.select(_bucket(F.col("term")).alias("bucket"), "term", "id", "row", "n", "tf")


def save(index: DataFrame, path: str) -> None:
    """The postings as a table with a folder for each bucket, for searches to come."""
    index.write.partitionBy("bucket").parquet(path)


def search(index: DataFrame, terms: DataFrame, top: int = 50, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (item, rank, id, score): each item's ``top`` best documents, those with a score above 0.

    index: what ``postings`` gives, written or saved; terms: rows (item, term).
    """
    n_docs, n_terms = index.where("bucket = -1").agg(F.count("*"), F.sum("n")).first()
    held = written(index.where("bucket >= 0").groupBy("bucket", "term").agg(F.count("*").alias("df")))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    # A term of weight 0 adds nothing.
    weighed = terms.withColumn("bucket", _bucket(F.col("term"))).join(held, ["bucket", "term"]).select("bucket", "term", "item", weight.alias("w")).where("w > 0")
    found = index.where("bucket >= 0")
    if _small(weighed, broadcast_bytes):
        tasks = -(-(held.agg(F.sum("df")).first()[0] or 0) // TASK_POSTINGS)
        tasks = min(max(tasks, index.sparkSession.sparkContext.defaultParallelism), 50_000)
        matched = found.repartition(tasks, "row").join(F.broadcast(weighed), ["bucket", "term"])
    else:
        lane = F.pmod("row", F.lit(LANES)).cast("int")
        matched = found.withColumn("lane", lane).join(weighed.withColumn("lane", F.explode(F.array(*map(F.lit, range(LANES))))), ["bucket", "term", "lane"])
    matched = matched.withColumn("m", F.expr(f"100 - 50 + (50 * n * {n_docs}L) div {max(n_terms or 0, 1)}L"))
    scored = matched.groupBy("item", "row", "id").agg(F.sum(F.expr("w * ((1000000000 * tf) div (1000 * tf + 20 * m))")).alias("score")).where("score > 0")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("id"), F.asc("row"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("item", "rank", "id", "score")


def ranked(docs: DataFrame, items: DataFrame, top: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (item, rank, id, score) under the names of the two id columns: all documents ranked for each item."""
    terms = written(item_terms(items, item_col, text_col))
    index = written(postings(docs, id_col, text_col, terms, broadcast_bytes))
    return search(index, terms, top, broadcast_bytes).withColumnsRenamed({"item": item_col, "id": id_col})


ORACLE = r"""
WITH listed AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), docs AS (
  SELECT doc_id, terms, len(terms) AS n FROM listed WHERE len(terms) > 0
), total AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), held AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, n, term
), weighed AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, total GROUP BY term, n_docs
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM wanted JOIN held USING (term) JOIN weighed USING (term), total GROUP BY item_id, doc_id
), placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
"""
