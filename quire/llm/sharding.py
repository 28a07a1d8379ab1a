"""Weighted rendezvous sharding of stable record keys.

Every shard draws a number for every key; the largest draw, scaled by the shard's weight, gets the record. A new shard
can only win records for itself, so no record moves between old shards. The draw is the leading 52 bits of
md5(key:shard), u = (bits + 0.5) / 2**52, and the score -weight / ln(u); with equal weights the bits decide alone, the
smaller shard number on ties.

Slots are gapless from 0 within each shard without sorting a shard in one task: records of a shard are split over
``lanes`` by their key, lanes are numbered by their counts, and records by (key, crc, size) within a lane.

A null key is a key of its own; a null text has 0 bytes and the checksum of the empty text. Repeated rows share their
shard and get slots of their own. Only the key and text columns are read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES = 256


def _draw(key: Column, shard: int | str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("long")


def _score(key: Column, shard: int, weight: float, weighted: bool) -> Column:
    bits = _draw(key, shard)
    return -F.lit(float(weight)) / F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 52))) if weighted else bits


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard of a string key among ``len(weights)`` shards."""
    weighted = len(set(weights)) > 1
    best = F.array_max(F.array(*[F.struct(_score(key, k, w, weighted).alias("score"), F.lit(-k).alias("shard")) for k, w in enumerate(weights)]))
    return (-best["shard"]).cast("int")


def assign(df: DataFrame, weights: list[float], id_col: str = "doc_id", text_col: str = "text", lanes: int = LANES) -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot, grown_shard); grown_shard: where one more shard of the mean weight would leave it."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    n = len(weights)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    grown = [*weights, sum(weights) / n]
    weighted = len(set(grown)) > 1
    # One draw for each shard; the grown answer only compares the winner with the newcomer.
    best = F.array_max(F.array(*[F.struct(_score(F.col("__key"), k, w, weighted).alias("score"), F.lit(-k).alias("shard")) for k, w in enumerate(weights)]))
    keyed = df.select(
        F.col(id_col).alias("__id"),
        key.alias("__key"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    lane = F.pmod(_draw(F.col("__key"), "lane"), F.lit(lanes)).cast("int")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__best", best).withColumn("shard", (-F.col("__best")["shard"]).cast("int")).withColumn("__lane", lane)

    # The lanes' sizes need the keys alone: this side of the plan scans one narrow column.
    sizes = placed(df.select(key.alias("__key"))).groupBy("shard", "__lane").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "__lane", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))  # at most shards x lanes rows
    within = Window.partitionBy("shard", "__lane").orderBy("__key", "text_crc32", "size")
    newcomer = _score(F.col("__key"), n, grown[-1], weighted)
    rows = placed(keyed).withColumn("grown_shard", F.when(newcomer > F.col("__best")["score"], F.lit(n)).otherwise(F.col("shard")).cast("int"))
    return (
        rows.drop("__best")
        .withColumn("__row", F.row_number().over(within))
        .join(F.broadcast(starts), ["shard", "__lane"])
        .select(F.col("__id").alias(id_col), "size", "text_crc32", "shard", (F.col("__start") + F.col("__row") - 1).cast("long").alias("slot"), "grown_shard")
    )


def oracle(shards: int, lanes: int = LANES) -> str:
    """SQL of ``assign`` with equal weights."""
    draw = "CAST('0x' || substr(md5(key || ':{}'), 1, 13) AS BIGINT)"
    best = lambda n: f"list_max([{', '.join('{' + chr(39) + 's' + chr(39) + ': ' + draw.format(k) + ', ' + chr(39) + 'k' + chr(39) + f': {-k}' + '}' for k in range(n))}])"
    return f"""
WITH bits AS (SELECT range AS b FROM range(256)),
crc_table AS (
  SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, b) AS v FROM bits)
), docs AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key, coalesce(text, '') AS text FROM documents
), summed AS (
  SELECT doc_id, key, strlen(text) + 8 AS size, hex(encode(text)) AS h FROM docs
), checked AS (
  SELECT doc_id, key, size, xor(4294967295, list_reduce(list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)),
         lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), CAST(4294967295 AS BIGINT))) AS text_crc32 FROM summed, crc_table
), placed AS (
  SELECT *, -({best(shards)}).k AS shard, -({best(shards + 1)}).k AS grown, {draw.format("lane")} % {lanes} AS lane FROM checked
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY lane, key, text_crc32, size) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard FROM placed
"""
