"""Filter interaction audit: every order of a set of filters, replayed over all documents.

A document's failures are one number, a bit for each filter. Documents are crossed with the broadcast orders (five filters: 120 rows, a bound
that does not grow), each order's five steps are exploded, and a document goes at its first failure. The counts of a part, an order and
a step are conditional sums, combined on the map side, so what is shuffled is at most 600 rows for each part and task.

A null text is empty: it has no words, hence fails by length and nothing else (unless another empty text has a smaller id). Texts are identical
when their 128-bit digests are. A null id is smaller than none and has none smaller; rows that repeat an id do not make one another copies. A null
part is the empty string. Documents without a label are neither good nor toxic; of several labels one that says so suffices. Only id, text and
part are read, so other columns do not matter. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import map_texts, written

FILTERS = "ABCDE"
_CAPITALS, _SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
#: Keys that may be hot (a text, an id) are dealt over so many tasks; their small counterparts are repeated as often.
LANES = 16


def _own_failures(utf8: bytes, text: str) -> tuple[int, bytes]:
    """(bits of the filters A to D that the text fails, digest)."""
    words = utf8.split()
    n = len(words)
    fails = n < 200, 100 * len(set(words)) < 50 * n, 100 * (len(utf8) - len(utf8.translate(None, _CAPITALS))) > 3 * len(text), len(utf8) > len(utf8.translate(None, _SYMBOLS))
    return sum(1 << i for i, failed in enumerate(fails) if failed), hashlib.blake2b(utf8, digest_size=16).digest()


def _dealt(few: DataFrame) -> DataFrame:
    """Each row once for each lane, to be joined by a shuffle: Spark's estimate leaves the lanes out, and by it would send millions of rows through the driver."""
    return few.withColumn("lane", F.explode(F.array(*map(F.lit, range(LANES))))).hint("merge")


def failures(df: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, part, fails, good, toxic), one for each document: fails has the bits of the filters A to E.

    A: under 200 words; B: under half of the words are distinct; C: more than 3 % capitals; D: a symbol; E: an equal text with a smaller id.
    labels: rows (id, quality, toxic).
    """
    keys = {"id": F.col(id_col), "part": F.coalesce(F.col(part_col), F.lit("")), "lane": F.pmod(F.monotonically_increasing_id(), F.lit(LANES)).cast("int")}
    own = written(map_texts(df, keys, F.col(text_col), _own_failures, [("own", "int", pa.int32()), ("digest", "binary", pa.binary())]))
    copied = own.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "first")
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = own.join(_dealt(copied), ["digest", "lane"], "left").join(_dealt(said), ["id", "lane"], "left")
    late = F.when(F.col("id") > F.col("first"), 16).otherwise(0)
    return known.select("id", "part", F.col("own").bitwiseOR(late).alias("fails"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def replay(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Rows (part, filter_order, step) with kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    flags: rows (part, fails, good, toxic); bit i of fails belongs to the i-th of at most five filters. All orders of the filters are tried.
    """
    n = len(filters)
    if not 1 <= n <= 5 or len(set(filters)) < n:
        raise ValueError("one to five different filters")
    orders = [(k, "".join(p), [p.index(f) + 1 for f in filters], [1 << filters.index(f) for f in p]) for k, p in enumerate(permutations(filters))]
    orders = flags.sparkSession.createDataFrame(orders, "order int, filter_order string, places array<int>, bits array<int>")
    fails = F.col("fails")

    def fails_bit(bit: Column | int) -> Column:
        return fails.bitwiseAND(bit) != 0

    first = F.least(*(F.when(fails_bit(F.lit(1 << i)), F.col("places")[i]) for i in range(n)), F.lit(n + 1))
    crossed = flags.select("part", "fails", "good", "toxic").crossJoin(F.broadcast(orders.drop("filter_order"))).withColumn("first", first)
    steps = crossed.select("part", "order", "fails", "good", "toxic", "first", F.posexplode("bits").alias("before", "bit")).withColumn("step", F.col("before") + 1)
    goes, here = F.col("first") == F.col("step"), fails_bit(F.col("bit"))
    counted = steps.groupBy("part", "order", "step").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"),
        F.count_if(goes).alias("removed"),
        F.count_if(here & (F.col("first") < F.col("step"))).alias("redundant"),
        F.count_if(fails == F.col("bit")).alias("unique_fails"),
        F.count_if(goes & F.col("good")).alias("good_lost"),
        F.count_if(goes & F.col("toxic")).alias("toxic_lost"),
    )
    named = counted.join(F.broadcast(orders.select("order", "filter_order")), "order").drop("order")
    of_filter = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))  # as many rows as there are orders
    return named.withColumn("shapley", F.sum("removed").over(of_filter)).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


ORACLE = r"""
WITH said AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), measured AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM docs
), flags AS (
  SELECT part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > first_id, false) AS e,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM measured LEFT JOIN said USING (doc_id)
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l), orders AS (
  SELECT v.l || w.l || x.l || y.l || z.l AS filter_order FROM letter v, letter w, letter x, letter y, letter z
  WHERE len(list_distinct([v.l, w.l, x.l, y.l, z.l])) = 5
), replayed AS (
  SELECT *, coalesce(least(CASE WHEN a THEN instr(filter_order, 'A') END, CASE WHEN b THEN instr(filter_order, 'B') END, CASE WHEN c THEN instr(filter_order, 'C') END,
                           CASE WHEN d THEN instr(filter_order, 'D') END, CASE WHEN e THEN instr(filter_order, 'E') END), 6) AS first,
         CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(c AS INTEGER) + CAST(d AS INTEGER) + CAST(e AS INTEGER) AS n
  FROM flags, orders
), steps AS (
  SELECT *, substr(filter_order, step, 1) AS l FROM replayed, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), marked AS (
  SELECT *, CASE l WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS failed FROM steps
), counted AS (
  SELECT part, filter_order, step, l, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed, count(*) FILTER (failed AND first < step) AS redundant,
         count(*) FILTER (failed AND n = 1) AS unique_fails, count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
  FROM marked GROUP BY part, filter_order, step, l
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley FROM counted
"""
