"""Chat formatting after collapsing cumulative snapshots. DataFrame functions only.

A log often holds the same conversation again and again, each time with more turns. A turn's hash covers its number, role and text;
the rolling hash of a prefix is the sum of the hashes of its turns (four sums of 32 bits of two hashes, so that no sum overflows),
with the number of turns beside it. A conversation whose whole hash is a shorter prefix of another one is dropped by
an anti-join; of equal ones the least id stays. Both sides of the anti-join are distinct, so no frequent opening turn is joined by its copies.

Prefix sums are made in two steps, over blocks of turn numbers and within them, so one endless conversation is spread over tasks. Its rendering is
cut at the same blocks into parts, and a part of more than BLOCK turns, where many share a number, into pieces of BLOCK: equal turns are counted first, and their places
follow from counts by number, role and lane (two digits of the text's digest), so that no task sorts or gathers all turns of a number.

Null numbers count as -1, null roles and texts as empty. Turns of the same number are one step, ordered by role, lane and text when rendered. A repeated row
is one more turn. Rows with a null conversation id form one conversation. An empty table gives no rows. Very long texts are rendered whole. Other columns are not read.

Marks of the format inside a role or text are escaped: one backslash more between ``<`` and ``|``; so what is rendered reads back in one way only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
_SUMS = ["n", "a", "b", "c", "d"]


def _hashed(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    rows = df.select(
        F.struct(F.col(conv).alias("id")).alias("conv"),
        F.coalesce(F.col(turn), F.lit(-1)).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    one, two = F.xxhash64("turn", "role", "text"), F.xxhash64(F.lit("second"), "text", "turn", "role")
    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    return rows.select(
        "*",
        F.floor(F.col("turn") / BLOCK).cast("long").alias("block"),
        F.lit(1).cast("long").alias("n"),
        F.shiftrightunsigned(one, 32).alias("a"), low(one).alias("b"), F.shiftrightunsigned(two, 32).alias("c"), low(two).alias("d"),
    )


def _key(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{s}").alias(s) for s in _SUMS]


def maximal(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv struct<id>, n, copies): the conversations that are no prefix of another one; copies: how many equal ones there are."""
    rows = _hashed(df, conv, turn, role, text).drop("text", "role")
    blocks = rows.groupBy("conv", "block").agg(*[F.sum(s).alias(s) for s in _SUMS])
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"before_{s}") for s in _SUMS], F.sum("n").over(Window.partitionBy("conv")).alias("all_n"))
    steps = rows.groupBy("conv", "block", "turn").agg(*[F.sum(s).alias(s) for s in _SUMS])
    within = Window.partitionBy("conv", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rolled = steps.select("conv", "block", *[F.sum(s).over(within).alias(f"in_{s}") for s in _SUMS])
    prefixes = rolled.join(blocks, ["conv", "block"]).select("conv", "all_n", *[(F.col(f"before_{s}") + F.col(f"in_{s}")).alias(s) for s in _SUMS])
    whole = prefixes.where("n = all_n").groupBy(*_SUMS).agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    shorter = prefixes.where("n < all_n").select(*_SUMS).distinct()
    return whole.join(shorter, _SUMS, "left_anti").select("conv", "n", "copies")


def escaped(text: Column) -> Column:
    r"""``<|`` as ``<\|``, ``<\|`` as ``<\\|``, and so on."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), escaped(role), F.lit("|>\n"), escaped(text), F.lit("\n<|end|>\n"))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv id, part, piece, n_turns, copies, rendered): the maximal conversations, a part for every block of turn numbers, pieces of BLOCK turns."""
    kept = maximal(df, conv, turn, role, text).select("conv", "copies")
    rows = _hashed(df, conv, turn, role, text).join(kept, "conv")
    lane = F.substring(F.md5("text"), 1, 2)
    equal = rows.groupBy("conv", "block", "turn", "role", "text").agg(F.count("*").alias("n"), F.first("copies").alias("copies")).withColumn("lane", lane)
    place = ["turn", "role", "lane"]
    before = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lanes = equal.groupBy("conv", "block", *place).agg(F.sum("n").alias("n"))
    starts = lanes.select("conv", "block", *place, before(["conv", "block"], place).alias("start"))
    placed = equal.withColumn("within", before(["conv", "block", *place], ["text"])).join(starts, ["conv", "block", *place])
    first, last = F.col("start") + F.col("within"), F.col("start") + F.col("within") + F.col("n") - 1
    # Equal turns may stand in several pieces.
    pieces = placed.withColumn("first", first).withColumn("last", last).withColumn("piece", F.explode(F.sequence(F.floor(first / BLOCK), F.floor(last / BLOCK))))
    pieces = pieces.withColumn("at", F.greatest("first", F.col("piece") * BLOCK)).withColumn("n", F.least(F.col("last"), F.col("piece") * BLOCK + BLOCK - 1) - F.col("at") + 1)
    gathered = pieces.groupBy("conv", "block", "piece").agg(
        F.sum("n").alias("n_turns"), F.first("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("at", "n", "role", "text"))).alias("turns")
    )  # at most BLOCK turns
    joined = F.array_join(F.transform("turns", lambda t: F.repeat(rendered(t["role"], t["text"]), t["n"].cast("int"))), "")
    return gathered.select(F.col("conv.id").alias(conv), F.col("block").alias("part"), "piece", "n_turns", "copies", joined.alias("rendered"))


_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"

ORACLE = f"""
WITH rolled AS (
  SELECT conv_id, turn, md5(string_agg(turn || chr(1) || role || chr(2) || text, chr(3)) OVER (PARTITION BY conv_id ORDER BY turn)) AS h,
         count(*) OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS all_n FROM conversations
), whole AS (
  SELECT n, h, min(conv_id) AS conv_id, count(*) AS copies FROM rolled WHERE n = all_n GROUP BY n, h
), kept AS (
  SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM rolled r WHERE r.n < r.all_n AND r.n = w.n AND r.h = w.h)
), placed AS (
  SELECT c.*, k.copies, CAST(floor(c.turn / {BLOCK}) AS BIGINT) AS part FROM conversations c JOIN kept k USING (conv_id)
), ranked AS (
  SELECT *, CAST(floor((row_number() OVER (PARTITION BY conv_id, part ORDER BY turn, role, left(md5(text), 2), text) - 1) / {BLOCK}) AS BIGINT) AS piece FROM placed
)
SELECT conv_id, part, piece, count(*) AS n_turns, any_value(copies) AS copies,
       string_agg('<|' || {_ESCAPED.format("role")} || '|>' || chr(10) || {_ESCAPED.format("text")} || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn, role, left(md5(text), 2), text) AS rendered
FROM ranked GROUP BY conv_id, part, piece
"""
