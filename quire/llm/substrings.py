"""Substring dedup by hashing lines, or lines cut into sentences.

Units are whole lines (``unit="line"``) or, by default, sentences of lines: a sentence ends with the line, or at marks of [.!?] before white space. Long
sentences are cut further, at words that their own letters pick, so that a passage is cut alike wherever it stands, also in the middle of a line. Units are
compared as their words, A-Z in lower case, single spaces between them; digests are grouped over all documents, and the occurrence of least rank
(id, then place) is kept. The others are removed where they stand in runs: consecutive repeated units of a document of at least ``min_words``
words together. So a passage copied into other text is found by the units inside it, and a short sentence that many texts share by chance stays. With
``min_words=1`` every later occurrence of a unit is removed, however short.

Offsets are code points of the original text, ends exclusive; white space round a unit is not part of it.

A null text has no units, an empty one or one of white space neither. Rows are told apart by a number of their own: a repeated row, or one with a null id (ranked last), is an occurrence
like any other; of two rows with one id the one that Spark numbers first. Very long texts give their rows in batches. Only the id and text columns are read. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import checkpointed, sliced, written
from quire.session import bounded_batches

#: A run of fewer repeated words stays. Lines and sentences that unrelated texts share by chance are shorter; copied passages are longer.
MIN_WORDS = 20
#: Bytes of a digest: 96 bits leave no likely collision among 10**12 units.
DIGEST = 12
#: A unit with the white space after it; the matches cover the text. RE2 reads it alike.
UNIT = r"(?:[^.!?\n]+|[.!?]+[^.!?\s])*[.!?]*[ \t\n\r\f\v]*"

#: Sentences of more words than this are cut further, once a piece has so many words, after a word that the rule of ``_anchor`` picks.
LONG_WORDS, PIECE_WORDS, ANCHOR = 16, 6, 6

_unit = re.compile(UNIT, re.ASCII).finditer
_line = re.compile(r"[^\n]+").finditer
_word = re.compile(r"[^ \t\n\r\f\v]+").finditer
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _anchor(word: str) -> bool:
    """Whether a long sentence may be cut after this word: by its length, first and last character alone, wherever it stands."""
    return (7 * len(word) + 3 * ord(word[0]) + ord(word[-1])) % ANCHOR == 0


def units(text: str, unit: str = "sentence") -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of the units of a text that have words."""
    for m in (_line if unit == "line" else _unit)(text):
        at = m.start()
        words = [(w.start() + at, w.end() + at, w.group()) for w in _word(m.group().translate(_UPPER))]
        if not words:
            continue
        cuts = [len(words)]
        if len(words) > LONG_WORDS and unit != "line":
            cuts, last = [], 0
            for i, (_, _, w) in enumerate(words, 1):
                if i - last >= PIECE_WORDS and _anchor(w):
                    cuts.append(i)
                    last = i
            if last < len(words):
                cuts.append(len(words))
        first = 0
        for cut in cuts:
            part = words[first:cut]
            first = cut
            yield part[0][0], part[-1][1], len(part), md5(" ".join([w for _, _, w in part]).encode("utf-8")).digest()[:DIGEST]


_UNITS = {"unit": pa.int32(), "start": pa.int32(), "end": pa.int32(), "n_words": pa.int32(), "digest": pa.binary()}
_ROWS = 50_000


def unit_rows(df: DataFrame, id_col: str, text_col: str, unit: str) -> DataFrame:
    """Rows (id, __row, unit, start, end, n_words, digest)."""
    bounded_batches(df.sparkSession)
    picked = df.select(F.col(id_col).alias("__id"), F.monotonically_increasing_id().alias("__row"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    names = ["__id", "__row", *_UNITS]

    def packed(of: list[int], rows: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
        take = pa.array(of, pa.int32())
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), _UNITS.values())] if rows else [pa.array([], kind) for kind in _UNITS.values()]
        return pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *columns], names=names)

    def run(batches):
        for batch in sliced(batches):
            of: list[int] = []
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for k, found in enumerate(units(text, unit)):
                    of.append(i)
                    rows.append((k, *found))
                    if len(of) >= _ROWS:
                        yield packed(of, rows, batch)
                        of, rows = [], []
            yield packed(of, rows, batch)

    kind = picked.schema["__id"].dataType.simpleString()
    return picked.mapInArrow(run, f"__id {kind}, __row long, unit int, start int, `end` int, n_words int, digest binary")


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, unit: str = "sentence") -> DataFrame:
    """Rows (id, start, end, n_words, first_id, first_start) of the units to remove; first_*: the kept occurrence.

    unit: "sentence" or "line".
    """
    if unit not in ("sentence", "line"):
        raise ValueError(f"no such unit: {unit}")
    rows = written(unit_rows(df, id_col, text_col, unit))
    rank = F.struct(F.col("__id").isNull().alias("late"), F.col("__id").alias("id"), F.col("__row").alias("row"), F.col("start").alias("start"))
    first = rows.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    # Kept as a table, so that both sides of the join are dealt anew and adaptive execution can split a digest that many texts share;
    # each row meets one row.
    first = checkpointed(first)
    later = rows.join(first, "digest").where((F.col("__row") != F.col("first.row")) | (F.col("start") != F.col("first.start"))).drop("digest")
    in_text = Window.partitionBy("__row").orderBy("unit")
    runs = later.withColumn("run", F.col("unit") - F.row_number().over(in_text))
    sized = runs.withColumn("run_words", F.sum("n_words").over(Window.partitionBy("__row", "run")))
    return sized.where(F.col("run_words") >= min_words).select(
        F.col("__id").alias(id_col), "start", "end", "n_words", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start")
    )


def without(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with all their columns, the units of ``spans`` (from ``repeats``; ids unique) cut from the texts."""
    cut = spans.groupBy(F.col(id_col).alias("__cut_id")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__cut"))
    text = F.col(text_col)
    begin = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    left = F.aggregate(
        "__cut", begin,
        lambda acc, s: F.struct(F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]))).alias("out"), s["end"].alias("at")),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
    joined = df.join(cut, F.col(id_col) == F.col("__cut_id"), "left")
    return joined.withColumn(text_col, F.when(F.col("__cut").isNotNull(), left).otherwise(text)).select(df.columns)


_BLANKS = r"[ \t\n\r\f\v]"
_WORDS = r"[^ \t\n\r\f\v]+"

ORACLE = rf"""
WITH pieces AS (
  SELECT doc_id, regexp_extract_all(text, '{UNIT}') AS p FROM documents WHERE text IS NOT NULL
), placed AS (
  SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS k,
         unnest(list_transform(range(1, len(p) + 1), lambda i: coalesce(list_sum(list_transform(p[1:i-1], lambda x: length(x))), 0))) AS pos FROM pieces
), tokens AS (
  SELECT doc_id, k, pos, regexp_extract_all(piece, '{_BLANKS}*{_WORDS}') AS t FROM placed
), raws AS (
  SELECT doc_id, k, pos, unnest(t) AS raw, generate_subscripts(t, 1) AS j, len(t) AS n FROM tokens WHERE len(t) > 0
), words AS (
  SELECT doc_id, k, j, n, translate(regexp_replace(raw, '^{_BLANKS}+', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w,
         pos + sum(length(raw)) OVER (PARTITION BY doc_id, k ORDER BY j) AS stop FROM raws
), flags AS (
  SELECT doc_id, k, list(CASE WHEN (7 * length(w) + 3 * ord(left(w, 1)) + ord(right(w, 1))) % {ANCHOR} = 0 THEN 1 ELSE 0 END ORDER BY j) AS f FROM words WHERE n > {LONG_WORDS} GROUP BY doc_id, k
), since AS (
  SELECT doc_id, k, list_transform(range(1, len(f) + 1), lambda i: list_reduce(f[1:i], lambda c, x: CASE WHEN c + 1 >= {PIECE_WORDS} AND x = 1 THEN 0 ELSE c + 1 END, 0)) AS s FROM flags
), parts AS (
  SELECT w.*, CASE WHEN s IS NULL THEN 0 ELSE len(list_filter(s[1:j-1], lambda x: x = 0)) END AS part FROM words w LEFT JOIN since USING (doc_id, k)
), bodies AS (
  SELECT doc_id, k, part, CAST(min(stop - length(w)) AS INTEGER) AS start, CAST(max(stop) AS INTEGER) AS "end", count(*) AS n_words, string_agg(w, ' ' ORDER BY j) AS body FROM parts GROUP BY doc_id, k, part
), units AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, part) AS unit FROM bodies
), ranked AS (
  SELECT *, first_value(doc_id) OVER w AS first_id, first_value(start) OVER w AS first_start FROM units WINDOW w AS (PARTITION BY body ORDER BY doc_id, start)
), later AS (
  SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM ranked WHERE doc_id <> first_id OR start <> first_start
), sized AS (
  SELECT *, sum(n_words) OVER (PARTITION BY doc_id, run) AS run_words FROM later
)
SELECT doc_id, start, "end", CAST(n_words AS INTEGER) AS n_words, first_id, first_start FROM sized WHERE run_words >= {MIN_WORDS}
"""
