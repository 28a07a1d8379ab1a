"""Queries of text, chunk, page, answer and date functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import answers, calendar, chunks, geometry, numerals, text
from quire.functions.dates import resolve_phrase
from quire.sources.readers import table

LETTERS = r"[\p{L}\p{M}\p{N}\p{Pc}]+"


def glyph_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.normalize_glyphs(F.col("text")).alias("plain")).select("doc_id", F.length("plain").alias("n"), F.md5("plain").alias("digest"))


def _glyph_sql() -> str:
    made = "text"
    for a, b in text.GLYPHS:
        made = f"replace({made}, '{a}', '{b}')"
    return f"SELECT doc_id, CAST(length({made}) AS INTEGER) AS n, md5({made}) AS digest FROM documents"


def byte_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.byte_length(F.col("text")).alias("n_bytes"))


def chunk_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every document with their place: count, longest and total bytes."""
    rows = chunks.chunked(table(spark, d, "documents").select("doc_id", "text"), F.col("text"))
    return rows.groupBy("doc_id").agg(F.count("chunk").alias("n_chunks"), F.max(text.byte_length(F.col("chunk"))).alias("longest"), F.sum(F.octet_length("chunk")).alias("n_bytes"))


def chunk_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents joined again from their chunks, merged back."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    joined = chunks.rejoined(chunks.chunked(docs, F.col("text"), chunks.chunk_words), ["doc_id"], out="joined")
    return docs.select("doc_id").join(joined, "doc_id", "left").select("doc_id", text.squeeze(F.col("joined")).alias("joined")).select("doc_id", F.length("joined").alias("n"))


def url_extract(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    get = lambda p, g: F.nullif(F.regexp_extract(url, p, g), F.lit(""))
    return table(spark, d, "pages").select("page_id", get(r"^https?://([^/]+)", 1).alias("host"), get(r"(\d+)", 1).alias("number"), get(r"/([^/]*)$", 1).alias("leaf"))


def page_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    parts = F.regexp_extract_all("html", F.lit("(?s)<p>([^<]*)"), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.posexplode(parts).alias("pos", "body")).select("page_id", "pos", F.trim("body").alias("body")).where("body <> ''")


def rule_case_status(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("url").rlike("^https://"), "secure").when(F.col("url").rlike("^http://"), "plain").otherwise("other")
    return table(spark, d, "pages").groupBy(kind.alias("status")).agg(F.count("*").alias("n"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    read = F.from_json("props", "k INT")
    return table(spark, d, "events").select("event_type", read["k"].alias("k")).groupBy("event_type").agg(F.sum("k").alias("sum_k"), F.count("k").alias("n_k"))


def answer_json(spark: SparkSession, d: str) -> DataFrame:
    """Event properties wrapped as a model would answer, and read again."""
    raw = F.concat(F.lit("<think>so</think>\n```json\nAnswer: "), F.col("props"), F.lit("\n```"))
    v = answers.salvaged(raw)
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"))


def words_kept(spark: SparkSession, d: str) -> DataFrame:
    """How much of every benchmark text its first sentence keeps."""
    t = F.col("text")
    return table(spark, d, "benchmark").select("item_id", text.words_kept(text.words(t), text.words(F.substring_index(t, ".", 1))).alias("kept"))


def julian_easter(spark: SparkSession, d: str) -> DataFrame:
    years = spark.range(1400, 1601).select(F.col("id").cast("int").alias("year"))
    return years.select("year", calendar.julian_easter(F.col("year")).cast("string").alias("easter"))


def julian_weekday(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", calendar.julian_day(day).alias("jdn"), calendar.weekday(day).alias("weekday"))


def feast_dates(spark: SparkSession, d: str) -> DataFrame:
    years = spark.range(1450, 1461).select(F.col("id").cast("int").alias("year"))
    return calendar.feast_dates(years, calendar.feast_table(spark)).select("year", "feast", F.col("feast_date").cast("string").alias("feast_date"))


EASTER_SQL = (
    "make_date(year, 3, 1) + CAST(21 + (19 * (year % 19) + 15) % 30 + (2 * (year % 4) + 4 * (year % 7) + 6 * ((19 * (year % 19) + 15) % 30) + 6) % 7 AS INTEGER)"
)


def _feast_sql() -> str:
    from quire.functions.feasts import ADVENT, FROM_EASTER, ON_DAY

    rows = [f"('{k}', {n}, NULL, NULL, NULL)" for k, n in FROM_EASTER.items()] + [f"('{k}', NULL, {m}, {day}, NULL)" for k, (m, day) in ON_DAY.items()] + [f"('{k}', NULL, NULL, NULL, {n})" for k, n in ADVENT.items()]
    eve = "make_date(year, 12, 24)"
    jdn = "(24 + (153 * 9 + 2) // 5 + 365 * (year + 4800) + (year + 4800) // 4 - 32083)"
    return f"""
WITH years AS (SELECT CAST(range AS INTEGER) AS year FROM range(1450, 1461)), feasts(feast, off, m, dd, adv) AS (VALUES {", ".join(rows)})
SELECT year, feast, CAST(CAST(CASE WHEN off IS NOT NULL THEN {EASTER_SQL} + off WHEN adv IS NOT NULL THEN {eve} - CAST(({jdn} + 1) % 7 AS INTEGER) + CAST(7 * (adv - 3) AS INTEGER)
  ELSE make_date(year, m, dd) END AS DATE) AS VARCHAR) AS feast_date FROM years, feasts
"""


def advent(spark: SparkSession, d: str) -> DataFrame:
    years = spark.range(1400, 1601).select(F.col("id").cast("int").alias("year"))
    return years.select("year", *[calendar.advent_sunday(F.col("year"), F.lit(n)).cast("string").alias(f"advent_{n + 1}") for n in range(4)])


#: Own numerals: text, value.
NUMERALS = [("viij̸", 7.5), ("ij̸C xxxiiii", 184.0), ("iC lxxxij̸", 181.5), ("iiC vi", 206.0), ("xxxx", 40.0), ("viiii", 9.0), ("xxx ix", 39.0), ("j̸", 0.5), ("m d c", 1600.0), ("liber", None)]
#: Own amounts: phrase, quantity, unit, denarii.
AMOUNTS = [
    ("v lb. d.", 5.0, "lbdwien", 1200.0), ("i lb. i ort", 1.25, "lbdwien", 300.0), ("vi lb. minus lx d.", 1380.0, "d", 1380.0), ("iii lb. xxx d.", None, None, None),
    ("ii schaf.", 2.0, None, None), ("iiii f. rhen.", 4.0, "frhen", None), ("xx gr.", 20.0, "gr", 150.0), ("vij̸ s. d. Wien.", 6.5, "s", 195.0), ("", None, None, None),
]


def roman_values(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(t,) for t, _ in NUMERALS], "numeral string")
    return rows.select("numeral", numerals.read_numeral(F.col("numeral"))["value"].alias("value"))


def _values(rows: list[tuple], names: str) -> str:
    q = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else repr(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(q, r)) + ')' for r in rows)}) t({names})"


def denarii(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(a[0],) for a in AMOUNTS], "phrase string")
    return rows.select("phrase", numerals.read_amount(F.col("phrase")).alias("a")).select("phrase", "a.quantity", "a.unit", "a.denarii")


def roman_native(spark: SparkSession, d: str) -> DataFrame:
    """Every part's size as a numeral that is written and read again."""
    n = F.col("p_size")
    tens, ones = F.floor(n / 10).cast("int"), F.pmod(n, F.lit(10)).cast("int")
    written = F.concat(F.repeat(F.lit("x"), tens), F.when(ones == 9, "ix").when(ones >= 5, F.concat(F.lit("v"), F.repeat(F.lit("i"), ones - 5))).when(ones == 4, "iv").otherwise(F.repeat(F.lit("i"), ones)))
    return table(spark, d, "part").select("p_partkey", numerals.roman_value(written).alias("value"))


#: Own date phrases: phrase, year, iso.
PHRASES = [
    ("dominica oculi", 1455, "1455-03-09"), ("dominica post Ascensionis", 1455, "1455-05-18"), ("feria 6a ante Geori martyris", 1456, "1456-04-23"),
    ("in previgilia Nativitatis Christi", 1456, "1456-12-23"), ("in octava pasche", 1455, "1455-04-13"), ("Anno lvio", 1455, "1456"), ("feria 3a pasche", 1455, "1455-04-08"),
    ("de angaria crucis et lucie", 1455, None), ("ante Epiphaniam domini", 1455, None), ("in vigilia nativitatis", 1457, "1457-12-24"), ("in die Martini anno lviio", 1456, "1457-11-11"),
]


def date_phrases(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([p[:2] for p in PHRASES], "phrase string, near int")
    return rows.select("phrase", "near", resolve_phrase(F.col("phrase"), F.col("near"))["iso"].alias("iso"))


def polygon_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of quadrangles made from line items."""
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    points = F.format_string("%d,%d %d,%d %d,%d", q, n, q + n, n * 2, q - n, n + 3)
    box = geometry.bbox(geometry.shifted(geometry.polygon(points), F.lit(10), F.lit(-1)))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", "b.*")


QUERIES = [
    glyph_normalize, byte_length, chunk_bytes, chunk_round_trip, url_extract, page_paragraphs, rule_case_status, json_props, answer_json, words_kept, julian_easter, julian_weekday,
    feast_dates, advent, roman_values, denarii, roman_native, date_phrases, polygon_boxes,
]

_JDN = "(day(d) + (153 * ((month(d) + 9) % 12) + 2) // 5 + 365 * (year(d) + 4800 - CASE WHEN month(d) <= 2 THEN 1 ELSE 0 END) + (year(d) + 4800 - CASE WHEN month(d) <= 2 THEN 1 ELSE 0 END) // 4 - 32083)"

def _chunk_sql() -> str:
    seps = ", ".join("'" + c.replace("\n", "' || chr(10) || '") + "'" for c in chunks.SEPARATORS)
    return rf"""
WITH RECURSIVE seps AS (SELECT unnest([{seps}]) AS sep, unnest(range({len(chunks.SEPARATORS)})) AS rank),
cut AS (
  SELECT doc_id, 0 AS depth, text AS piece FROM documents
  UNION ALL
  SELECT doc_id, depth + 1, unnest([lft, rgt]) FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY rank) AS choice FROM (
      SELECT doc_id, depth, rank, n, CASE WHEN len(parts) > 1 THEN list_reduce(parts[1 : len(parts) // 2], lambda a, b: a || sep || b) END AS lft,
             CASE WHEN len(parts) > 1 THEN list_reduce(parts[len(parts) // 2 + 1 :], lambda a, b: a || sep || b) END AS rgt
      FROM (SELECT doc_id, depth, sep, rank, n, string_split(piece, sep) AS parts FROM (SELECT *, row_number() OVER () AS n FROM cut WHERE strlen(piece) + 1 > {chunks.MAX_BYTES}), seps)
    ) WHERE lft <> '' AND rgt <> ''
  ) WHERE choice = 1
)
SELECT doc_id, count(*) AS n_chunks, CAST(max(strlen(piece) + 1) AS INTEGER) AS longest, CAST(sum(strlen(piece)) AS BIGINT) AS n_bytes FROM cut WHERE strlen(piece) + 1 <= {chunks.MAX_BYTES} GROUP BY doc_id
"""


ORACLES = {
    "chunk_bytes": _chunk_sql(),
    "chunk_round_trip": r"SELECT doc_id, CAST(length(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) AS INTEGER) AS n FROM documents",
    "words_kept": f"""
WITH RECURSIVE t AS (SELECT item_id, regexp_extract_all(text, '{LETTERS}') AS s, regexp_extract_all(split_part(text, '.', 1), '{LETTERS}') AS o FROM benchmark),
r AS (
  SELECT item_id, s, o, 0 AS i, 0 AS pos, 0 AS kept FROM t
  UNION ALL
  SELECT item_id, s, o, i + 1, CASE WHEN p > 0 THEN pos + p ELSE pos END, CASE WHEN p > 0 THEN kept + 1 ELSE kept END
  FROM (SELECT *, coalesce(list_position(o[pos + 1 :], s[i + 1]), 0) AS p FROM r WHERE i < len(s))
)
SELECT item_id, round(100.0 * kept / greatest(len(s), 1), 1) AS kept FROM r WHERE i = len(s)
""",
    "glyph_normalize": _glyph_sql(),
    "byte_length": "SELECT doc_id, CAST(strlen(text) + 1 AS INTEGER) AS n_bytes FROM documents",
    "url_extract": "SELECT page_id, nullif(regexp_extract(url, '^https?://([^/]+)', 1), '') AS host, nullif(regexp_extract(url, '(\\d+)', 1), '') AS number, nullif(regexp_extract(url, '/([^/]*)$', 1), '') AS leaf FROM pages",
    "page_paragraphs": "WITH p AS (SELECT page_id, regexp_extract_all(html, '(?s)<p>([^<]*)', 1) AS b FROM pages), r AS (SELECT page_id, unnest(b) AS body, CAST(generate_subscripts(b, 1) - 1 AS INTEGER) AS pos FROM p) "
    "SELECT page_id, pos, trim(body, ' ') AS body FROM r WHERE trim(body, ' ') <> ''",
    "rule_case_status": "SELECT CASE WHEN url LIKE 'https://%' THEN 'secure' WHEN url LIKE 'http://%' THEN 'plain' ELSE 'other' END AS status, count(*) AS n FROM pages GROUP BY 1",
    "json_props": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS sum_k, count(json_extract(props, '$.k')) AS n_k FROM events GROUP BY event_type",
    "answer_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
    "julian_easter": f"SELECT year, CAST(CAST({EASTER_SQL} AS DATE) AS VARCHAR) AS easter FROM (SELECT CAST(range AS INTEGER) AS year FROM range(1400, 1601))",
    "julian_weekday": f"SELECT o_orderkey, CAST({_JDN} AS INTEGER) AS jdn, CAST(({_JDN} + 1) % 7 AS INTEGER) AS weekday FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)",
    "feast_dates": _feast_sql(),
    "advent": "WITH y AS (SELECT CAST(range AS INTEGER) AS year FROM range(1400, 1601)), s AS (SELECT year, make_date(year, 12, 24) - CAST((24 + (153 * 9 + 2) // 5 + 365 * (year + 4800) + (year + 4800) // 4 - 32083 + 1) % 7 AS INTEGER) AS last FROM y) "
    "SELECT year, " + ", ".join(f"CAST(CAST(last - {21 - 7 * n} AS DATE) AS VARCHAR) AS advent_{n + 1}" for n in range(4)) + " FROM s",
    "roman_values": _values(NUMERALS, "numeral, value"),
    "denarii": _values(AMOUNTS, "phrase, quantity, unit, denarii"),
    "roman_native": "SELECT p_partkey, p_size AS value FROM part",
    "date_phrases": _values(PHRASES, "phrase, near, iso"),
    "polygon_boxes": "WITH p AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q, l_linenumber AS n FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, least(q, q + n, q - n) + 10 AS min_x, greatest(q, q + n, q - n) + 10 AS max_x, least(n, n * 2, n + 3) - 1 AS min_y, greatest(n, n * 2, n + 3) - 1 AS max_y FROM p",
}
