"""Queries of operators over inputs that are written from the driver tables: numerals, amounts, dates, pages, answers, findings.

The query writes texts and lets the operator read them; its SQL gets the rows from the numbers that were written, without reading a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions import answers, chunks, dates, geometry, numerals, text
from quire.operators import models, repair, search, validate, windows
from quire.plans.model_queries import lcs_sql
from quire.plans.text_queries import EASTER_SQL
from quire.session import dealt
from quire.sources import folders, pages, readers, reports, triples, writers

STRUCK = "j" + numerals.STROKE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def additive(n: Column) -> Column:
    """A number below 100 in additive signs, none of them taken off."""
    times = lambda sign, k: F.repeat(F.lit(sign), k.cast("int"))
    return F.concat(times("l", F.floor(n / 50)), times("x", F.floor(n % 50 / 10)), times("v", F.floor(n % 10 / 5)), times("i", n % 5))


_ADDITIVE = "repeat('l', CAST({0} // 50 AS INTEGER)) || repeat('x', CAST({0} % 50 // 10 AS INTEGER)) || repeat('v', CAST({0} % 10 // 5 AS INTEGER)) || repeat('i', CAST({0} % 5 AS INTEGER))"


def roman_values(spark: SparkSession, d: str) -> DataFrame:
    """Every part's key and size as hundreds, tens and ones; some with a struck half, some with half a hundred."""
    h, half, struck = F.col("p_partkey") % 4, (F.col("p_partkey") % 5 == 0) & (F.col("p_partkey") % 4 > 0), F.col("p_partkey") % 3 == 0
    hundreds = F.when(h > 0, F.concat(F.repeat(F.lit("i"), h.cast("int")), F.when(half, F.lit(STRUCK)).otherwise(""), F.lit("C "))).otherwise("")
    written = F.concat(hundreds, additive(F.col("p_size")), F.when(struck, F.lit(STRUCK)).otherwise(""))
    return dealt(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", numerals.read_numeral(written).alias("n")).select("p_partkey", "n.value", "n.misread", "n.reason")


def numeral_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two numerals in a text without units: a struck one, and one of two tokens."""
    size = F.col("p_size")
    entry = F.concat(F.lit("Item "), additive(size), F.lit(STRUCK), F.lit(" et "), additive(size % 7 + 1), F.lit("  x solvit"))
    rows = dealt(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", F.explode(numerals.find_numerals(entry)).alias("r"))
    return rows.select("p_partkey", "r.run", "r.value", "r.misread")


def denarii(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of one amount: pounds, pounds less pence, guilders without a rate, and a quarter more."""
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    forms = [F.lit(" lb. d."), F.concat(F.lit(" lb. minus "), additive(n), F.lit(" d.")), F.lit(" f. rhen."), F.lit(" lb. i ort")]
    phrase = F.concat(additive(q), F.coalesce(*[F.when(n % 4 == k, form) for k, form in enumerate(forms)]))
    rows = dealt(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", numerals.read_amount(phrase).alias("a"))
    return rows.select("l_orderkey", "l_linenumber", "a.quantity", "a.unit", "a.subtracted", "a.denarii", numerals.denarii(F.col("a.quantity"), F.col("a.unit")).alias("again"))


def free_text_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Two amounts in a text, with units of several words."""
    entry = F.concat(F.lit("Item dedit "), additive(F.col("l_quantity").cast("int")), F.lit(" lb. d. Wien. et  "), additive(F.col("l_linenumber")), F.lit(" gr. nobis"))
    rows = dealt(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", F.explode(numerals.find_amounts(entry)).alias("a"))
    return rows.select("l_orderkey", "l_linenumber", "a.span", "a.quantity", "a.unit", numerals.denarii(F.col("a.quantity"), F.col("a.unit")).alias("denarii"))


def corrected_quantities(spark: SparkSession, d: str) -> DataFrame:
    """Entries with one struck numeral; every other quantity was misread."""
    size = F.col("p_size")
    parts = table(spark, d, "part")
    entries = parts.select(F.col("p_partkey").alias("entry_id"), F.concat(F.lit("Item "), additive(size), F.lit(STRUCK), F.lit(" solvit")).alias("entry"))
    quantities = parts.select(F.col("p_partkey").alias("entry_id"), (size + F.when(F.col("p_partkey") % 2 == 0, 0.5).otherwise(1.5)).alias("quantity"))
    return numerals.corrected_quantities(quantities, entries).select("entry_id", "quantity", "corrected")


#: Feasts as they are written here: key, words, days from Easter, month, day.
FEASTS = [
    ("oculi", "Oculi", -28, None, None), ("invocavit", "Invocavit", -42, None, None), ("cantate", "Cantate", 28, None, None), ("exaudi", "Exaudi", 42, None, None), ("trinity", "Trinitatis", 56, None, None),
    ("corpus christi", "Corporis Christi", 60, None, None), ("palm sunday", "Palmarum", -7, None, None), ("kiliani", "Kiliani", None, 7, 8), ("floriani", "Floriani martiris", None, 5, 4), ("egidi", "Egidii", None, 9, 1),
    ("blasii", "Blasii", None, 2, 3), ("katherine", "Katherine virginis", None, 11, 25), ("laurencii", "Laurencii", None, 8, 10), ("briccii", "Briccii", None, 11, 13), ("marie magdalene", "Marie Magdalene", None, 7, 22),
    ("omnium sanctorum", "omnium Sanctorum", None, 11, 1),
]
DAYS = ["dominica", "feria secunda", "feria 3a", "quarta feria", "feria vta", "feria sexta", "Sabbato"]
COUNTED = ["", "secunda ", "tercia "]


def _written_date(key: Column) -> Column:
    """A phrase whose feast, weekday, side, count and form follow from a key."""
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    feast, day = pick([f[1] for f in FEASTS], key), pick(DAYS, F.floor(key / 3))
    count = F.when(F.floor(key / 3) % 7 == 0, pick(COUNTED, F.floor(key / 5))).otherwise("")
    forms = [
        F.concat(day, F.lit(" "), count, F.lit("post "), feast), F.concat(day, F.lit(" "), count, F.lit("ante "), feast), F.concat(F.lit("in vigilia "), feast), F.concat(F.lit("in pre"), F.lit("vigilia "), feast),
        F.concat(F.lit("in octava "), feast), F.concat(F.lit("in die sancti "), feast), F.concat(day, F.lit(" infra octavas "), feast),
    ]
    return F.coalesce(*[F.when(F.floor(key / 16) % len(forms) == k, form) for k, form in enumerate(forms)])


def _date_sql(key: str, year: str) -> str:
    """SQL of the day that ``_written_date`` names, as columns feast and day of a table t with the key's row."""
    feasts = ", ".join(f"({n}, '{k}', {'NULL' if off is None else off}, {'NULL' if m is None else m}, {'NULL' if dd is None else dd})" for n, (k, _, off, m, dd) in enumerate(FEASTS))
    jdn = "(day(d) + (153 * ((month(d) + 9) % 12) + 2) // 5 + 365 * (year(d) + 4800 - CASE WHEN month(d) <= 2 THEN 1 ELSE 0 END) + (year(d) + 4800 - CASE WHEN month(d) <= 2 THEN 1 ELSE 0 END) // 4 - 32083)"
    return f"""
feasts(n, feast, off, m, dd) AS (VALUES {feasts}),
keyed AS (SELECT *, {key} AS key, {year} AS year, {key} // 3 % 7 AS wd, {key} // 16 % 7 AS form, CASE WHEN {key} // 3 % 7 = 0 THEN {key} // 5 % 3 ELSE 0 END AS weeks FROM src),
placed AS (SELECT keyed.*, feast, CAST(CASE WHEN off IS NULL THEN make_date(CAST(year AS INTEGER), m, dd) ELSE {EASTER_SQL.replace("year", "CAST(year AS INTEGER)")} + off END AS DATE) AS d FROM keyed JOIN feasts ON key % {len(FEASTS)} = n),
dated AS (SELECT *, CAST(({jdn} + 1) % 7 AS INTEGER) AS own FROM placed),
moved AS (SELECT *, CAST(CAST(CASE form
  WHEN 0 THEN d + CAST((wd - own + 6) % 7 + 1 + 7 * weeks AS INTEGER) WHEN 1 THEN d - CAST((own - wd + 6) % 7 + 1 + 7 * weeks AS INTEGER)
  WHEN 2 THEN d - 1 WHEN 3 THEN d - 2 WHEN 4 THEN d + 7 WHEN 5 THEN d ELSE d + CAST((wd - own + 6) % 7 + 1 AS INTEGER) END AS DATE) AS VARCHAR) AS iso FROM dated)"""


def _year_words(shift: Column) -> Column:
    """``anno`` with a numeral of 1455 + shift."""
    return F.concat(F.lit(" anno domini "), F.element_at(F.array(*map(F.lit, ["lv", "lvito", "lviio", "lviii"])), (shift + 1).cast("int")))


def date_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Phrases over feasts, weekdays, sides, counts, vigils and octaves, every third with a year of its own."""
    key = F.col("o_orderkey")
    own = F.when(key % 3 == 0, _year_words(key % 4)).otherwise("")
    rows = dealt(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", F.concat(_written_date(key), own).alias("phrase"), F.when(key % 3 == 0, F.lit(1455)).otherwise((1440 + key % 50).cast("int")).alias("near"))
    return rows.withColumn("r", dates.resolve_phrase(F.col("phrase"), F.col("near"))).select("o_orderkey", "r.feast", "r.iso", "r.precision", "r.year", "r.year_source", "r.reason")


def free_text_dates(spark: SparkSession, d: str) -> DataFrame:
    """A date in the middle of an entry, with the place where it stands."""
    key = F.col("o_orderkey")
    entry = F.concat(F.lit("Item solvit  Georius de Wien "), _written_date(key), F.lit(", nichil"))
    rows = dealt(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", F.explode(dates.find_dates(entry, (1440 + key % 50).cast("int"))).alias("x"))
    return rows.where("x.iso IS NOT NULL").select("o_orderkey", "x.feast", "x.iso", "x.start", "x.ambiguous")


def dated_or_year(spark: SparkSession, d: str) -> DataFrame:
    """The day of a phrase, else the declared year, else the year of a date already there."""
    key = F.col("o_orderkey")
    phrase = F.when(key % 4 == 0, _written_date(key)).otherwise("nichil")
    declared = F.when(key % 4 <= 1, (1440 + key % 50).cast("string")).when(key % 4 == 2, "")
    there = F.when(key % 8 < 4, F.array(F.lit("anno"), F.lit("1457-02-01"))).otherwise(F.array().cast("array<string>"))
    rows = dealt(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", phrase.alias("phrase"), declared.alias("declared"), there.alias("there"))
    resolved = dates.resolve_phrase(F.col("phrase"), F.col("declared").try_cast("int"))
    return rows.select("o_orderkey", dates.date_or_year(resolved, F.col("declared"), F.col("there")).alias("iso"))


def phrase_marks(spark: SparkSession, d: str) -> DataFrame:
    """Part names copied exactly, in other case and not at all; every third entry names a day to pay by."""
    key, name = F.col("p_partkey"), F.col("p_name")
    phrase = F.when(key % 3 == 0, name).when(key % 3 == 1, F.upper(name)).otherwise(F.concat(name, F.lit("!")))
    entry = F.concat(F.when(key % 5 == 0, "Solvere  debet ").when(key % 5 == 1, "proxime venturam ").otherwise("dedit "), name)
    return table(spark, d, "part").select("p_partkey", dates.provenance(phrase, entry).alias("provenance"), dates.has_deadline(entry).alias("deadline"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items with n, their number within the order (line numbers may repeat)."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    return table(spark, d, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))


_LINES = "lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS n FROM lineitem)"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """A page of PAGE-XML for every order, a region for every line item. Two of three pages have a reading order: from the last region to the first."""
    n = F.col("n")
    line = lambda t: F.concat(F.lit("<TextLine><TextEquiv><Unicode>"), t, F.lit("</Unicode></TextEquiv></TextLine>"))
    lines = F.when(n % 5 == 4, "").otherwise(F.concat(line(F.concat(F.lit("part "), F.col("l_partkey"), F.lit(" &amp; more"))), line(F.concat(F.lit("from "), F.col("l_suppkey")))))
    own = F.concat(F.lit("<TextEquiv><Unicode>region of "), F.repeat(F.lit("r"), n * 3), F.lit("</Unicode></TextEquiv>"))
    q = F.col("l_quantity").cast("int")
    points = F.format_string("%d,%d %d,%d %d,%d", q, n, q + n, n * 2, q - n, n + 3)
    region = F.format_string('<TextRegion id="r%d"><Coords points="%s"/>%s%s</TextRegion>', n, points, lines, own)
    gathered = _lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), region.alias("xml")))).alias("regions"))  # an order's few lines
    refs = F.transform("regions", lambda r: F.format_string('<RegionRefIndexed index="%d" regionRef="r%d"/>', 100 - r["n"], r["n"]))
    order = F.when(F.col("l_orderkey") % 3 > 0, F.concat(F.lit('<ReadingOrder><OrderedGroup id="g">'), F.array_join(refs, ""), F.lit("</OrderedGroup></ReadingOrder>"))).otherwise("")
    body = F.concat(F.lit('<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page>'), order, F.array_join(F.transform("regions", lambda r: r["xml"]), ""))
    xml = F.concat(body, F.when(F.col("l_orderkey") % 11 == 5, "").otherwise("</Page></PcGts>"))
    return gathered.select(F.concat(F.lit("/in/abc/1905/"), F.col("l_orderkey"), F.lit(".xml")).alias("path"), xml.alias("text"))


def page_regions(spark: SparkSession, d: str) -> DataFrame:
    rows = pages.text_regions(_pages(spark, d))
    return rows.select("path", "region_id", "reading_order", "text", F.col("error").isNotNull().alias("broken"))


def page_boxes(spark: SparkSession, d: str) -> DataFrame:
    return pages.boxed_regions(_pages(spark, d), 20)


def ground_truth(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("path", pages.ground_truth(F.col("text"), 2).alias("gt"))


def byte_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("é漢 "), F.left("text", F.lit(150))).alias("t"))
    ids = chunks.byte_tokens(F.col("t"))
    return rows.select("item_id", F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("ids"), (chunks.from_byte_tokens(ids) == F.col("t")).alias("again"))


def judgements(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a judge in the forms that models give them, against a short list."""
    key, pid = F.col("event_id"), F.concat(F.lit("p"), F.col("user_id") % 5)
    forms = [
        F.concat(F.lit('[{"decision":"match","entity_id":"'), pid, F.lit('"}]')), F.concat(F.lit('```json\n{"decision":"match","entity_ids":["p9","'), pid, F.lit('"]}\n```')),
        F.concat(F.lit('<think>{no}</think>So: {"decision":"new","entity_ids":[],"reason":"'), F.col("event_type"), F.lit('"} as said')), F.concat(F.lit("no json "), pid),
    ]
    raw = F.coalesce(*[F.when(key % 4 == k, f) for k, f in enumerate(forms)])
    rows = table(spark, d, "events").select("event_id", answers.judgement(raw, F.array(F.lit("p1"), F.lit("p2"), F.lit("p3"))).alias("j"))
    return rows.select("event_id", "j.decision", F.array_join("j.entity_ids", ",").alias("ids"), "j.reason")


def answers_checked(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("event_id")
    types = F.coalesce(F.when(key % 4 == 0, "Abbreviation; Correction"), F.when(key % 4 == 1, "Other"), F.when(key % 4 == 2, "Omission"))
    tei = F.coalesce(*[F.when(key % 5 == k, x) for k, x in enumerate(["<choice><abbr>d</abbr><expan>den</expan></choice>", "<b>x</b>", "<gap n='1'/>", "<gap>", "plain"])])
    rows = table(spark, d, "events")
    return rows.select("event_id", text.types_in_list(types, answers.INTERVENTION_TYPES).alias("type_ok"), answers.well_formed(tei).alias("well_formed"), answers.tags_allowed(tei).alias("tei_ok"))


def path_functions(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    p = F.concat(F.when(key % 4 == 0, "/else/").otherwise("/in/"), F.lit("paper"), key % 9, F.lit("/"), F.year("o_orderdate"), F.lit("/"), key, F.when(key % 3 == 0, "_enhanced").otherwise(""), F.lit(".jpg"))
    parts = text.path_parts(p)
    return table(spark, d, "orders").select("o_orderkey", parts["newspaper"].alias("newspaper"), parts["year"].alias("year"), parts["page"].alias("page"), text.mirrored(p, "/in", "/out").alias("target"), text.image_name(p).alias("image"))


def model_file_rates(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("run_0."), F.lpad(F.col("p_partkey") % 1000, 3, "0"), F.when(F.col("p_partkey") % 6 == 0, "x").otherwise(""), F.lit(".mlmodel"))
    return table(spark, d, "part").select("p_partkey", reports.file_metric(name).alias("cer"))


def batch_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.batches(table(spark, d, "part").select(F.col("p_partkey").alias("n")), "n", 25)
    return rows.where(text.in_batch(F.col("n"), "10-155")).select("n", "batch")


def affine_points(spark: SparkSession, d: str) -> DataFrame:
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    moved = geometry.sheared_rotated(geometry.polygon(F.format_string("%d,%d %d,%d", q, n, n, q)), F.lit(0.5), F.lit(90.0), F.lit(3), F.lit(2))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode(moved).alias("pos", "p"))
    return rows.select("l_orderkey", "l_linenumber", "pos", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


def split_properties(spark: SparkSession, d: str) -> DataFrame:
    """Orders as hosts, their lines as children; every third host's property is one that is split where it holds several children."""
    n = F.col("n")
    kids = F.array_sort(F.collect_list(F.struct(F.concat(F.lit("m"), n).alias("id"), F.when(n % 3 == 0, "Commodity").otherwise("Money").alias("class"))))
    rows = _lines(spark, d).groupBy("l_orderkey").agg(kids.alias("children"))
    rows = rows.select(F.col("l_orderkey").cast("string").alias("host"), F.when(F.col("l_orderkey") % 3 == 0, "from").otherwise("transfers").alias("property"), "children")
    return repair.split_properties(rows).select("host", "was_split", "piece", F.array_join(F.transform("children", lambda c: c["id"]), ",").alias("ids"))


def back_references(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    p = F.coalesce(*[F.when(key % 4 == k, f"urn:bk#{x}") for k, x in enumerate(("from", "to", "entry", "from"))])
    o = F.when(key % 3 == 0, "urn:t#Eodem").when(key % 3 == 1, F.concat(F.lit("urn:t#"), F.lower("c_mktsegment"))).otherwise("urn:t#idem")
    rows = table(spark, d, "customer").select(F.lit("g").alias("graph"), key.cast("string").alias("s"), p.alias("p"), o.alias("o"))
    return repair.without_back_references(rows).select("s", "p", "o")


def _ledger(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Entries of a source and their encodings: some are missing, doubled, extra, or differ in text, pointer or rubric."""
    key = F.col("o_orderkey")
    orders = table(spark, d, "orders")
    entry = F.concat(F.lit("paid  "), F.col("o_custkey"), F.lit(" to him "))
    source = orders.where(key % 19 != 18).select(
        key.cast("string").alias("id"), entry.alias("entry"), F.when(key % 5 > 0, F.concat(F.lit("#p"), key % 7)).alias("pointer"), F.concat(F.lit("L#r"), key % 4).alias("rubric"), F.year("o_orderdate").cast("string").alias("year")
    )
    copies = F.when(key % 19 == 17, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    got = orders.where(key % 19 != 16).withColumn("copy", F.explode(copies)).select(
        key.cast("string").alias("id"), F.when(key % 13 == 3, "given").when(key % 13 != 4, F.concat(F.lit("paid "), F.col("o_custkey"), F.lit(" to him"))).alias("entry"),
        F.concat(F.lit("x#p"), key % F.when(key % 11 == 1, 6).otherwise(7)).alias("pointer"), F.when(key % 17 != 2, F.concat(F.lit("urn#r"), key % 4)).alias("rubric"),
    )
    return source, got


def validation_findings(spark: SparkSession, d: str) -> DataFrame:
    source, got = _ledger(spark, d)
    whens = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 6 == 0, "1457-03-01").when(F.col("o_orderkey") % 6 == 1, "soon").otherwise(F.year("o_orderdate").cast("string")).alias("when"))
    found = validate.completeness(source, got).union(validate.fields(source, got)).union(validate.years(source, whens))
    hosts = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("host"))
    return found.union(validate.several_dates(hosts)).distinct()


def applied_findings(spark: SparkSession, d: str) -> DataFrame:
    source, got = _ledger(spark, d)
    return validate.applied(got, validate.fields(source, got), "entry text", "entry", F.lit(True)).select("id", "entry")


_LETTERS = ("0123456789abcdef", "aeioubdfgklmnprs")
GIVEN = ["Hans", "Peter", "Georg", "Ulrich", "Katharina"]


def _named_suppliers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A catalogue of persons with a frequent given name and a surname of their own, and mentions of each with a letter of the surname lost."""
    key = F.col("s_suppkey").cast("string")
    surname = F.initcap(F.translate(F.left(F.md5(key), F.lit(9)), *_LETTERS))
    rows = table(spark, d, "supplier").select(F.concat(F.lit("p"), key).alias("id"), F.element_at(F.array(*map(F.lit, GIVEN)), (F.col("s_suppkey") % len(GIVEN) + 1).cast("int")).alias("given"), surname.alias("surname"))
    kinds = StructType.fromDDL(readers.PERSONS)
    known = {"id": F.col("id"), "headword": F.concat("given", F.lit(" "), "surname", F.lit(" (x)/y")), "label": F.concat(F.lit("von "), "surname", F.lit(" "), "given")}
    persons = rows.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])
    typo = F.concat(F.substring("surname", 1, 3), F.substring("surname", 5, 20))
    return rows.select(F.col("id").alias("pid"), F.concat("given", F.lit(" "), typo).alias("mention")), persons


def name_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The best person for each mention, with the score."""
    mentions, persons = _named_suppliers(spark, d)
    return search.candidates(mentions, persons, top=1).select("mention", "pid", "score")


def name_likeness(spark: SparkSession, d: str) -> DataFrame:
    mentions, persons = _named_suppliers(spark, d)
    return search.name_similarity(mentions, persons).select("mention", "pid", F.round("similarity", 6).alias("similarity"))


def token_weights(spark: SparkSession, d: str) -> DataFrame:
    """Rarity of the forms of a catalogue's names."""
    _, persons = _named_suppliers(spark, d)
    return search.weights(search.name_forms(persons), persons.agg(F.count("*").alias("n"))).select("form", "df", F.round("weight", 9).alias("weight"))


def served_models(spark: SparkSession, d: str) -> DataFrame:
    """Models of a list that generate text, with the options that turn thinking on for every other one."""
    key = F.col("p_partkey")
    kinds = ["Kimi-K2", "qwen3", "BGE-m3", "jina-x", "all-MiniLM", "glm", "text-embed"]
    name = F.concat(F.element_at(F.array(*map(F.lit, kinds)), (key % len(kinds) + 1).cast("int")), F.lit("/"), key)
    rows = table(spark, d, "part").select(name.alias("model"), key).where(models.generating(F.col("model")))
    return rows.select("model", models.thinking_options(F.col("model"), key % 2 == 0).alias("options"))


def run_logs(spark: SparkSession, d: str) -> DataFrame:
    """The log of a run over answers that stand for orders."""
    orders = table(spark, d, "orders")
    rows = orders.select(
        F.col("o_orderkey").cast("string").alias("key"), F.lit("x").alias("content"), F.lit("stop").alias("finish_reason"), (F.col("o_custkey") % 7).alias("tokens_in"), (F.col("o_custkey") % 11).alias("tokens_out"),
        F.lit(1).alias("attempts"), F.when(F.col("o_orderkey") % 50 == 0, "busy").alias("error"),
    )
    return models.run_log(rows, "be brief", "echo", 4.0, temperature=0, max_tokens=64)


def class_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """The place of each embedding's largest number and its share after a softmax."""
    rows = table(spark, d, "embeddings").select("vec_id", models.best_class(F.col("embedding")).alias("b"))
    return rows.select("vec_id", "b.prediction", F.round("b.probability", 6).alias("probability"))


def tagged_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of years and keys in short texts, by the pattern tagger."""
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey"), F.lit(" of "), F.year("o_orderdate"), F.lit(" said")).alias("text"))
    found = models.predicted(rows, lambda: models.PatternTagger({"year": r"(?<=of )[0-9]{4}", "key": r"(?<=order )[0-9]+"}), "o_orderkey long, text string, spans array<struct<label:string,start:int,end:int>>", 500)
    return found.select("o_orderkey", F.inline("spans"))


def customer_graph_weights(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a graph for each customer's orders; a broken graph for some, none at all for others: these weigh 1."""
    key = F.col("o_custkey")
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:bk="urn:bk#">'
    node = F.format_string('<bk:%s rdf:about="urn:t#%d"/>', F.when(F.col("o_orderkey") % 3 == 0, "Note").when(F.col("o_orderkey") % 3 == 1, "Transaction").otherwise("SubTotal"), F.col("o_orderkey"))
    graphs = table(spark, d, "orders").where(key % 13 != 0).groupBy(key.cast("string").alias("graph")).agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list(node)), ""), F.when(F.first(key) % 7 == 0, "").otherwise("</rdf:RDF>")).alias("text"))
    datasets = table(spark, d, "orders").select(key.cast("string").alias("dataset"))
    return triples.entry_weights(datasets, triples.triples(graphs))


def day_first_dates(spark: SparkSession, d: str) -> DataFrame:
    """Order days written with the day first and three kinds of marks, some of no month."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    mark = F.when(key % 3 == 0, ".").when(key % 3 == 1, "/").otherwise("-")
    written = F.concat(F.lit(" "), F.day(day), mark, F.month(day) + F.when(key % 10 == 0, 12).otherwise(0), mark, F.year(day))
    return table(spark, d, "orders").select("o_orderkey", text.day_first_date(written).cast("string").alias("day"))


def letter_tags(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a letter's elements; broken ones have none."""
    n = F.col("l_linenumber")
    xml = F.concat(F.lit("<opener><dateline>x</dateline></opener>"), F.repeat(F.lit("<p>y<lb/></p>"), n), F.when(n % 3 == 0, "<closer>").otherwise("<closer/>"))
    rows = dealt(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_linenumber")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", answers.tag_counts(xml).alias("tags"))


def expanded_names(spark: SparkSession, d: str) -> DataFrame:
    """Names from answers: an object with persons, a bare list, or nothing that can be read."""
    key, name = F.col("c_custkey"), F.col("c_mktsegment")
    raw = F.when(key % 3 == 0, F.concat(F.lit('Sure: {"persons": ["'), name, F.lit('", " ", "B"]}'))).when(key % 3 == 1, F.concat(F.lit('```json\n["'), name, F.lit('"]\n```'))).otherwise("none")
    return table(spark, d, "customer").select("c_custkey", F.array_join(answers.expanded_persons(raw), ",").alias("names"))


def request_helpers(spark: SparkSession, d: str) -> DataFrame:
    """Waits before attempts, headers, names for files, prompts and kinds of addresses."""
    key = F.col("page_id")
    return table(spark, d, "pages").select(
        "page_id", text.backoff(key % 8).alias("wait"), text.retry_after(F.when(key % 2 == 0, (key % 9).cast("string")).otherwise("soon")).alias("after"), text.safe_name(F.concat(F.lit("a/b: "), key)).alias("name"),
        text.prompt(F.lit(" one "), F.when(key % 3 > 0, F.lit("two")).otherwise(""), F.lit(None)).alias("prompt"), text.url_kind(F.col("url")).alias("kind"), text.middots(F.concat(F.lit(" a  b "), key)).alias("dotted"),
        text.name_year(F.concat(F.lit("abc"), 1900 + key % 50, F.lit("0101"))).alias("y"),
    ).select("page_id", "wait", "after", "name", "prompt", "kind", "dotted", "y.short_title", "y.year")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_name", "p_brand", F.when(F.col("p_size") > 10, F.col("p_size")).alias("p_size"))


def csv_written(spark: SparkSession, d: str) -> DataFrame:
    """Parts written as CSV and read again, as typed columns and as strings."""
    path, rows = folders.scratch(spark, "csv"), _parts(spark, d)
    writers.csv(rows, path)
    typed, plain = readers.csv(spark, path, rows.schema), readers.csv_strings(spark, path)
    return typed.join(plain.select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_size").alias("as_string")), "p_partkey")


def json_written(spark: SparkSession, d: str) -> DataFrame:
    path, rows = folders.scratch(spark, "json"), _parts(spark, d)
    writers.json_lines(rows, path)
    return readers.json_lines(spark, path, rows.schema)


def parquet_written(spark: SparkSession, d: str) -> DataFrame:
    """Parts in a folder for each brand; one brand is read, by its folder alone."""
    path = folders.scratch(spark, "parquet")
    writers.parquet(_parts(spark, d), path, ["p_brand"])
    return spark.read.parquet(path).where("p_brand = 'Brand#3'").select("p_partkey", "p_name")


def work_lists_written(spark: SparkSession, d: str) -> DataFrame:
    """A list of names and addresses for each host kind, read again as one work list."""
    path = folders.scratch(spark, "lists")
    rows = table(spark, d, "pages").select(F.concat(F.lit("page"), F.col("page_id")).alias("name"), "url", (F.col("page_id") % 3).alias("lot"))
    writers.work_lists(rows, path, ["lot"])
    return readers.work_list(spark, f"{path}/*").select("name", "url")


def lines_written(spark: SparkSession, d: str) -> DataFrame:
    """Lines with comments and blanks among them, written as text; ids are read from them, and their parts at the bars."""
    path, key = folders.scratch(spark, "lines"), F.col("c_custkey")
    line = F.when(key % 5 == 0, "# note").when(key % 5 == 1, "  ").otherwise(F.concat(F.lit(" c"), key, F.lit(" | "), F.col("c_mktsegment"), F.lit("||")))
    writers.text_lines(table(spark, d, "customer").select(line.alias("line")), path, "line")
    return readers.corpus_lines(spark, path).select(F.col("parts")[0].alias("id"), F.col("parts")[1].alias("segment"), F.size("parts").alias("n"))


def texts_listed(spark: SparkSession, d: str) -> DataFrame:
    """A file for each nation, read whole; wanted ones that are not there are marked."""
    path = folders.scratch(spark, "texts")
    nations = table(spark, d, "nation")
    nations.where("n_nationkey % 4 > 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("value")).repartition(5, "k").write.partitionBy("k").text(path)
    found = readers.whole_texts(spark, path).select(F.regexp_extract("path", "k=([0-9]+)", 1).cast("int").alias("n_nationkey"), F.trim(F.regexp_replace("text", "\\n", "")).alias("text"))
    return readers.listed_texts(nations.select("n_nationkey"), found, "n_nationkey")


def log_appended(spark: SparkSession, d: str) -> DataFrame:
    """A log of JSON lines, written in two steps and read again."""
    path, rows = folders.scratch(spark, "log"), table(spark, d, "supplier").select("s_suppkey", "s_name")
    writers.appended_log(rows.where("s_suppkey % 2 = 0"), path)
    writers.appended_log(rows.where("s_suppkey % 2 = 1"), path)
    return readers.json_lines(spark, path, rows.schema)


def one_text(spark: SparkSession, d: str) -> DataFrame:
    """Nations as one text and as one JSON object."""
    rows = table(spark, d, "nation")
    return writers.joined_text(rows, "n_nationkey", "n_name", "; ").crossJoin(writers.keyed_json(rows, "n_name", "n_regionkey"))  # one row each


QUERIES = [
    csv_written, json_written, parquet_written, work_lists_written, lines_written, texts_listed, log_appended, one_text, served_models, run_logs, class_probabilities, tagged_spans, customer_graph_weights, day_first_dates, letter_tags, expanded_names, request_helpers, name_candidates, name_likeness, token_weights, roman_values, numeral_runs, denarii, free_text_amounts, corrected_quantities, date_phrases, free_text_dates, dated_or_year, phrase_marks, page_regions, page_boxes, ground_truth, byte_tokens, judgements,
    answers_checked, path_functions, model_file_rates, batch_numbers, affine_points, split_properties, back_references, validation_findings, applied_findings,
]

_J = "j" + numerals.STROKE
_READING = f"""
{_LINES}, regions AS (SELECT l_orderkey, n, 'part ' || l_partkey || ' & more' || chr(10) || 'from ' || l_suppkey AS text FROM lines WHERE n % 5 <> 4 AND l_orderkey % 11 <> 5)"""
_LEDGER = """
orders_ AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 19 AS m, 'paid ' || o_custkey || ' to him' AS plain FROM orders),
both_ AS (SELECT *, CASE WHEN o_orderkey % 13 = 3 THEN 'given' WHEN o_orderkey % 13 = 4 THEN NULL ELSE plain END AS got_entry, CASE WHEN o_orderkey % 5 > 0 THEN '#p' || o_orderkey % 7 END AS want_pointer,
  'x#p' || CASE WHEN o_orderkey % 11 = 1 THEN o_orderkey % 6 ELSE o_orderkey % 7 END AS got_pointer, 'L#r' || o_orderkey % 4 AS want_rubric, CASE WHEN o_orderkey % 17 <> 2 THEN 'urn#r' || o_orderkey % 4 END AS got_rubric
  FROM orders_ WHERE m NOT IN (16, 18))"""

_NAMES = f"""
persons AS (SELECT 'p' || s_suppkey AS pid, [{", ".join(f"'{g}'" for g in GIVEN)}][s_suppkey % {len(GIVEN)} + 1] AS given, translate(left(md5(CAST(s_suppkey AS VARCHAR)), 9), '{_LETTERS[0]}', '{_LETTERS[1]}') AS low FROM supplier),
said AS (SELECT *, upper(low[1]) || low[2:3] || low[5:] AS typo, given || ' ' || upper(low[1]) || low[2:3] || low[5:] AS mention FROM persons),
forms AS (SELECT pid, lower(given) AS form FROM persons UNION SELECT pid, low FROM persons),
weights AS (SELECT form, count(DISTINCT pid) AS df, ln((SELECT count(*) FROM persons) / count(DISTINCT pid)) AS weight FROM forms GROUP BY form)"""

_PARTS = "SELECT p_partkey, p_name, p_brand, CASE WHEN p_size > 10 THEN p_size END AS p_size FROM part"

ORACLES = {
    "csv_written": f"SELECT *, CAST(p_size AS VARCHAR) AS as_string FROM ({_PARTS})",
    "json_written": _PARTS,
    "parquet_written": "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#3'",
    "work_lists_written": "SELECT 'page' || page_id AS name, url FROM pages",
    "lines_written": "SELECT 'c' || c_custkey AS id, c_mktsegment AS segment, CAST(2 AS INTEGER) AS n FROM customer WHERE c_custkey % 5 > 1",
    "texts_listed": "SELECT n_nationkey, CASE WHEN n_nationkey % 4 > 0 THEN n_name ELSE '' END AS text, n_nationkey % 4 = 0 AS missing FROM nation",
    "log_appended": "SELECT s_suppkey, s_name FROM supplier",
    "one_text": """SELECT string_agg(n_name, '; ' ORDER BY n_nationkey) AS n_name, '{' || string_agg('"' || n_name || '":' || n_regionkey, ',' ORDER BY n_name) || '}' AS json FROM nation""",
    "served_models": """
WITH t AS (SELECT p_partkey AS k, ['Kimi-K2', 'qwen3', '', '', '', 'glm', ''][p_partkey % 7 + 1] AS kind FROM part)
SELECT kind || '/' || k AS model, CASE WHEN kind = 'Kimi-K2' THEN '{"thinking_config":{"type":"' || CASE WHEN k % 2 = 0 THEN 'enabled' ELSE 'disabled' END || '"}}'
  ELSE '{"chat_template_kwargs":{"enable_thinking":' || (k % 2 = 0) || '}}' END AS options FROM t WHERE kind <> ''""",
    "run_logs": """
WITH t AS (SELECT count(*) AS calls, CAST(sum(o_custkey % 7) AS BIGINT) AS i, CAST(sum(o_custkey % 11) AS BIGINT) AS o, count(*) FILTER (WHERE o_orderkey % 50 = 0) AS errors FROM orders)
SELECT 'echo' AS model, sha256('be brief') AS prompt_sha256, '{"max_tokens": 64, "temperature": 0}' AS params, calls, i AS tokens_in, o AS tokens_out, errors, i + o AS tokens, (i + o) / calls::DOUBLE AS tokens_per_entry, (i + o) / 4.0::DOUBLE AS tokens_per_second FROM t""",
    "class_probabilities": "WITH t AS (SELECT vec_id, embedding AS e, list_max(embedding) AS m FROM embeddings) SELECT vec_id, CAST(list_position(e, m) - 1 AS BIGINT) AS prediction, round(1.0 / list_sum(list_transform(e, lambda x: exp(CAST(x - m AS DOUBLE)))), 6) AS probability FROM t",
    "tagged_spans": """
WITH t AS (SELECT o_orderkey, CAST(length(CAST(o_orderkey AS VARCHAR)) AS INTEGER) AS n FROM orders)
SELECT o_orderkey, 'key' AS label, CAST(6 AS INTEGER) AS start, CAST(6 + n AS INTEGER) AS "end" FROM t UNION ALL SELECT o_orderkey, 'year', CAST(10 + n AS INTEGER), CAST(14 + n AS INTEGER) FROM t""",
    "customer_graph_weights": "SELECT CAST(o_custkey AS VARCHAR) AS dataset, CASE WHEN o_custkey % 13 = 0 OR o_custkey % 7 = 0 THEN 1 ELSE count(*) FILTER (WHERE o_orderkey % 3 < 2) END AS weight FROM orders GROUP BY o_custkey",
    "day_first_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders",
    "letter_tags": "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'opener:1 dateline:1 p:' || l_linenumber || ' closer:1' END AS tags FROM lineitem",
    "expanded_names": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || ',B' WHEN 1 THEN c_mktsegment ELSE '' END AS names FROM customer",
    "request_helpers": """
SELECT page_id, least(2.0 * pow(2, page_id % 8), 60.0)::DOUBLE AS wait, CASE WHEN page_id % 2 = 0 THEN page_id % 9 ELSE 5 END::DOUBLE AS after, 'a_b__' || page_id AS name, CASE WHEN page_id % 3 > 0 THEN 'one' || chr(10) || chr(10) || 'two' ELSE 'one' END AS prompt,
  CASE WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN 'url' ELSE 'other' END AS kind, 'a·b·' || page_id AS dotted, 'abc' AS short_title, CAST(1900 + page_id % 50 AS VARCHAR) AS year FROM pages""",
    "name_candidates": f"""
WITH RECURSIVE {_NAMES},
toks AS (SELECT mention, unnest([lower(given), lower(typo)]) AS token FROM said),
{lcs_sql("SELECT token AS a, form AS b FROM (SELECT DISTINCT token FROM toks), (SELECT DISTINCT form FROM forms)")},
alike AS (SELECT a AS token, b AS form, 200.0 * n / (length(a) + length(b)) AS ratio FROM lcs WHERE 200 * n >= 82 * (length(a) + length(b))),
part AS (SELECT token, pid, max(ratio / 100 * weight) AS part FROM alike JOIN weights USING (form) JOIN forms USING (form) GROUP BY token, pid),
scored AS (SELECT mention, pid, sum(2 * part) AS score FROM toks JOIN part USING (token) GROUP BY mention, pid)
SELECT mention, pid, round(score, 2) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY mention ORDER BY score DESC) = 1""",
    "name_likeness": f"WITH {_NAMES} SELECT mention, pid, round(200.0 * length(mention) / (2 * length(mention) + 1), 6)::DOUBLE AS similarity FROM said",
    "token_weights": f"WITH {_NAMES} SELECT form, df, round(weight, 9) AS weight FROM weights",
    "roman_values": """
WITH t AS (SELECT p_partkey, p_size, p_partkey % 4 AS h, p_partkey % 5 = 0 AND p_partkey % 4 > 0 AS half, p_partkey % 3 = 0 AS struck FROM part)
SELECT p_partkey, CAST(h * 100 + CASE WHEN half THEN 50 ELSE 0 END + p_size + CASE WHEN struck THEN 0.5 ELSE 0 END AS DOUBLE) AS value,
  CASE WHEN half OR struck THEN CAST(100 * (h + CASE WHEN half THEN 1 ELSE 0 END) + CASE WHEN half THEN 0.5 ELSE 0 END + p_size + CASE WHEN struck THEN 1.5 ELSE 0 END AS DOUBLE) END AS misread, CAST(NULL AS VARCHAR) AS reason FROM t""",
    "numeral_runs": f"""
SELECT p_partkey, {_ADDITIVE.format("p_size")} || '{_J}' AS run, p_size + 0.5::DOUBLE AS value, p_size + 1.5::DOUBLE AS misread FROM part
UNION ALL SELECT p_partkey, {_ADDITIVE.format("(p_size % 7 + 1)")} || ' x', CAST(p_size % 7 + 11 AS DOUBLE), NULL FROM part""",
    "denarii": """
WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q, l_linenumber AS n, l_linenumber % 4 AS form FROM lineitem),
u AS (SELECT *, CAST(CASE form WHEN 1 THEN q * 240 - n WHEN 3 THEN q + 0.25 ELSE q END AS DOUBLE) AS quantity, CASE form WHEN 1 THEN 'd' WHEN 2 THEN 'frhen' ELSE 'lbdwien' END AS unit FROM t),
v AS (SELECT *, CASE unit WHEN 'd' THEN quantity WHEN 'lbdwien' THEN quantity * 240 END AS denarii FROM u)
SELECT l_orderkey, l_linenumber, quantity, unit, form = 1 AS subtracted, denarii, denarii AS again FROM v""",
    "free_text_amounts": f"""
WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, {_ADDITIVE.format("q")} || ' lb.d.Wien.' AS span, CAST(q AS DOUBLE) AS quantity, 'lbdwien' AS unit, CAST(q * 240 AS DOUBLE) AS denarii FROM t
UNION ALL SELECT l_orderkey, l_linenumber, {_ADDITIVE.format("l_linenumber")} || ' gr.', CAST(l_linenumber AS DOUBLE), 'gr', l_linenumber * 7.5::DOUBLE FROM t""",
    "corrected_quantities": "SELECT p_partkey AS entry_id, p_size + CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 1.5 END::DOUBLE AS quantity, p_size + 0.5::DOUBLE AS corrected FROM part",
    "date_phrases": f"""
WITH src AS (SELECT o_orderkey FROM orders), {_date_sql("o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN 1455 + o_orderkey % 4 ELSE 1440 + o_orderkey % 50 END")}
SELECT o_orderkey, feast, iso, 'day' AS precision, CAST(year AS INTEGER) AS year, CASE WHEN o_orderkey % 3 = 0 THEN 'entry' ELSE 'fallback' END AS year_source, CAST(NULL AS VARCHAR) AS reason FROM moved""",
    "free_text_dates": f"""
WITH src AS (SELECT o_orderkey FROM orders), {_date_sql("o_orderkey", "1440 + o_orderkey % 50")}
SELECT o_orderkey, feast, iso, CAST(28 AS INTEGER) AS start, false AS ambiguous FROM moved""",
    "dated_or_year": f"""
WITH src AS (SELECT o_orderkey FROM orders), {_date_sql("o_orderkey", "1440 + o_orderkey % 50")}
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN iso WHEN o_orderkey % 4 = 1 THEN CAST(1440 + o_orderkey % 50 AS VARCHAR) WHEN o_orderkey % 8 < 4 THEN '1457' END AS iso FROM moved""",
    "phrase_marks": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'case' ELSE 'absent' END AS provenance, p_partkey % 5 < 2 AS deadline FROM part",
    "page_regions": f"""
WITH {_READING}, ordered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_orderkey % 3 > 0 THEN -n ELSE n END) - 1 AS place FROM regions)
SELECT '/in/abc/1905/' || l_orderkey || '.xml' AS path, 'r' || n AS region_id, CAST(place AS INTEGER) AS reading_order, text, false AS broken FROM ordered
UNION ALL SELECT DISTINCT '/in/abc/1905/' || l_orderkey || '.xml', NULL, NULL, NULL, true FROM lineitem WHERE l_orderkey % 11 = 5""",
    "page_boxes": f"""
WITH {_LINES}, t AS (SELECT *, CAST(l_quantity AS INTEGER) AS q FROM lines WHERE l_orderkey % 11 <> 5 AND 10 + 3 * n > 20)
SELECT '/in/abc/1905/' || l_orderkey || '.xml' AS path, 'r' || n AS region_id, 'region of ' || repeat('r', CAST(3 * n AS INTEGER)) AS text, CAST(q - n AS INTEGER) AS min_x, CAST(q + n AS INTEGER) AS max_x, CAST(n AS INTEGER) AS min_y, CAST(greatest(2 * n, n + 3) AS INTEGER) AS max_y FROM t""",
    "ground_truth": f"""
WITH {_LINES}, t AS (SELECT l_orderkey, unnest(CASE WHEN n % 5 <> 4 THEN ['part ' || l_partkey || ' &amp; more', 'from ' || l_suppkey] ELSE [] END || ['region of ' || repeat('r', CAST(3 * n AS INTEGER))]) AS u,
  n, unnest(CASE WHEN n % 5 <> 4 THEN [1, 2, 3] ELSE [3] END) AS k FROM lines),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n, k) AS place FROM t)
SELECT '/in/abc/1905/' || l_orderkey || '.xml' AS path, string_agg(u, '  ' ORDER BY place) AS gt FROM r WHERE place <= 2 GROUP BY l_orderkey""",
    "byte_tokens": """
WITH t AS (SELECT item_id, hex(encode('é漢 ' || left(text, 150))) AS h FROM benchmark)
SELECT item_id, array_to_string(list_transform(range(1, len(h), 2), lambda i: CAST(CAST('0x' || substr(h, i, 2) AS INTEGER) + 3 AS VARCHAR)) || ['1'], ',') AS ids, true AS again FROM t""",
    "judgements": """
WITH t AS (SELECT *, 'p' || user_id % 5 AS pid, user_id % 5 BETWEEN 1 AND 3 AS known, event_id % 4 AS form FROM events)
SELECT event_id, CASE WHEN form < 2 THEN CASE WHEN known THEN 'match' ELSE 'unsure' END WHEN form = 2 THEN 'new' ELSE 'error' END AS decision, CASE WHEN form < 2 AND known THEN pid ELSE '' END AS ids,
  CASE WHEN form = 2 THEN event_type END AS reason FROM t""",
    "answers_checked": "SELECT event_id, event_id % 4 IN (0, 2) AS type_ok, event_id % 5 <> 3 AS well_formed, event_id % 5 IN (0, 4) AS tei_ok FROM events",
    "path_functions": """
WITH t AS (SELECT *, 'paper' || o_orderkey % 9 AS news, CAST(year(o_orderdate) AS VARCHAR) AS y, o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '_enhanced' ELSE '' END AS stem, CASE WHEN o_orderkey % 4 = 0 THEN '/else/' ELSE '/in/' END AS root FROM orders)
SELECT o_orderkey, news AS newspaper, y AS year, stem AS page, '/out/' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE news || '/' || y || '/' END || stem || '.jpg' AS target, root || news || '/' || y || '/' || o_orderkey || '.png' AS image FROM t""",
    "model_file_rates": "SELECT p_partkey, CASE WHEN p_partkey % 6 <> 0 THEN round((1 - CAST('0.' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS DOUBLE)) * 100, 1) END AS cer FROM part",
    "batch_numbers": "WITH t AS (SELECT p_partkey AS n, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part) SELECT n, CAST(place // 25 AS BIGINT) AS batch FROM t WHERE n >= 10 AND n < 155",
    "affine_points": """
WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q, l_linenumber AS n FROM lineitem), p AS (SELECT l_orderkey, l_linenumber, 0 AS pos, q AS x, n AS y FROM t UNION ALL SELECT l_orderkey, l_linenumber, 1, n, q FROM t)
SELECT l_orderkey, l_linenumber, pos, CAST(-(y - 2) + 3 AS DOUBLE) AS x, CAST(x - 3 + 0.5 * (y - 2) + 2 AS DOUBLE) AS y FROM p""",
    "split_properties": f"""
WITH {_LINES}, t AS (SELECT l_orderkey, n, l_orderkey % 3 > 0 AND count_if(n % 3 <> 0) OVER (PARTITION BY l_orderkey) > 1 AS cut FROM lines)
SELECT CAST(l_orderkey AS VARCHAR) AS host, true AS was_split, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY 'm' || n) - 1 AS INTEGER) AS piece, 'm' || n AS ids FROM t WHERE cut
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), false, 0, string_agg('m' || n, ',' ORDER BY 'm' || n) FROM t WHERE NOT cut GROUP BY l_orderkey""",
    "back_references": """
WITH t AS (SELECT CAST(c_custkey AS VARCHAR) AS s, 'urn:bk#' || CASE c_custkey % 4 WHEN 1 THEN 'to' WHEN 2 THEN 'entry' ELSE 'from' END AS p, CASE c_custkey % 3 WHEN 0 THEN 'Eodem' WHEN 1 THEN lower(c_mktsegment) ELSE 'idem' END AS o FROM customer)
SELECT s, p, 'urn:t#' || CASE WHEN p <> 'urn:bk#entry' AND o IN ('Eodem', 'idem') THEN 'anonymous' ELSE o END AS o FROM t""",
    "validation_findings": f"""
WITH {_LEDGER},
all_ AS (
  SELECT 'id missing' AS "check", id, '1' AS expected, '0' AS actual, 'error' AS severity FROM orders_ WHERE m = 16
  UNION ALL SELECT 'id extra', id, '0', '1', 'error' FROM orders_ WHERE m = 18
  UNION ALL SELECT 'id duplicate', id, '1', '2', 'error' FROM orders_ WHERE m = 17
  UNION ALL SELECT 'entry text', id, plain, got_entry, 'error' FROM both_ WHERE got_entry <> plain
  UNION ALL SELECT 'entry missing', id, 'paid  ' || o_custkey || ' to him ', NULL, 'error' FROM both_ WHERE got_entry IS NULL
  UNION ALL SELECT 'pointer', id, want_pointer, got_pointer, 'error' FROM both_ WHERE want_pointer IS NOT NULL AND substr(want_pointer, 2) <> substr(got_pointer, 3)
  UNION ALL SELECT 'rubric', id, want_rubric, got_rubric, 'error' FROM both_ WHERE got_rubric IS NULL
  UNION ALL SELECT 'year', id, CAST(year(o_orderdate) AS VARCHAR), '1457-03-01', 'report' FROM orders_ WHERE m <> 18 AND o_orderkey % 6 = 0
  UNION ALL SELECT 'several dates', CAST(l_orderkey AS VARCHAR), '1', CAST(count(*) AS VARCHAR), 'report' FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1
) SELECT DISTINCT * FROM all_""",
    "applied_findings": f"""
WITH {_LEDGER}, copies AS (SELECT *, unnest(CASE WHEN m = 17 THEN [1, 2] ELSE [1] END) AS copy FROM orders_ WHERE m <> 16)
SELECT id, CASE WHEN o_orderkey % 13 = 4 THEN NULL WHEN o_orderkey % 13 = 3 AND m = 18 THEN 'given' ELSE plain END AS entry FROM copies""",
}
