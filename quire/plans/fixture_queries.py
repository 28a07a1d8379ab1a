"""Queries of operators over small inputs of our own; their SQL states the rows expected of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import answers, chunks, dates, geometry, numerals, text
from quire.operators import diffs, graph, metrics, models, repair, search, validate, windows
from quire.operators.joins import united
from quire.plans import fixtures, pipelines
from quire.sources import pages, readers, reports, triples


def _sql(rows: list[tuple], columns: str, longs: tuple[str, ...] = ()) -> str:
    def q(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    star = f"* REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in longs)})" if longs else "*"
    return f"SELECT {star} FROM (VALUES {', '.join('(' + ', '.join(map(q, r)) + ')' for r in rows)}) t({columns})"


def page_regions(spark: SparkSession, d: str) -> DataFrame:
    rows = pages.text_regions(spark.createDataFrame(fixtures.PAGES, "path string, text string"))
    return rows.select("path", "region_id", "reading_order", "text")


def page_boxes(spark: SparkSession, d: str) -> DataFrame:
    return pages.boxed_regions(spark.createDataFrame(fixtures.PAGES[:2], "path string, text string"), 20)


def ground_truth(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(fixtures.PAGES, "path string, text string").select("path", pages.ground_truth(F.col("text"), 2).alias("gt"))


def newspaper_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Regions normalised, cut, corrected by a stand-in that marks each chunk, and joined again."""

    def make():
        return lambda b: b.assign(post_corrected="<" + b["chunk"] + ">")

    out = pipelines.newspaper(spark.createDataFrame(fixtures.PAGES, "path string, text string"), make)
    return out.where("region_id IS NOT NULL").select("newspaper", "year", "page", "region_id", "post_corrected")


def manifest_pages(spark: SparkSession, d: str) -> DataFrame:
    return readers.manifest_pages(spark.createDataFrame(fixtures.MANIFESTS, "id string, manifest string"), "manifest")


def report_scores(spark: SparkSession, d: str) -> DataFrame:
    return reports.scores(spark.createDataFrame(fixtures.REPORTS, "path string, text string"))


def _graphs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixtures.GRAPHS, "graph string, text string")


def graph_scores(spark: SparkSession, d: str) -> DataFrame:
    scores, _ = pipelines.ledger_scores(_graphs(spark), "truth", "test")
    return scores.select("kind", "doc_pos", "common", "missing", "extra")


def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    _, summary = pipelines.ledger_scores(_graphs(spark), "truth", "test")
    return summary.where("kind <> 'combined'").select("kind", "micro_precision", "micro_recall")


def graph_entries(spark: SparkSession, d: str) -> DataFrame:
    return triples.entries(triples.triples(_graphs(spark)).where("error IS NULL"))


def property_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.property_counts(triples.triples(_graphs(spark)).where("graph = 'test'"))


def membership_added(spark: SparkSession, d: str) -> DataFrame:
    rows = repair.with_membership(triples.triples(_graphs(spark)).where("graph = 'truth' AND error IS NULL"))
    return rows.where(F.col("p").contains("isPartOf") | F.col("p").contains("isMemberOf")).select("s", text.local_name(F.col("p")).alias("p"), "o")


def repaired_text(spark: SparkSession, d: str) -> DataFrame:
    raw = "```xml\n<?xml version='1.0'?>\nHere you are\n<bk:unit rdf:resource=\"urn:x#Stück\"/> <bk:entry>stück</bk:entry>\n<!-- a\nb -->\n\n```"
    rows = spark.createDataFrame([(1, raw)], "id int, raw string")
    return rows.select("id", repair.cleaned(repair.commented(F.col("raw"))).alias("text"))


def back_references(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([("g", "a", "urn:bk#from", "urn:t#Eodem"), ("g", "a", "urn:bk#to", "urn:t#anna"), ("g", "a", "urn:bk#entry", "urn:t#idem")], "graph string, s string, p string, o string")
    return repair.without_back_references(rows).select("p", "o")


def split_properties(spark: SparkSession, d: str) -> DataFrame:
    rows = [("t1", "transfers", [("m1", "Money"), ("m2", "Money"), ("c1", "Commodity")]), ("t2", "transfers", [("m3", "Money")]), ("t3", "from", [("m4", "Money"), ("m5", "Money")])]
    df = spark.createDataFrame(rows, "host string, property string, children array<struct<id:string,class:string>>")
    return repair.split_properties(df).select("host", "was_split", "piece", F.array_join(F.transform("children", lambda c: c["id"]), ",").alias("ids"))


SOURCE = [("e1", "paid  to him", "1455", "#p1", "L#r_debts"), ("e2", "gave", "1455", None, "L#r1"), ("e3", "lost", "1456", None, None)]
ENCODED = [("e1", "paid to him", "x#p1", "urn#r_debts"), ("e2", "given", None, "urn#r2"), ("e2", "given", None, "urn#r2"), ("e9", "extra", None, None)]


def validation_findings(spark: SparkSession, d: str) -> DataFrame:
    source = spark.createDataFrame(SOURCE, "id string, entry string, year string, pointer string, rubric string")
    encoded = spark.createDataFrame(ENCODED, "id string, entry string, pointer string, rubric string")
    whens = spark.createDataFrame([("e1", "1455-03-01"), ("e2", "1457"), ("e3", "soon")], "id string, when string")
    parties = spark.createDataFrame(
        [("e1", "h1", "from", "#anna", "L#r_debts"), ("e1", "h1", "to", "x#anna", "L#r_debts"), ("e2", "h2", "from", "#debts", "L#r_debts"), ("e2", "h2", "to", "#debts", "L#r_debts"), ("e3", "h3", "credit", "#anonymous", None), ("e3", "h3", "debit", "#anonymous", None)],
        "id string, host string, role string, party string, rubric string",
    )
    hosts = spark.createDataFrame([("h1",), ("h1",), ("h2",)], "host string")
    found = validate.completeness(source, encoded).union(validate.fields(source, encoded)).union(validate.years(source, whens)).union(validate.same_party(parties)).union(validate.several_dates(hosts))
    return found.distinct()


FINDINGS = [
    ("id duplicate", "e2", "1", "2", "error"), ("id missing", "e3", "1", "0", "error"), ("id extra", "e9", "0", "1", "error"), ("entry text", "e2", "gave", "given", "error"), ("rubric", "e2", "L#r1", "urn#r2", "error"),
    ("year", "e2", "1455", "1457", "report"), ("same party", "e1", "from/to of h1", "anna", "error"), ("several dates", "h1", "1", "2", "report"),
]


def applied_findings(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(ENCODED[:2], "id string, entry string, pointer string, rubric string")
    found = validate.fields(spark.createDataFrame(SOURCE, "id string, entry string, year string, pointer string, rubric string"), rows)
    return validate.applied(rows, found, "entry text", "entry", F.lit(True)).select("id", "entry")


def corrected_quantities(spark: SparkSession, d: str) -> DataFrame:
    entries = spark.createDataFrame([(1, "item viij̸ sch."), (2, "item viij̸ et viiij̸ et viii"), (3, "xx")], "entry_id int, entry string")
    quantities = spark.createDataFrame([(1, 8.5), (1, 7.5), (2, 8.5), (2, 9.5), (3, 20.0)], "entry_id int, quantity double")
    return numerals.corrected_quantities(quantities, entries).select("entry_id", "quantity", "corrected")


def _persons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixtures.PERSONS_SCHEMA_ROWS, readers.PERSONS)


def _digests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixtures.DIGEST_ROWS, readers.DIGESTS)


def name_candidates(spark: SparkSession, d: str) -> DataFrame:
    said = spark.createDataFrame([("Hans Muler",), ("Kg",), ("Peter Schmidt",), ("der Papst",), ("nobody",)], "mention string")
    return search.candidates(said, _persons(spark)).select("mention", "pid", "rank")


def reconciled(spark: SparkSession, d: str) -> DataFrame:
    out = pipelines.reconciliation(_digests(spark), _persons(spark), pipelines.by_similarity())
    return out.select("id", "mention", "kind", "decision", F.array_join("entity_ids", ",").alias("entity_ids"))


def reconciled_scores(spark: SparkSession, d: str) -> DataFrame:
    out = pipelines.reconciliation(_digests(spark), _persons(spark), pipelines.by_similarity())
    return pipelines.reconciliation_scores(_digests(spark), out)["rows"].select("mention", "bucket", "outcome")


def united_candidates(spark: SparkSession, d: str) -> DataFrame:
    a = spark.createDataFrame([("m", "p1", 1), ("m", "p2", 2)], "mention string, pid string, rank_in int")
    b = spark.createDataFrame([("m", "p2", 1), ("m", "p3", 2), ("m", "p4", 3)], "mention string, pid string, rank_in int")
    return united(a, b, ["mention"], "pid", "rank_in", 3).select("mention", "pid", "rank")


def answers_checked(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(
        [("a", "Abbreviation; Correction", "<choice><abbr>d</abbr><expan>den</expan></choice>"), ("b", "Other", "<b>x</b>"), ("c", "Omission", "<gap n='1'/>"), ("d", None, "<gap>")], "k string, types string, tei string"
    )
    return rows.select("k", text.types_in_list(F.col("types"), answers.INTERVENTION_TYPES).alias("type_ok"), answers.well_formed(F.col("tei")).alias("well_formed"), answers.tags_allowed(F.col("tei")).alias("tei_ok"))


def judgements(spark: SparkSession, d: str) -> DataFrame:
    raws = [("a", '[{"decision":"match","entity_id":"p1"}]'), ("b", '```json\n{"decision":"match","entity_ids":["p9"]}\n```'), ("c", '<think>{}</think>{"decision":"new","entity_ids":[],"reason":"r"}'), ("d", "no json")]
    rows = spark.createDataFrame(raws, "k string, raw string").select("k", answers.judgement(F.col("raw"), F.array(F.lit("p1"), F.lit("p2"))).alias("j"))
    return rows.select("k", "j.decision", F.array_join("j.entity_ids", ",").alias("ids"), "j.reason")


def cached_answers(spark: SparkSession, d: str) -> DataFrame:
    asked = models.requests(spark.createDataFrame([("s", "one"), ("s", "two"), ("s", "one")], "sys string, usr string"), "sys", "usr", "echo")
    first = models.answered(asked.where("usr = 'one'"), spark.createDataFrame([], models.ANSWERS), models.EchoProvider, "sys", "usr", "echo")
    more = models.answered(asked, first, models.EchoProvider, "sys", "usr", "echo")
    return more.select(answers.cleaned(F.col("content")).alias("answer"), "finish_reason", "attempts")


def word_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "a b c", "a x c d"), (2, "same", "same"), (3, None, "new")], "id int, a string, b string")
    return rows.select("id", diffs.words_changed(F.col("a"), F.col("b")).alias("diff"))


def seeded_draw(spark: SparkSession, d: str) -> DataFrame:
    """Draws with replacement: every item has one of three choices, the same however the rows are dealt."""
    items, choices = spark.range(0, 300).select(F.col("id").alias("item")), spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ordinal long, choice string")
    one = readers.seeded_choice(items, choices, 7, "item", "choice")
    two = readers.seeded_choice(items.repartition(5), choices, 7, "item", "choice").withColumnRenamed("choice", "again")
    return one.join(two, "item").agg(F.count("*").alias("n"), F.count_if(F.col("choice") == F.col("again")).alias("same"), F.count_distinct("choice").alias("kinds"))


def rounded_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, 0.0375), (2, 0.0625), (3, 2 / 3)], "id int, f1 double")
    return metrics.rounded(rows, ("f1",))


def model_file_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([("run_0.93.mlmodel",), ("run_0.871.mlmodel",), ("notes.txt",)], "name string")
    return rows.select("name", reports.file_metric(F.col("name")).alias("cer"))


def path_functions(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    rows = spark.createDataFrame([("/in/abc/1905/x_enhanced.jpg",), ("/else/y.jpg",)], "path string")
    return rows.select("path", text.path_parts(p)["newspaper"].alias("newspaper"), text.path_parts(p)["page"].alias("page"), text.mirrored(p, "/in", "/out").alias("target"), text.image_name(p).alias("image"))


def batch_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.batches(spark.range(0, 60).withColumnRenamed("id", "n"), "n", 25)
    return rows.where(text.in_batch(F.col("n"), "10-55")).groupBy("batch").agg(F.count("*").alias("n"))


def free_text_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "Item solvit Geori in die Martini et feria 2a post Oculi"), (2, "nichil"), (3, None)], "id int, entry string")
    found = rows.select("id", F.explode(dates.find_dates(F.col("entry"), F.lit(1455))).alias("x"))
    return found.where("x.iso IS NOT NULL").select("id", "x.feast", "x.iso")


def free_text_amounts(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "item v lb. d. Wien. et xx gr."), (2, "nichil")], "id int, entry string")
    return rows.select("id", F.explode(numerals.find_amounts(F.col("entry"))).alias("a")).select("id", "a.span", "a.quantity", "a.unit", numerals.denarii(F.col("a.quantity"), F.col("a.unit")).alias("denarii"))


def numeral_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "item viij̸ sch. et ij̸e lb. xxx ix d.")], "id int, entry string")
    return rows.select("id", F.explode(numerals.find_numerals(F.col("entry"))).alias("r")).select("id", "r.run", "r.value", "r.misread")


def phrase_marks(spark: SparkSession, d: str) -> DataFrame:
    """How copied phrases stand in their entries, and whether entries name a day to pay by."""
    rows = spark.createDataFrame([("in die Martini", "solvet in die Martini"), ("in Die martini", "dedit in die Martini"), ("dominica", "nichil")], "phrase string, entry string")
    return rows.select("phrase", dates.provenance(F.col("phrase"), F.col("entry")).alias("provenance"), dates.has_deadline(F.col("entry")).alias("deadline"))


def dated_or_year(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([("in die Martini", "1455", []), ("nichil", "1456", ["1450-01-01"]), ("nichil", "", ["anno", "1457-02-01"]), ("nichil", None, [])], "phrase string, year string, dates array<string>")
    resolved = dates.resolve_phrase(F.col("phrase"), F.col("year").try_cast("int"))
    return rows.select("phrase", "year", dates.date_or_year(resolved, F.col("year"), F.col("dates")).alias("iso"))


def byte_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([("é",), ("",), (None,)], "t string").select("t", chunks.byte_tokens(F.col("t")).alias("ids"))
    return rows.select("t", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), chunks.from_byte_tokens(F.col("ids")).alias("again"))


def name_likeness(spark: SparkSession, d: str) -> DataFrame:
    pairs = spark.createDataFrame([("Hans Muller", "p1"), ("Graf Lang Schmidt", "p2"), ("Eneas", "p3")], "mention string, pid string")
    return search.name_similarity(pairs, _persons(spark)).select("mention", "pid", F.round("similarity", 6).alias("similarity"))


def person_cards(spark: SparkSession, d: str) -> DataFrame:
    return search.rendered(_persons(spark)).where("pid <> 'p1'")


def match_scores(spark: SparkSession, d: str) -> DataFrame:
    out = pipelines.reconciliation(_digests(spark), _persons(spark), pipelines.by_similarity())
    return pipelines.reconciliation_scores(_digests(spark), out)["prf"].select("decision", "tp", "fp", "fn")


def line_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "a\nb\nc\nd", "a\nx\nc\nd")], "id int, a string, b string")
    return rows.select("id", F.posexplode(diffs.lines_changed(F.col("a"), F.col("b"))).alias("pos", "c")).select("id", "pos", "c.op", "c.text")


def affine_points(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([("2,0 0,2",)], "points string")
    moved = geometry.sheared_rotated(geometry.polygon(F.col("points")), F.lit(0.5), F.lit(90.0), F.lit(0), F.lit(0))
    return rows.select(F.posexplode(moved).alias("pos", "p")).select("pos", F.round("p.x", 6).cast("int").alias("x"), F.round("p.y", 6).cast("int").alias("y"))


QUERIES = [
    free_text_dates, free_text_amounts, numeral_runs, phrase_marks, dated_or_year, byte_tokens, name_likeness, person_cards, match_scores, line_changes, affine_points,
    page_regions, page_boxes, ground_truth, newspaper_pipeline, manifest_pages, report_scores, graph_scores, graph_summary, graph_entries, property_counts, membership_added, repaired_text, back_references,
    split_properties, validation_findings, applied_findings, corrected_quantities, name_candidates, reconciled, reconciled_scores, united_candidates, answers_checked, judgements, cached_answers, word_changes,
    seeded_draw, rounded_scores, model_file_rates, path_functions, batch_numbers,
]

ORACLES = {
    "free_text_dates": _sql([(1, "martini", "1455-11-11"), (1, "oculi", "1455-03-10")], "id, feast, iso"),
    "free_text_amounts": _sql([(1, "v lb.d.Wien.", 5.0, "lbdwien", 1200.0), (1, "xx gr.", 20.0, "gr", 150.0)], "id, span, quantity, unit, denarii"),
    "numeral_runs": _sql([(1, "viij̸", 7.5, 8.5), (1, "ij̸", 1.5, 2.5), (1, "xxx ix", 39.0, None)], "id, run, value, misread"),
    "phrase_marks": _sql([("in die Martini", "exact", True), ("in Die martini", "case", False), ("dominica", "absent", False)], "phrase, provenance, deadline"),
    "dated_or_year": _sql([("in die Martini", "1455", "1455-11-11"), ("nichil", "1456", "1456"), ("nichil", "", "1457"), ("nichil", None, None)], "phrase, year, iso"),
    "byte_tokens": _sql([("é", "198,172,1", "é"), ("", "1", ""), (None, "1", "")], "t, ids, again"),
    "name_likeness": _sql([("Hans Muller", "p1", 100.0), ("Graf Lang Schmidt", "p2", round(200 * 7 / 24, 6)), ("Eneas", "p3", 100.0)], "mention, pid, similarity"),
    "person_cards": _sql(
        [("p2", "- id: p2\n  label: Peter Schmidt-Lang\n  aliases: Faber\n  attested: 1440 to 1441, digests: 1, places: -"), ("p3", "- id: p3\n  label: Papst Pius\n  spellings: Eneas\n  attested: 1458 to 1464, digests: 0, places: Rom")],
        "pid, card",
    ),
    "match_scores": _sql([("match", 1, 0, 1), ("new", 1, 1, 0)], "decision, tp, fp, fn", ("tp", "fp", "fn")),
    "line_changes": _sql([(1, 0, "=", "a"), (1, 1, "-", "b"), (1, 2, "+", "x"), (1, 3, "=", "c")], "id, pos, op, text"),
    "affine_points": _sql([(0, 0, 2), (1, -2, 1)], "pos, x, y"),
    "page_regions": _sql(fixtures.REGION_ROWS, "path, region_id, reading_order, text"),
    "page_boxes": _sql([("/in/abc/1905/p1.xml", "b", "a region text of some length", 0, 9, 0, 9)], "path, region_id, text, min_x, max_x, min_y, max_y"),
    "ground_truth": _sql([("/in/abc/1905/p1.xml", "late  ﬁrst line"), ("/in/abc/1905/p2.xml", ""), ("/in/xyz/1906/p3.xml", "late  ﬁrst line")], "path, gt"),
    "newspaper_pipeline": _sql(
        [("abc", "1905", "p1", "c", "<top>"), ("abc", "1905", "p1", "b", "<first line\nsecond>"), ("abc", "1905", "p1", "a", "<late>"), ("xyz", "1906", "p3", "a", "<late>"), ("xyz", "1906", "p3", "b", "<first line\nsecond>"), ("xyz", "1906", "p3", "c", "<top>")],
        "newspaper, year, page, region_id, post_corrected",
    ),
    "manifest_pages": _sql(fixtures.MANIFEST_PAGES, "id, version, status, issue_year, page, image_url"),
    "report_scores": _sql(fixtures.REPORT_SCORES, "dataset, model, section, avg, metric, value"),
    "graph_scores": _sql(fixtures.GRAPH_SCORES, "kind, doc_pos, common, missing, extra"),
    "graph_summary": _sql([("exact", 11 / 13, 11 / 12), ("identifier", 11 / 13, 11 / 12), ("structural", 12 / 13, 1.0)], "kind, micro_precision, micro_recall"),
    "graph_entries": _sql([("truth", "urn:t#T1", "Transaction", 0), ("truth", "urn:t#T2", "Transaction", 1), ("truth", "urn:t#N1", "Note", 2), ("test", "urn:t#T1", "Transaction", 0), ("test", "urn:t#T9", "Transaction", 1)], "graph, entry, class, doc_pos"),
    "property_counts": _sql(
        [("test", "Money", "with_unit", 2), ("test", "Money", "with_quantity", 2), ("test", "Money", "with_all", 2), ("test", "Money", "total", 2), ("test", "Transfer", "with_transfers", 2), ("test", "Transfer", "with_from", 2), ("test", "Transfer", "with_when", 1), ("test", "Transfer", "total", 2)],
        "graph, class, measure, n", ("n",),
    ),
    "membership_added": _sql([(f"urn:t#{e}", p, o) for e in ("T1", "T2", "N1") for p, o in (("isPartOf", "urn:t"), ("isMemberOfCollection", "https://gams.uni-graz.at/context:arec"))], "s, p, o"),
    "repaired_text": _sql([(1, '\n\n\n<bk:unit rdf:resource="urn:x#piece"/> <bk:entry>stück</bk:entry>\n\n')], "id, text"),
    "back_references": _sql([("urn:bk#from", "urn:t#anonymous"), ("urn:bk#to", "urn:t#anna"), ("urn:bk#entry", "urn:t#idem")], "p, o"),
    "split_properties": _sql([("t1", True, 0, "m1"), ("t1", True, 1, "m2"), ("t1", True, 2, "c1"), ("t2", False, 0, "m3"), ("t3", False, 0, "m4,m5")], "host, was_split, piece, ids"),
    "validation_findings": _sql(FINDINGS, '"check", id, expected, actual, severity'),
    "applied_findings": _sql([("e1", "paid to him"), ("e2", "gave")], "id, entry"),
    "corrected_quantities": _sql([(1, 8.5, 7.5), (1, 7.5, 7.5), (2, 8.5, 8.5), (2, 9.5, 8.5), (3, 20.0, 20.0)], "entry_id, quantity, corrected"),
    "name_candidates": _sql([("Hans Muler", "p1", 1), ("Kg", "p1", 1), ("Peter Schmidt", "p2", 1), ("der Papst", "p3", 1)], "mention, pid, rank"),
    "reconciled": _sql([("d1", "Hans Muler", "direct", "match", "p1"), ("d1", "der Papst", "indirect", "new", ""), ("d1", "Nobody", "direct", "new", None)], "id, mention, kind, decision, entity_ids"),
    "reconciled_scores": _sql([("Hans Muler", "10+", "correct"), ("der Papst", "unbucketed", "called new"), ("Nobody", "new", "correct")], "mention, bucket, outcome"),
    "united_candidates": _sql([("m", "p1", 1), ("m", "p2", 2), ("m", "p3", 3)], "mention, pid, rank"),
    "answers_checked": _sql([("a", True, True, True), ("b", False, True, False), ("c", True, True, False), ("d", False, False, False)], "k, type_ok, well_formed, tei_ok"),
    "judgements": _sql([("a", "match", "p1", None), ("b", "unsure", "", None), ("c", "new", "", "r"), ("d", "error", "", None)], "k, decision, ids, reason"),
    "cached_answers": _sql([("two", "stop", 1)], "answer, finish_reason, attempts"),
    "word_changes": _sql([(1, "a [-b-] {+x+} c {+d+}"), (2, "same"), (3, "{+new+}")], "id, diff"),
    "seeded_draw": _sql([(300, 300, 3)], "n, same, kinds", ("n", "same", "kinds")),
    "rounded_scores": _sql([(1, 0.037), (2, 0.062), (3, 0.667)], "id, f1"),
    "model_file_rates": _sql([("run_0.93.mlmodel", 7.0), ("run_0.871.mlmodel", 12.9), ("notes.txt", None)], "name, cer"),
    "path_functions": _sql([("/in/abc/1905/x_enhanced.jpg", "abc", "x_enhanced", "/out/abc/1905/x_enhanced.jpg", "/in/abc/1905/x.png"), ("/else/y.jpg", "", "y", "/out/y.jpg", "/else/y.png")], "path, newspaper, page, target, image"),
    "batch_numbers": _sql([(0, 15), (1, 25), (2, 5)], "batch, n", ("batch", "n")),
}
