"""Queries of operators whose inputs are written from the driver tables: alignments, scores, reconciliation, manifests, reports, repair, model calls, the calendar.

As in ``written_queries`` the SQL gets the rows from the keys and numbers that were written, without reading what the operator reads.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions import answers, calendar, dates, geometry
from quire.operators import aggregates, alignment, diffs, graph, metrics, models, repair, search
from quire.operators.joins import nearest_century, united
from quire.plans import graph_queries, pipelines, table_queries, written_queries
from quire.plans.text_queries import EASTER_SQL, ORACLES as TEXT_ORACLES
from quire.session import dealt
from quire.sources import folders, pages, readers, reports, service, triples

table = readers.table


def line_changes(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations against a version that lacks every third and has notes put in."""
    turns, key = table(spark, d, "conversations"), (F.col("conv_id") + F.col("turn")) % 3
    line = F.concat(F.col("turn").cast("string"), F.lit(" "), F.coalesce("role", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))).alias("line")
    left = turns.select("conv_id", F.col("turn").alias("pos"), line)
    notes = turns.where("turn % 4 = 0").select("conv_id", (F.col("turn") * 2 + 1).alias("pos"), F.concat(F.lit("note on "), F.col("turn")).alias("line"))
    return alignment.aligned(left, turns.where(key != 0).select("conv_id", (F.col("turn") * 2).alias("pos"), line).union(notes), "conv_id", "pos", "line")


def word_changes(spark: SparkSession, d: str) -> DataFrame:
    """Part names whose last word is another one, and one more word behind."""
    name = F.col("p_name")
    new = F.concat(F.regexp_replace(name, r"\S+$", "X"), F.lit(" Y"))
    return table(spark, d, "part").select("p_partkey", diffs.words_changed(name, new).alias("diff"))


def graph_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Entries compared side by side as their lists align: a missing order shifts nothing."""
    rows = folders.kept(graph_queries.ledger(spark, d))
    items = folders.kept(graph.unfolded(rows, triples.entries(rows)))
    scores = graph.compared(graph.aligned(items, "truth", "test"), "truth", "test", "place")
    return scores.select("kind", "place.gap", "place.nth", "common", "missing", "extra")


def rounded_scores(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rounded(table_queries.multiset_prf(spark, d)).select("conv_id", "precision", "recall", "f1")


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Pages of orders with new texts for a third of their lines, and none for another third; those that are not named stay."""
    lines = written_queries._lines(spark, d)
    n, point = F.col("n"), F.lit("0,0 1,1")
    one = F.struct(n, F.concat(F.lit("l"), n).alias("id"), point.alias("points"), point.alias("baseline"), F.concat(F.lit("old & "), F.col("l_partkey")).alias("text"))
    listed = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("lines"))  # an order's few lines
    path = F.col("l_orderkey").cast("string").alias("path")
    xml = listed.select(path, pages.page_xml(F.lit("p.jpg"), F.lit(10), F.lit(20), F.col("lines")).alias("text"))
    new = lines.where(n % 3 < 2).select(path, F.concat(F.lit("l"), n).alias("line_id"), F.when(n % 3 == 0, F.concat(F.lit("new < "), F.col("l_suppkey"))).alias("text"))
    return pages.with_line_texts(xml, new)


def doubtful_feasts(spark: SparkSession, d: str) -> DataFrame:
    """How often phrases name each of five feasts, two of them of doubtful day."""
    names = F.array(*map(F.lit, ["Sixti pape", "Petri martyris", "Kiliani", "Martini", "Blasii"]))
    phrase = F.concat(F.lit("in die "), F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int")))
    found = dealt(table(spark, d, "part").select("p_partkey"), "p_partkey").select(dates.resolve_phrase(phrase, F.lit(1455)).alias("r")).select("r.feast")
    return dates.feasts_used(found)


def manifest_pages(spark: SparkSession, d: str) -> DataFrame:
    """A manifest for each page: of version 3 with two pictures, of version 2 with one, or of no known structure; written as the pages of a service and read from it."""
    key = F.col("page_id").cast("string")
    three = F.concat(
        F.lit('{"metadata":[{"label":{"de":["Jahr"]},"value":{"de":["ca. '), 1800 + F.col("page_id") % 100, F.lit('"]}}],"items":[{"items":[{"items":[{"motivation":"painting","body":{"id":"http://x/a","service":[{"id":"http://x/s/'), key,
        F.lit('"}]}},{"motivation":"other","body":{"id":"no"}}]}]},{"items":[{"items":[{"motivation":"painting","body":{"id":"http://x/b'), key, F.lit('.jpg"}}]}]}]}'),
    )
    two = F.concat(F.lit('{"sequences":[{"canvases":[{"images":[{"resource":{"service":{"@id":"http://y/'), key, F.lit('/"}}}]}]}]}'))
    kind = F.col("page_id") % 3
    body = F.when(kind == 0, three).when(kind == 1, two).otherwise('{"other":1}')
    path = folders.scratch(spark, "service")
    # Fifty manifests to a page of the service.
    records = table(spark, d, "pages").select(F.floor(F.col("page_id") / 50).alias("page"), F.to_json(F.struct(F.col("page_id").alias("id"), body.alias("body"))).alias("value"))
    records.repartition("page").write.partitionBy("page").text(path)
    service.register(spark)
    served = spark.read.format("paged_service").option("path", path).load().where("error IS NULL")
    return readers.manifest_pages(served.select(F.col("id").cast("long").alias("page_id"), F.col("body").alias("manifest")), "manifest")


def image_status(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of a page's picture: there already, unknown, or found."""
    key = F.col("page_id") % 3
    name = F.when(key == 0, F.lit("https://x/a.jpg")).otherwise(F.concat(F.col("page_id").cast("string"), F.lit(".jpg")))
    rows = table(spark, d, "pages").select("page_id", readers.status_of(name, F.when(key == 1, F.col("url"))).alias("status"))
    return rows


def report_scores(spark: SparkSession, d: str) -> DataFrame:
    """A report for each supplier, with figures made of its key."""
    key, digits = F.col("s_suppkey"), lambda c: F.format_string("%03d", F.pmod(c, F.lit(1000)))
    row = lambda name, k: F.concat(F.lit(f"<tr><th>{name}</th>"), *(F.concat(F.lit("<td> <b>0."), digits(k + i), F.lit("</b></td>")) for i in range(3)), F.lit("</tr>"))
    html = F.concat(F.lit("<h1>Report</h1><h2 class='x'>Structure</h2><table>"), row("Macro", key), row("Micro", key * 3), F.lit("</table><h2>Exact <i>match</i></h2>"), row("macro average", key * 7), row("other", key))
    path = F.concat(F.lit("/r/"), F.when(key % 10 == 0, "readme").otherwise(F.lit("L")), key.cast("string"), F.lit("_model-"), (key % 4).cast("string"), F.lit(".html"))
    return reports.scores(table(spark, d, "supplier").select(path.alias("path"), html.alias("text")))


def repaired_text(spark: SparkSession, d: str) -> DataFrame:
    """Answers with a fence, a nested declaration, talk between the tags, and a unit that is also a word."""
    key = F.col("o_orderkey").cast("string")
    raw = F.concat(F.lit("```xml\n<?xml version='1.0'?>\nHere is "), key, F.lit('\n<bk:unit rdf:resource="urn:x#Stück"/> <bk:entry>stück '), key, F.lit("</bk:entry>\n<!-- a\n"), key, F.lit(" -->\n\n```"))
    return table(spark, d, "orders").select("o_orderkey", repair.cleaned(repair.commented(raw)).alias("text"))


class Unsteady(models.EchoProvider):
    """Fails on schedule: a prompt that ends in n is refused n % 4 times."""

    def __init__(self) -> None:
        self.asked: Counter[str] = Counter()

    def generate(self, system: str, user: str, model: str, max_tokens: int, temperature: float, thinking: bool) -> models.Answer:
        self.asked[user] += 1
        if self.asked[user] <= int(user.split()[-1]) % 4:
            raise TimeoutError(user)
        return super().generate(system, user, model, max_tokens, temperature, thinking)


def cached_answers(spark: SparkSession, d: str) -> DataFrame:
    """Prompts about parts, many of them the same: half are answered first, then the rest, with retries; refused ones are rows with an error."""
    asked = table(spark, d, "part").select(F.lit("s").alias("sys"), F.concat(F.lit("part "), F.col("p_partkey") % 1000).alias("usr"), (F.col("p_partkey") % 2 == 0).alias("even"))
    asked = models.requests(asked, "sys", "usr", "echo")
    first = folders.kept(models.answered(asked.where("even"), spark.createDataFrame([], models.ANSWERS), Unsteady, "sys", "usr", "echo"))
    more = models.answered(asked, first, Unsteady, "sys", "usr", "echo")
    known = asked.select("key", "usr").distinct()
    both = first.where("error IS NULL").withColumn("round", F.lit(1)).unionByName(more.withColumn("round", F.lit(2)))
    return both.join(known, "key").select("usr", "round", F.when(F.col("error").isNull(), answers.cleaned(F.col("content"))).alias("answer"), "attempts", "error")


def united_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Two candidate lists of parts for each brand, by key and by size."""
    parts = table(spark, d, "part")
    ranked = lambda by, k: table_queries.windows.top_k(parts, ["p_brand"], by, k).select(F.col("p_brand").alias("mention"), F.col("p_partkey").alias("pid"), F.col("rank").alias("rank_in"))
    lists = ranked([F.col("p_partkey")], 2), ranked([F.desc("p_size"), F.col("p_partkey")], 4)
    return united(*lists, ["mention"], "pid", "rank_in", 4).select("mention", "pid", "rank")


def seeded_draw(spark: SparkSession, d: str) -> DataFrame:
    """Draws with replacement for every customer, the same however the rows are dealt."""
    items, choices = table(spark, d, "customer").select(F.col("c_custkey").alias("item")), spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ordinal long, choice string")
    one = readers.seeded_choice(items, choices, 7, "item", "choice")
    two = readers.seeded_choice(items.repartition(5), choices, 7, "item", "choice").withColumnRenamed("choice", "again")
    return one.join(two, "item").agg(F.count("*").alias("n"), F.count_if(F.col("choice") == F.col("again")).alias("same"), F.count_distinct("choice").alias("kinds"))


def person_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards of persons with spellings, aliases, places and examples, some without."""
    k, text = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    said = lambda letter: F.concat(F.lit(letter), text)
    none = F.array().cast("array<string>")
    example = F.struct(F.lit("d1").alias("digest_id"), F.lit("1455").alias("date"), F.concat(F.lit("of "), text).alias("text"))
    profile = F.struct(
        F.array(said("F")).alias("mention_forms"), F.lit("1440").alias("date_min"), F.concat(F.lit("14"), 50 + k % 50).alias("date_max"), F.array_repeat(F.lit("d"), (k % 3).cast("int")).alias("digests"),
        F.when(k % 2 == 0, F.array(said("P"), F.lit("Q"))).otherwise(none).alias("places"), F.when(k % 4 == 0, F.array(example)).otherwise(F.array()).alias("examples"),
    )
    known = {"id": said("p"), "headword": said("H"), "label": said("L"), "variants": F.array(said("V"), F.lit("")), "aliases": F.when(k % 3 == 0, F.array(said("A"), F.lit("B"))).otherwise(none), "profile": profile}
    kinds = StructType.fromDDL(readers.PERSONS)
    persons = table(spark, d, "supplier").select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])
    return search.rendered(persons)


def _digests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Digests that mention a person each, misspelt; every fifth one nobody of the catalogue. Gold: some name another person, some are not in the text."""
    mentions, persons = written_queries._named_suppliers(spark, d)
    k = F.regexp_extract("pid", r"\d+", 0).cast("long")
    name = F.when(k % 5 == 0, F.concat(F.lit("Zyxwvut"), k)).otherwise(F.col("mention"))
    kind = F.when(k % 4 == 0, "indirect").otherwise("direct")
    said = F.struct(name.alias("text"), kind.alias("kind"))
    entity = F.when((k % 7 == 0) & (k % 5 != 0), "p0").otherwise(F.col("pid"))
    gold = F.struct(entity.alias("entity_id"), F.when((k % 5 == 0) & (k % 2 == 0), "new").otherwise("known").alias("status"), (k % 12).cast("int").alias("catalogue_digests"), (k % 11 == 0).alias("absent_in_text"), said.alias("mention"))
    known = {"id": F.concat(F.lit("d"), k), "mentions": F.array(said), "gold": F.array(gold)}
    kinds = StructType.fromDDL(readers.DIGESTS)
    return mentions.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds]), persons


def reconciled(spark: SparkSession, d: str) -> DataFrame:
    out = pipelines.reconciliation(*_digests(spark, d), pipelines.by_similarity(), pipelines.WEAK)
    return out.select("id", "mention", "kind", "decision", F.array_join("entity_ids", ",").alias("entity_ids"))


def _outcomes(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    digests, persons = _digests(spark, d)
    return pipelines.reconciliation_scores(digests, folders.kept(pipelines.reconciliation(digests, persons, pipelines.by_similarity(), pipelines.WEAK)))


def reconciled_scores(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d)["rows"].select("id", "mention", "bucket", "outcome")


def match_scores(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d)["prf"].select("decision", "tp", "fp", "fn")


def kind_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _outcomes(spark, d)["kinds"].select("kind", F.round("accuracy", 9).alias("accuracy"), "n")


def newspaper_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The pages of all orders: regions normalised, cut, corrected by a stand-in that marks each chunk, and joined again."""

    def make():
        return lambda b: b.assign(post_corrected="<" + b["chunk"] + ">")

    out = pipelines.newspaper(written_queries._pages(spark, d), make)
    return out.where("region_id IS NOT NULL").select("newspaper", "year", "page", "region_id", "post_corrected")


def _years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select((1400 + F.col("o_orderkey") % 200).cast("int").alias("year")).distinct()


def julian_easter(spark: SparkSession, d: str) -> DataFrame:
    return _years(spark, d).select("year", calendar.julian_easter(F.col("year")).cast("string").alias("easter"))


def advent(spark: SparkSession, d: str) -> DataFrame:
    return _years(spark, d).select("year", *[calendar.advent_sunday(F.col("year"), F.lit(n)).cast("string").alias(f"advent_{n + 1}") for n in range(4)])


def feast_dates(spark: SparkSession, d: str) -> DataFrame:
    return calendar.feast_dates(_years(spark, d), calendar.feast_table(spark)).select("year", "feast", F.col("feast_date").cast("string").alias("feast_date"))


def century_years(spark: SparkSession, d: str) -> DataFrame:
    """Years of two digits, near a year that is known."""
    near = F.element_at(F.array(*map(F.lit, [1398, 1401, 1455, 1499])), (F.col("o_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", nearest_century(F.col("o_orderkey") % 100, near).alias("year"))


def affine_back(spark: SparkSession, d: str) -> DataFrame:
    """Points of line items sheared, rotated by 30 degrees and brought back."""
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    how = F.lit(0.25), F.lit(30.0), F.lit(3), F.lit(2)
    back = geometry.sheared_rotated_back(geometry.sheared_rotated(geometry.polygon(F.format_string("%d,%d %d,%d", q, n, n, q)), *how), *how)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode(back).alias("pos", "p"))
    return rows.select("l_orderkey", "l_linenumber", "pos", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def best_models(spark: SparkSession, d: str) -> DataFrame:
    """The best of the model files of each brand, by the rate in their names."""
    name = F.concat(F.lit("run"), F.lpad(F.col("p_partkey"), 9, "0"), F.when(F.col("p_partkey") % 6 == 0, "").otherwise("_0."), F.lpad(F.col("p_partkey") * 7 % 1000, 3, "0"), F.lit(".mlmodel"))
    return reports.best_model(table(spark, d, "part").select("p_brand", name.alias("name")), "name", ["p_brand"])


def status_counted(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.status_counts(image_status(spark, d))


def values_known(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.known_values(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


QUERIES = [
    affine_back, best_models, status_counted, values_known,
    line_changes, word_changes, graph_aligned, rounded_scores, page_texts, doubtful_feasts, manifest_pages, image_status, report_scores, repaired_text, cached_answers, united_candidates, seeded_draw,
    person_cards, reconciled, reconciled_scores, match_scores, kind_accuracy, newspaper_pipeline, julian_easter, advent, feast_dates, century_years,
]

_YEARS = "SELECT DISTINCT CAST(1400 + o_orderkey % 200 AS INTEGER) AS year FROM orders"
_ROUNDED = lambda c: f"CASE WHEN {c} = 0 THEN 0.0 ELSE CAST(CAST({c} * 1180591620717411303424 AS HUGEINT) * 1000 // 1180591620717411303424 + CASE WHEN CAST({c} * 1180591620717411303424 AS HUGEINT) * 1000 % 1180591620717411303424 > 590295810358705651712 OR (CAST({c} * 1180591620717411303424 AS HUGEINT) * 1000 % 1180591620717411303424 = 590295810358705651712 AND CAST({c} * 1180591620717411303424 AS HUGEINT) * 1000 // 1180591620717411303424 % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 1000 END AS {c}"
_GOLD = f"""
{written_queries._NAMES},
keyed AS (SELECT *, CAST(substr(pid, 2) AS BIGINT) AS k FROM said),
told AS (SELECT k, pid, 'd' || k AS id, CASE WHEN k % 5 = 0 THEN 'Zyxwvut' || k ELSE mention END AS mention, CASE WHEN k % 4 = 0 THEN 'indirect' ELSE 'direct' END AS kind, k % 5 = 0 AS nobody FROM keyed),
judged AS (SELECT *, CASE WHEN nobody AND k % 2 = 0 THEN 'new' ELSE 'known' END AS status, CASE WHEN nobody THEN CASE WHEN k % 2 = 0 THEN 'correct' ELSE 'called new' END WHEN k % 7 = 0 THEN 'wrong id' ELSE 'correct' END AS outcome
  FROM told WHERE k % 11 <> 0)"""

ORACLES = {
    "affine_back": "SELECT l_orderkey, l_linenumber, 0 AS pos, CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS x, CAST(l_linenumber AS DOUBLE) AS y FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 1, CAST(l_linenumber AS DOUBLE), CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) FROM lineitem",
    "best_models": """
WITH f AS (SELECT p_brand, 'run' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '_0.' || lpad(CAST(p_partkey * 7 % 1000 AS VARCHAR), 3, '0') || '.mlmodel' AS name, round((1 - CAST('0.' || lpad(CAST(p_partkey * 7 % 1000 AS VARCHAR), 3, '0') AS DOUBLE)) * 100, 1) AS cer
  FROM part WHERE p_partkey % 6 <> 0)
SELECT p_brand, name, cer FROM f QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY cer, name) = 1""",
    "status_counted": "SELECT CASE WHEN page_id % 3 = 0 THEN 'skipped' WHEN page_id % 3 = 1 AND url IS NOT NULL THEN 'success' ELSE 'error' END AS status, count(*) AS n FROM pages GROUP BY 1",
    "values_known": "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer",
    "line_changes": """
WITH t AS (SELECT *, (conv_id + turn) % 3 <> 0 AS kept, turn || ' ' || coalesce(role, '') || ' ' || coalesce(text, '') AS line FROM conversations),
n AS (SELECT *, count(*) FILTER (kept) OVER (PARTITION BY conv_id ORDER BY turn) AS gap FROM t),
r AS (
  SELECT conv_id, gap, 0 AS rank, turn, '=' AS op, turn AS left_pos, turn * 2 AS right_pos, line FROM n WHERE kept
  UNION ALL SELECT conv_id, gap, 1, turn, '-', turn, NULL, line FROM n WHERE NOT kept
  UNION ALL SELECT conv_id, gap, 2, turn, '+', NULL, turn * 2 + 1, 'note on ' || turn FROM n WHERE turn % 4 = 0
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY gap, rank, turn) - 1 AS at, op, left_pos, right_pos, line FROM r""",
    "word_changes": r"SELECT p_partkey, trim(regexp_replace(p_name, '\S+$', '') || '[-' || regexp_extract(p_name, '\S+$') || '-] {+X Y+}') AS diff FROM part",
    "graph_aligned": graph_queries._ITEMS
    + """,
marks AS (SELECT graph, entry, list_sort(list(kind || item)) AS mark FROM items GROUP BY graph, entry),
same AS (SELECT a.entry FROM marks a JOIN marks b ON a.entry = b.entry AND a.mark = b.mark AND a.graph = 'truth' AND b.graph = 'test'),
placed AS (SELECT graph, entry, doc_pos, entry IN (SELECT entry FROM same) AS eq FROM entries),
gaps AS (SELECT *, CAST(sum(CASE WHEN eq THEN 1 ELSE 0 END) OVER (PARTITION BY graph ORDER BY doc_pos) AS BIGINT) AS gap FROM placed),
places AS (SELECT *, CASE WHEN eq THEN -1 ELSE row_number() OVER (PARTITION BY graph, gap, eq ORDER BY doc_pos) - 1 END AS nth FROM gaps),
all_ AS (SELECT i.graph, i.kind, gap, nth, item FROM items i JOIN places USING (graph, entry)),
shared AS (SELECT gap, nth FROM all_ GROUP BY gap, nth HAVING count(DISTINCT graph) = 2),
counts AS (SELECT kind, gap, nth, item, count(*) FILTER (graph = 'truth') AS g, count(*) FILTER (graph = 'test') AS t FROM all_ JOIN shared USING (gap, nth) GROUP BY ALL)
SELECT kind, gap, nth, CAST(sum(least(g, t)) AS BIGINT) AS common, CAST(sum(greatest(g - t, 0)) AS BIGINT) AS missing, CAST(sum(greatest(t - g, 0)) AS BIGINT) AS extra FROM counts GROUP BY kind, gap, nth""",
    "rounded_scores": table_queries.COUNTS_SQL + f" SELECT conv_id, {', '.join(map(_ROUNDED, ('precision', 'recall', 'f1')))} FROM s",
    "page_texts": f"""
WITH {written_queries._LINES}, edited AS (SELECT l_orderkey, n, '<TextLine id="l' || n || '"><Coords points="0,0 1,1"/><Baseline points="0,0 1,1"/>' ||
  CASE n % 3 WHEN 0 THEN '<TextEquiv><Unicode>new &lt; ' || l_suppkey || '</Unicode></TextEquiv>' WHEN 1 THEN '' ELSE '<TextEquiv><Unicode>old &amp; ' || l_partkey || '</Unicode></TextEquiv>' END || '</TextLine>' AS line FROM lines)
SELECT CAST(l_orderkey AS VARCHAR) AS path, '<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page imageFilename="p.jpg" imageWidth="10" imageHeight="20"><TextRegion id="r1"><Coords points="0,0 10,0 10,20 0,20"/>'
  || string_agg(line, '' ORDER BY n) || '</TextRegion></Page></PcGts>' AS text FROM edited GROUP BY l_orderkey""",
    "doubtful_feasts": "SELECT CASE p_partkey % 5 WHEN 0 THEN 'sixti pape' WHEN 1 THEN 'petri martyris' WHEN 2 THEN 'kiliani' WHEN 3 THEN 'martini' ELSE 'blasii' END AS feast, p_partkey % 5 < 2 AS doubtful, count(*) AS n FROM part GROUP BY ALL",
    "manifest_pages": """
SELECT page_id, 3 AS version, 'ok' AS status, CAST(1800 + page_id % 100 AS VARCHAR) AS issue_year, k AS page, CASE k WHEN 0 THEN 'http://x/s/' || page_id || '/full/max/0/default.jpg' ELSE 'http://x/b' || page_id || '.jpg' END AS image_url
FROM pages, (VALUES (0), (1)) v(k) WHERE page_id % 3 = 0
UNION ALL SELECT page_id, 2, 'ok', NULL, 0, 'http://y/' || page_id || '/full/max/0/default.jpg' FROM pages WHERE page_id % 3 = 1
UNION ALL SELECT page_id, NULL, 'unknown structure', NULL, NULL, NULL FROM pages WHERE page_id % 3 = 2""",
    "image_status": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'skipped' WHEN page_id % 3 = 1 AND url IS NOT NULL THEN 'success' ELSE 'error' END AS status FROM pages",
    "report_scores": """
WITH v(section, avg, times) AS (VALUES ('Structure', 'macro', 1), ('Structure', 'micro', 3), ('Exact match', 'macro', 7)), m(metric, more) AS (VALUES ('precision', 0), ('recall', 1), ('f1', 2))
SELECT 'L' || s_suppkey AS dataset, 'model-' || s_suppkey % 4 AS model, section, avg, metric, CAST('0.' || lpad(CAST((s_suppkey * times + more) % 1000 AS VARCHAR), 3, '0') AS DOUBLE) AS value
FROM supplier, v, m WHERE s_suppkey % 10 <> 0""",
    "repaired_text": """SELECT o_orderkey, chr(10) || chr(10) || chr(10) || '<bk:unit rdf:resource="urn:x#piece"/> <bk:entry>stück ' || o_orderkey || '</bk:entry>' || chr(10) || chr(10) AS text FROM orders""",
    "cached_answers": """
WITH p AS (SELECT DISTINCT p_partkey % 1000 AS n FROM part), a AS (SELECT 'part ' || n AS usr, n % 4 AS refused, n FROM p)
SELECT usr, 1 AS round, usr AS answer, refused + 1 AS attempts, NULL AS error FROM a WHERE n % 2 = 0
UNION ALL SELECT usr, 2, CASE WHEN refused < 3 THEN usr END, least(refused + 1, 3), CASE WHEN refused = 3 THEN 'TimeoutError: ' || usr END FROM a WHERE n % 2 = 1""",
    "united_candidates": """
WITH a AS (SELECT p_brand, p_partkey, 0 AS side, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part QUALIFY r <= 2),
b AS (SELECT p_brand, p_partkey, 1 AS side, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part QUALIFY r <= 4),
u AS (SELECT p_brand, p_partkey, min(side * 10 + r) AS o FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
SELECT p_brand AS mention, p_partkey AS pid, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY o) AS INTEGER) AS rank FROM u QUALIFY rank <= 4""",
    "seeded_draw": "SELECT count(*) AS n, count(*) AS same, CAST(3 AS BIGINT) AS kinds FROM customer",
    "person_cards": """
SELECT 'p' || s_suppkey AS pid, '- id: p' || s_suppkey || chr(10) || '  label: L' || s_suppkey || chr(10) || '  spellings: V' || s_suppkey || ', F' || s_suppkey || chr(10)
  || CASE WHEN s_suppkey % 3 = 0 THEN '  aliases: A' || s_suppkey || '; B' || chr(10) ELSE '' END
  || '  attested: 1440 to 14' || 50 + s_suppkey % 50 || ', digests: ' || s_suppkey % 3 || ', places: ' || CASE WHEN s_suppkey % 2 = 0 THEN 'P' || s_suppkey || ', Q' ELSE '-' END
  || CASE WHEN s_suppkey % 4 = 0 THEN chr(10) || '  example (d1, 1455): of ' || s_suppkey ELSE '' END AS card FROM supplier""",
    "reconciled": f"WITH {_GOLD} SELECT id, mention, kind, CASE WHEN nobody THEN 'new' ELSE 'match' END AS decision, CASE WHEN NOT nobody THEN pid END AS entity_ids FROM told",
    "reconciled_scores": f"WITH {_GOLD} SELECT id, mention, CASE WHEN status = 'new' THEN 'new' WHEN k % 12 >= 10 THEN '10+' WHEN k % 12 >= 5 THEN '5-9' WHEN k % 12 >= 2 THEN '2-4' WHEN k % 12 = 1 THEN '1' ELSE 'unbucketed' END AS bucket, outcome FROM judged",
    "match_scores": f"WITH {_GOLD} SELECT 'match' AS decision, count(*) FILTER (status <> 'new' AND outcome = 'correct') AS tp, count(*) FILTER (outcome IN ('wrong id', 'matched new')) AS fp, count(*) FILTER (status <> 'new' AND outcome <> 'correct') AS fn FROM judged "
    "UNION ALL SELECT 'new', count(*) FILTER (status = 'new' AND outcome = 'correct'), count(*) FILTER (outcome = 'called new'), count(*) FILTER (status = 'new' AND outcome <> 'correct') FROM judged",
    "kind_accuracy": f"WITH {_GOLD} SELECT kind, round(avg(CASE WHEN outcome = 'correct' THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS n FROM judged GROUP BY kind",
    "newspaper_pipeline": f"SELECT 'abc' AS newspaper, '1905' AS year, regexp_extract(path, '(\\d+).xml', 1) AS page, region_id, '<' || text || '>' AS post_corrected FROM ({written_queries.ORACLES['page_regions']}) WHERE region_id IS NOT NULL",
    "julian_easter": f"SELECT year, CAST(CAST({EASTER_SQL} AS DATE) AS VARCHAR) AS easter FROM ({_YEARS})",
    "advent": TEXT_ORACLES["advent"].replace("SELECT CAST(range AS INTEGER) AS year FROM range(1400, 1601)", _YEARS),
    "feast_dates": TEXT_ORACLES["feast_dates"].replace("SELECT CAST(range AS INTEGER) AS year FROM range(1450, 1461)", _YEARS),
    "century_years": "WITH r AS (SELECT o_orderkey, [1398, 1401, 1455, 1499][o_custkey % 4 + 1] AS near, o_orderkey % 100 AS n FROM orders), y AS (SELECT *, near // 100 * 100 + n AS y FROM r) "
    "SELECT o_orderkey, CAST(CASE WHEN abs(y - near) <= 3 THEN y WHEN abs(y + 100 - near) <= 3 THEN y + 100 WHEN abs(y - 100 - near) <= 3 THEN y - 100 END AS INTEGER) AS year FROM y",
}
