"""Queries of names, graphs, models and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import words
from quire.operators import graph, models, search
from quire.sources import folders
from quire.sources.readers import table
from quire.streaming import files


def fuzzy_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Part names with a letter lost, against the words of all part names."""
    names = table(spark, d, "part").select(F.explode(words(F.lower("p_name"))).alias("form")).where(F.length("form") >= 4).distinct()
    typos = names.select(F.concat(F.substring("form", 1, 2), F.substring("form", 4, 100)).alias("token")).where(F.length("token") >= 4).distinct()
    return search.similar(typos, names, "token", "form")


def region_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges from regions to nations, customers and orders."""
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    n = table(spark, d, "nation").select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst"))
    c = table(spark, d, "customer").select(key("n", "c_nationkey").alias("src"), key("c", "c_custkey").alias("dst"))
    o = table(spark, d, "orders").select(key("c", "o_custkey").alias("src"), key("o", "o_orderkey").alias("dst"))
    return n.union(c).union(o)


def graph_reach(spark: SparkSession, d: str) -> DataFrame:
    roots = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("root"))
    return graph.reach(region_edges(spark, d), roots).groupBy("root", "depth").agg(F.count("*").alias("n")).withColumn("depth", F.col("depth").cast("int"))


def class_counts(spark: SparkSession, d: str) -> DataFrame:
    """Event types of even against odd users, as two graphs' classes."""
    e = table(spark, d, "events")
    rows = e.select(
        F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("graph"), F.col("event_id").cast("string").alias("s"), F.lit(graph.TYPE).alias("p"),
        F.concat(F.lit("urn:x#"), F.col("event_type")).alias("o"), F.lit("uri").alias("o_kind"),
    )
    return graph.class_counts(rows, "even", "odd", ["click", "view", "purchase", "absent"])


def rule_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Documents by a keyword classifier behind the predictor interface."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    make = lambda: models.KeywordClassifier({"licensed": ["licens"], "secret": ["token =", "password="]}, "plain")
    out = models.predicted(docs, make, "doc_id long, text string, prediction int, prediction_label string, probability double")
    return out.groupBy("prediction", "prediction_label").agg(F.count("*").alias("n"))


def argmax_label(spark: SparkSession, d: str) -> DataFrame:
    """The place of the largest number of every embedding."""
    return table(spark, d, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).alias("prediction"))


def events_resume_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events read as a file stream to the end, step by step, then counted."""
    run = folders.scratch(spark, "stream")
    schema = table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet" if _is_folder(spark, d) else f"{d}/event[s].parquet")
    files.run_available(source.select("event_id", "event_type", "value"), f"{run}/checkpoint", files.upsert_into(f"{run}/out", ["event_id"]))
    return files.current(spark, f"{run}/out", ["event_id"]).groupBy("event_type").agg(F.count("*").alias("n"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Counts and sums of events in hours, by type (the same function closes windows on a stream)."""
    out = files.windowed_counts(table(spark, d, "events"), "ts", "event_type")
    return out.select(F.col("window.start").cast("string").alias("hour"), "event_type", "n", F.round("total", 6).alias("total"))


def _is_folder(spark: SparkSession, d: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


QUERIES = [fuzzy_candidates, graph_reach, class_counts, rule_classifier, argmax_label, events_resume_stream, event_windows]

_EDGES = (
    "SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders"
)

def lcs_sql(pairs: str) -> str:
    """SQL of ``lcs(a, b, n)``: the longest common subsequence of each pair, row by row of its table: the running maximum of what was above and of the diagonal plus a match."""
    return f"""
pairs AS ({pairs}),
rows_ AS (
  SELECT a, b, 0 AS i, list_transform(range(1, length(b) + 1), lambda j: 0) AS r FROM pairs
  UNION ALL
  SELECT a, b, i + 1, list_transform(range(1, length(b) + 1), lambda j: list_max(best[1:j])) FROM (
    SELECT a, b, i, list_transform(range(1, length(b) + 1), lambda k: greatest(r[k], CASE WHEN k > 1 THEN r[k - 1] ELSE 0 END + CASE WHEN b[k] = a[i + 1] THEN 1 ELSE 0 END)) AS best FROM rows_ WHERE i < length(a)
  )
),
lcs AS (SELECT a, b, r[length(b)] AS n FROM rows_ WHERE i = length(a))"""


ORACLES = {
    "fuzzy_candidates": rf"""
WITH RECURSIVE names AS (SELECT DISTINCT form FROM (SELECT unnest(regexp_extract_all(lower(p_name), '\w+')) AS form FROM part) WHERE length(form) >= 4),
typos AS (SELECT DISTINCT substr(form, 1, 2) || substr(form, 4) AS token FROM names WHERE length(form) >= 5),
{lcs_sql("SELECT token AS a, form AS b FROM typos, names")}
SELECT a AS token, b AS form, 200.0::DOUBLE * n / (length(a) + length(b)) AS ratio FROM lcs WHERE 200 * n >= 82 * (length(a) + length(b))
""",
    "graph_reach": f"WITH RECURSIVE e AS ({_EDGES}), w AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT root, dst, depth + 1 FROM w JOIN e ON src = node WHERE depth < 5) "
    "SELECT root, depth, count(*) AS n FROM w GROUP BY 1, 2",
    "class_counts": "WITH t(class) AS (VALUES ('click'), ('view'), ('purchase'), ('absent')), c AS (SELECT event_type AS class, count(DISTINCT event_id) FILTER (WHERE user_id % 2 = 0) AS truth, count(DISTINCT event_id) FILTER (WHERE user_id % 2 <> 0) AS test FROM events GROUP BY 1) "
    "SELECT class, coalesce(truth, 0) AS truth, coalesce(test, 0) AS test, coalesce(test, 0) - coalesce(truth, 0) AS difference FROM t LEFT JOIN c USING (class)",
    "rule_classifier": "WITH h AS (SELECT CASE WHEN contains(lower(text), 'licens') THEN 1 ELSE 0 END AS a, CASE WHEN contains(lower(text), 'token =') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'password=') THEN 1 ELSE 0 END AS b FROM documents), "
    "p AS (SELECT CASE WHEN a + b = 0 THEN 2 WHEN b > a THEN 1 ELSE 0 END AS prediction FROM h) SELECT prediction, CASE prediction WHEN 0 THEN 'licensed' WHEN 1 THEN 'secret' ELSE 'plain' END AS prediction_label, count(*) AS n FROM p GROUP BY 1, 2",
    "argmax_label": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS prediction FROM embeddings",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "events_resume_stream": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
}
