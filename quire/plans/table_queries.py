"""Queries of joins, windows, aggregates, set operations and metrics over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import is_local_model, squeeze, words
from quire.operators import aggregates, joins, metrics, windows
from quire.sources.readers import table

WORD_SQL = r"[\p{L}\p{M}\p{N}\p{Pc}]+"
TOKENS_SQL = f"SELECT conv_id, role, unnest(regexp_extract_all(text, '{WORD_SQL}')) AS w FROM conversations WHERE role IN ('user', 'assistant')"
COUNTS_SQL = (
    f"WITH t AS ({TOKENS_SQL}), c AS (SELECT conv_id, w, count(*) FILTER (WHERE role = 'user') AS g, count(*) FILTER (WHERE role = 'assistant') AS a FROM t GROUP BY conv_id, w), "
    "e AS (SELECT conv_id, CAST(sum(least(g, a)) AS BIGINT) AS common, CAST(sum(greatest(g - a, 0)) AS BIGINT) AS missing, CAST(sum(greatest(a - g, 0)) AS BIGINT) AS extra, "
    "CAST(sum(g) AS BIGINT) AS n_truth, CAST(sum(a) AS BIGINT) AS n_test FROM c GROUP BY conv_id), "
    "p AS (SELECT *, CASE WHEN n_test = 0 THEN 0.0 ELSE common / CAST(n_test AS DOUBLE) END AS precision, CASE WHEN n_truth = 0 THEN 0.0 ELSE common / CAST(n_truth AS DOUBLE) END AS recall FROM e), "
    "s AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM p)"
)


def _turn_tokens(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    return turns.select("conv_id", "role", F.explode(words(F.col("text"))).alias("w"))


def multiset_prf(spark: SparkSession, d: str) -> DataFrame:
    """Words of the assistant against those of the user, as multisets, for every conversation."""
    return metrics.multiset_prf(_turn_tokens(spark, d), ["conv_id"], ["w"], F.col("role") == "user")


def macro_micro(spark: SparkSession, d: str) -> DataFrame:
    entries = multiset_prf(spark, d)
    both = metrics.macro(entries).crossJoin(metrics.micro(entries))
    return both.select(*[F.round(c, 9).alias(c) for c in both.columns])  # sums of doubles differ by their order


def combined_scores(spark: SparkSession, d: str) -> DataFrame:
    return multiset_prf(spark, d).select("conv_id", metrics.combined([F.col("precision"), F.col("recall"), F.col("f1")]).alias("combined"), aggregates.size_ratio(F.col("n_test"), F.col("n_truth")).alias("size_ratio"))


def weighted_mean_by_lang(spark: SparkSession, d: str) -> DataFrame:
    """Mean quality of sources over languages, weighted by documents; only sources of all languages."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    cells = rows.groupBy("lang", "source").agg(F.avg("quality").alias("v"), F.count("*").alias("w"))
    return aggregates.weighted_mean(cells, "lang", "source", [], "v", "w").withColumn("weighted_mean", F.round("weighted_mean", 9))


def best_flag(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice", "p_type")
    return aggregates.best_flags(rows, ["p_brand"], "p_retailprice", F.lower(F.col("p_type")).rlike("^(standard|small)")).select("p_brand", "p_partkey", "best", "best_local", "is_best", "is_best_local")


def local_models(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose segment starts like a model that is run in house (none may)."""
    return table(spark, d, "customer").groupBy(is_local_model(F.col("c_mktsegment")).alias("is_local")).agg(F.count("*").alias("n"))


BUCKET = "CASE WHEN k >= 10 THEN '10+' WHEN k >= 5 THEN '5-9' WHEN k >= 2 THEN '2-4' WHEN k = 1 THEN '1' ELSE 'unbucketed' END"


def outcome_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Events by how many an hour's user has had, rolled up."""
    per = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("k"))
    return aggregates.outcome_table(per.withColumn("bucket", metrics.coverage(F.col("k"), F.lit("known"))), "bucket", "event_type", ["click", "view", "purchase"])


def outcome_pivot(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("k")).withColumn("bucket", metrics.coverage(F.col("k"), F.lit("known")))
    return per.groupBy("event_type").pivot("bucket", ["1", "2-4", "5-9", "10+"]).agg(F.count(F.lit(1))).na.fill(0).toDF("event_type", "b1", "b2", "b5", "b10")


def decision_prf(spark: SparkSession, d: str) -> DataFrame:
    """Quality labels against a length rule, by language."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    said = F.when(F.col("n_chars") > 400, 1).otherwise(0)
    return metrics.decision_prf(rows, F.col("quality"), said, 1, ["lang"])


def token_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    pairs = docs.select("doc_id", F.explode(F.array_distinct(F.transform(words(F.col("text")), lambda w: F.lower(w)))).alias("w"))
    n = docs.agg(F.count("*").alias("n"))
    return pairs.groupBy("w").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("w", "df", F.round(F.log(F.col("n") / F.col("df")), 9).alias("idf"))


def _item_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.explode(words(F.col("text"))).alias("w"))


def _word_counts(spark: SparkSession, d: str, other: str) -> DataFrame:
    """(w, a, b): how often a word stands in the items and in another table. Counts meet, not occurrences."""
    side = lambda rows, n: rows.groupBy("w").agg(F.count("*").alias(n))
    there = table(spark, d, other).select(F.explode(words(F.col("text"))).alias("w"))
    return side(_item_words(spark, d), "a").join(side(there, "b"), "w", "left").withColumn("b", F.coalesce("b", F.lit(0)))


def multiset_intersect(spark: SparkSession, d: str) -> DataFrame:
    return _word_counts(spark, d, "documents").select("w", F.least("a", "b").alias("n")).where("n > 0")


def multiset_except(spark: SparkSession, d: str) -> DataFrame:
    return _word_counts(spark, d, "conversations").select("w", (F.col("a") - F.col("b")).alias("n")).where("n > 0")


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    one = a.union(b).distinct().select(F.lit("union").alias("op"), "k")
    return one.union(a.intersect(b).select(F.lit("intersect"), "k")).union(a.subtract(b).select(F.lit("except"), "k"))


def ordered_concat(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.ordered_concat(table(spark, d, "conversations"), ["conv_id"], ["turn"], "text")


def left_merge_back(spark: SparkSession, d: str) -> DataFrame:
    """Labels merged to documents with the number of turns of the conversation of their number."""
    turns = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("turns"))
    return joins.merge_back(table(spark, d, "documents").select("doc_id", "lang"), turns, ["doc_id"])


def semi_pilot(spark: SparkSession, d: str) -> DataFrame:
    return joins.only(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").where("quality = 1"), "doc_id")


def anti_resume(spark: SparkSession, d: str) -> DataFrame:
    return joins.pending(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), ["doc_id"])


def incomplete_groups(spark: SparkSession, d: str) -> DataFrame:
    """Sources with fewer labels than documents."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    return joins.incomplete(docs, docs.join(table(spark, d, "labels"), "doc_id", "left_semi"), ["source"])


def lookup_last(spark: SparkSession, d: str) -> DataFrame:
    """The last event type of every customer who has events."""
    right = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), "event_id", "event_type")
    return joins.lookup(table(spark, d, "customer").select("c_custkey"), right, ["c_custkey"], "event_id")


def id_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return joins.reconciled_ids(table(spark, d, "documents"), table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")), "doc_id")


def field_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose stated length is not that of their text, and those whose white space is not plain."""
    plain = squeeze(F.col("text"))
    return table(spark, d, "documents").select("doc_id", (F.col("n_chars") != F.length("text")).alias("length_differs"), (F.length(plain) != F.length("text")).alias("space_differs"))


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Orders of the urgent kind renewed."""
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return joins.upsert(old, new, ["o_orderkey"])


def keep_first(spark: SparkSession, d: str) -> DataFrame:
    return windows.keep_first(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    return windows.top_k(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


def stripe_chunks(spark: SparkSession, d: str) -> DataFrame:
    return windows.striped(table(spark, d, "documents").select("doc_id", F.length("text").alias("letters")), "letters", "doc_id", 4).select("doc_id", F.col("place").cast("long").alias("place"), "stripe")


def neighbour_context(spark: SparkSession, d: str) -> DataFrame:
    """Purchases with the events next to them."""
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    kept = windows.change_context(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase")
    return windows.neighbours(kept, ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "previous_event_type", "next_event_type")


def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    return windows.split_by_name(table(spark, d, "customer").select("c_mktsegment", "c_name"), "c_name", 40, 10, ["c_mktsegment"])


def oversample(spark: SparkSession, d: str) -> DataFrame:
    real = windows.oversampled(table(spark, d, "supplier").select(F.col("s_name").alias("name")), 5).select("name", F.lit("real").alias("kind"))
    return real.unionByName(table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("synth").alias("kind"))).groupBy("kind", "name").agg(F.count("*").alias("n"))


def reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    return windows.reason_histogram(table(spark, d, "orders"), "o_orderpriority", "o_orderkey").select("o_orderpriority", "n", F.array_join("examples", ",").alias("examples"))


def conditional_distinct(spark: SparkSession, d: str) -> DataFrame:
    conditions = {"returned": F.col("l_returnflag") == "R", "open": F.col("l_linestatus") == "O", "large": F.col("l_quantity") > 40}
    return aggregates.conditional_distinct(table(spark, d, "lineitem"), "l_orderkey", conditions, ["l_suppkey"])


def having_all(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.having_all(table(spark, d, "events"), "user_id", "event_type", ["click", "view", "purchase"])


def entity_map(spark: SparkSession, d: str) -> DataFrame:
    """Numbers and capital words of benchmark texts as spans by label, in wide form."""
    t = table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("start"), (F.col("event_id") + 1).alias("end"))
    wide = aggregates.spans_wide(aggregates.spans_by_label(t, "user_id", "event_type", "start", "end"), "user_id", ["click", "view"])
    flat = lambda c: F.array_join(F.transform(F.coalesce(F.col(c), F.array()), lambda s: s["start"].cast("string")), ",")
    return wide.select("user_id", flat("click").alias("click"), flat("view").alias("view"))


def full_grid(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.count("*").alias("n"))
    dims = [table(spark, d, "nation").select("n_nationkey"), table(spark, d, "customer").select("c_mktsegment").distinct()]
    return joins.filled_grid(dims, facts, ["n_nationkey", "c_mktsegment"])


def positional_outer(spark: SparkSession, d: str) -> DataFrame:
    """Turns of the user against those of the assistant, one by one."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("value"))
    side = lambda r: joins.numbered(turns.where(F.col("role") == r), [F.col("turn")], ["conv_id"]).select("conv_id", "ordinal", "value")
    return joins.positional_outer(side("user"), side("assistant"), ["conv_id"]).withColumn("ordinal", F.col("ordinal").cast("long"))


def century_years(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.range(0, 100).crossJoin(spark.createDataFrame([(1398,), (1401,), (1455,), (1499,)], "near int"))
    return rows.select(F.col("id").alias("n"), "near", joins.nearest_century(F.col("id"), F.col("near")).alias("year"))


def throughput(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.totals(table(spark, d, "documents"), "text", 2.0)


QUERIES = [
    multiset_prf, macro_micro, combined_scores, weighted_mean_by_lang, best_flag, local_models, outcome_rollup, outcome_pivot, decision_prf, token_idf, multiset_intersect, multiset_except,
    set_operations, ordered_concat, left_merge_back, semi_pilot, anti_resume, incomplete_groups, lookup_last, id_reconcile, field_mismatch, upsert_latest, keep_first, topk_per_group,
    stripe_chunks, neighbour_context, holdout_split, oversample, reason_histogram, conditional_distinct, having_all, entity_map, full_grid, positional_outer, century_years, throughput,
]

_PER = "WITH per AS (SELECT user_id, event_type, count(*) AS k FROM events GROUP BY 1, 2), b AS (SELECT *, " + BUCKET + " AS bucket FROM per)"
_WORDS = lambda t: f"SELECT unnest(regexp_extract_all(text, '{WORD_SQL}')) AS w FROM {t}"

ORACLES = {
    "multiset_prf": COUNTS_SQL + " SELECT conv_id, common, missing, extra, n_truth, n_test, precision, recall, f1 FROM s",
    "macro_micro": COUNTS_SQL + ", m AS (SELECT avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1, sum(common) / CAST(sum(n_test) AS DOUBLE) AS micro_precision, sum(common) / CAST(sum(n_truth) AS DOUBLE) AS micro_recall FROM s) "
    "SELECT round(macro_precision, 9) AS macro_precision, round(macro_recall, 9) AS macro_recall, round(macro_f1, 9) AS macro_f1, round(micro_precision, 9) AS micro_precision, round(micro_recall, 9) AS micro_recall, "
    "round(2 * micro_precision * micro_recall / (micro_precision + micro_recall), 9) AS micro_f1 FROM m",
    "combined_scores": COUNTS_SQL + " SELECT conv_id, (precision + recall + f1) / 3 AS combined, CASE WHEN n_truth = 0 THEN 0.0 ELSE 100.0 * n_test / n_truth END AS size_ratio FROM s",
    "weighted_mean_by_lang": "WITH c AS (SELECT lang, source, avg(quality) AS v, count(*) AS w FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2) "
    "SELECT source, round(sum(v * w) / sum(w), 9) AS weighted_mean FROM c GROUP BY source HAVING count(DISTINCT lang) = (SELECT count(DISTINCT lang) FROM c)",
    "best_flag": "WITH r AS (SELECT p_brand, p_partkey, p_retailprice, regexp_matches(lower(p_type), '^(standard|small)') AS loc FROM part), m AS (SELECT *, max(p_retailprice) OVER (PARTITION BY p_brand) AS best, "
    "max(p_retailprice) FILTER (WHERE loc) OVER (PARTITION BY p_brand) AS best_local FROM r) SELECT p_brand, p_partkey, best, best_local, abs(p_retailprice - best) < 1e-9 AS is_best, loc AND coalesce(abs(p_retailprice - best_local) < 1e-9, false) AS is_best_local FROM m",
    "local_models": "SELECT regexp_matches(lower(c_mktsegment), '^(qwen|glm|gemma|kimi)') AS is_local, count(*) AS n FROM customer GROUP BY 1",
    "outcome_rollup": _PER + " SELECT CASE WHEN grouping(bucket) = 1 THEN 'all' ELSE bucket END AS bucket, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, "
    "count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) AS total FROM b GROUP BY ROLLUP (bucket)",
    "outcome_pivot": _PER + " SELECT event_type, count(*) FILTER (WHERE bucket = '1') AS b1, count(*) FILTER (WHERE bucket = '2-4') AS b2, count(*) FILTER (WHERE bucket = '5-9') AS b5, count(*) FILTER (WHERE bucket = '10+') AS b10 FROM b GROUP BY 1",
    "decision_prf": "WITH r AS (SELECT lang, quality = 1 AS t, n_chars > 400 AS s FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, count(*) FILTER (WHERE t AND s) AS tp, count(*) FILTER (WHERE NOT t AND s) AS fp, count(*) FILTER (WHERE t AND NOT s) AS fn FROM r GROUP BY lang), "
    "p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS recall FROM c) "
    "SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM p",
    "token_idf": f"WITH t AS (SELECT DISTINCT doc_id, lower(w) AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{WORD_SQL}')) AS w FROM documents)) SELECT w, count(*) AS df, round(ln((SELECT count(*) FROM documents) / CAST(count(*) AS DOUBLE)), 9) AS idf FROM t GROUP BY w",
    "multiset_intersect": f"SELECT w, count(*) AS n FROM ({_WORDS('benchmark')} INTERSECT ALL {_WORDS('documents')}) GROUP BY w",
    "multiset_except": f"SELECT w, count(*) AS n FROM ({_WORDS('benchmark')} EXCEPT ALL {_WORDS('conversations')}) GROUP BY w",
    "set_operations": "SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) "
    "UNION ALL SELECT 'except', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)",
    "ordered_concat": "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "left_merge_back": "SELECT doc_id, lang, turns FROM documents LEFT JOIN (SELECT conv_id AS doc_id, count(*) AS turns FROM conversations GROUP BY 1) USING (doc_id)",
    "semi_pilot": "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "anti_resume": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "incomplete_groups": "SELECT source, count(*) AS n_in, count(l.doc_id) AS n_out FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source HAVING count(l.doc_id) < count(*)",
    "lookup_last": "SELECT c_custkey, event_type, CASE WHEN event_type IS NULL THEN 'error' ELSE 'success' END AS status FROM customer LEFT JOIN (SELECT user_id AS c_custkey, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1) USING (c_custkey)",
    "id_reconcile": "WITH a AS (SELECT doc_id, count(*) AS n_left FROM documents GROUP BY 1), b AS (SELECT conv_id AS doc_id, count(*) AS n_right FROM conversations GROUP BY 1), f AS (SELECT doc_id, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right FROM a FULL JOIN b USING (doc_id)) "
    "SELECT *, CASE WHEN n_right = 0 THEN 'missing' WHEN n_left = 0 THEN 'extra' WHEN greatest(n_left, n_right) > 1 THEN 'duplicate' ELSE 'ok' END AS finding FROM f",
    "field_mismatch": r"SELECT doc_id, n_chars <> length(text) AS length_differs, length(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) <> length(text) AS space_differs FROM documents",
    "upsert_latest": "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'N' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders",
    "keep_first": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1",
    "topk_per_group": "SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 3",
    "stripe_chunks": "SELECT doc_id, row_number() OVER (ORDER BY length(text), doc_id) - 1 AS place, CAST((row_number() OVER (ORDER BY length(text), doc_id) - 1) % 4 AS INTEGER) AS stripe FROM documents",
    "neighbour_context": "WITH m AS (SELECT *, event_type = 'purchase' AS c FROM events), k AS (SELECT *, c OR coalesce(lag(c) OVER w, false) OR coalesce(lead(c) OVER w, false) AS near FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) "
    "SELECT event_id, lag(event_type) OVER w AS previous_event_type, lead(event_type) OVER w AS next_event_type FROM k WHERE near WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "holdout_split": "WITH r AS (SELECT c_mktsegment, c_name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name) AS n FROM customer) SELECT c_mktsegment, c_name, CASE WHEN n <= 40 THEN 'train' WHEN n <= 50 THEN 'validation' ELSE 'unused' END AS split FROM r",
    "oversample": "SELECT kind, name, count(*) AS n FROM (SELECT s_name AS name, 'real' AS kind FROM supplier, range(5) UNION ALL SELECT n_name, 'synth' FROM nation) GROUP BY 1, 2",
    "reason_histogram": "SELECT o_orderpriority, count(DISTINCT o_orderkey) AS n, array_to_string(list_slice(list_sort(list(DISTINCT o_orderkey)), 1, 3), ',') AS examples FROM orders GROUP BY 1",
    "conditional_distinct": "SELECT l_suppkey, count(DISTINCT l_orderkey) FILTER (WHERE l_returnflag = 'R') AS returned, count(DISTINCT l_orderkey) FILTER (WHERE l_linestatus = 'O') AS open, count(DISTINCT l_orderkey) FILTER (WHERE l_quantity > 40) AS large FROM lineitem GROUP BY 1",
    "having_all": "SELECT user_id FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1 HAVING count(DISTINCT event_type) = 3",
    "entity_map": "SELECT user_id, coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (WHERE event_type = 'click'), '') AS click, coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (WHERE event_type = 'view'), '') AS view FROM events GROUP BY 1",
    "full_grid": "SELECT n_nationkey, g.c_mktsegment, n FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) g LEFT JOIN (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) f ON f.c_nationkey = n_nationkey AND f.c_mktsegment = g.c_mktsegment",
    "positional_outer": "WITH t AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS ordinal, CAST(length(text) AS INTEGER) AS v FROM conversations), a AS (SELECT * FROM t WHERE role = 'user'), b AS (SELECT * FROM t WHERE role = 'assistant') "
    "SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.ordinal, b.ordinal) AS ordinal, a.v AS left_value, b.v AS right_value, CASE WHEN b.v IS NULL THEN 'missing' WHEN a.v IS NULL THEN 'extra' WHEN a.v = b.v THEN 'same' ELSE 'different' END AS finding "
    "FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.ordinal = b.ordinal",
    "century_years": "WITH r AS (SELECT range AS n, near, near // 100 * 100 + range AS y FROM range(100), (VALUES (1398), (1401), (1455), (1499)) v(near)) "
    "SELECT n, near, CAST(CASE WHEN abs(y - near) <= 3 THEN y WHEN abs(y + 100 - near) <= 3 THEN y + 100 WHEN abs(y - 100 - near) <= 3 THEN y - 100 END AS INTEGER) AS year FROM r",
    "throughput": "SELECT count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, sum(strlen(text)) / CAST(count(*) AS DOUBLE) AS mean_bytes, count(*) / 2.0 AS per_second FROM documents",
}
