"""Joins, windows, metrics, names, graphs, models and streams against plain versions."""

import difflib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.operators import aggregates, diffs, graph, joins, metrics, models, search, windows
from quire.plans import fixtures, pipelines
from quire.sources import readers, triples
from quire.streaming import files


def test_lookup_takes_the_last_of_repeated_keys(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    right = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), (None, 3, "null")], "k string, at int, v string")
    assert {tuple(r) for r in joins.lookup(left, right, ["k"], "at").collect()} == {("a", "new", "success"), ("b", None, "error"), (None, None, "error")}


def test_reconciled_ids(spark):
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id string")
    got = {r["id"]: r["finding"] for r in joins.reconciled_ids(ids(["a", "b", "c", None]), ids(["b", "c", "c", "d"]), "id").collect()}
    assert got == {"a": "missing", "b": "ok", "c": "duplicate", "d": "extra", None: "no id"}


def test_pending_and_upsert(spark):
    work = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    done = spark.createDataFrame([("a", 500), ("b", 10)], "k string, size int")
    assert {r["k"] for r in joins.pending(work, done, ["k"], "size", 200).collect()} == {"b", "c"}
    merged = joins.upsert(done, spark.createDataFrame([("b", 900), ("d", 1)], "k string, size int"), ["k"])
    assert {tuple(r) for r in merged.collect()} == {("a", 500), ("b", 900), ("d", 1)}


def test_positional_pairs_stop_at_the_shorter_side(spark):
    side = lambda n: joins.numbered(spark.createDataFrame([("g", i) for i in range(n)], "g string, v int"), [F.col("v")], ["g"])
    assert joins.positional(side(3).withColumnRenamed("v", "a"), side(5).withColumnRenamed("v", "b"), ["g"]).count() == 3


def test_stripes_are_even_and_keep_order(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 9) if i % 10 else None) for i in range(200)]
    got = sorted(windows.striped(spark.createDataFrame(rows, "id long, t string"), "t", "id", 7).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(200)) and all(r["stripe"] == r["place"] % 7 for r in got)
    known = [(len(r["t"]), r["id"]) for r in got if r["t"] is not None]
    assert known == sorted(known)


def test_keep_first_and_top_k(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None)], "k string, n int, v string")
    assert {tuple(r) for r in windows.keep_first(df, ["k"], ["n"]).collect()} == {("a", 1, "y"), ("b", 5, None)}
    assert {(r["k"], r["n"]) for r in windows.top_k(df, ["k"], [F.desc("n")], 1).collect()} == {("a", 2), ("b", 5)}
    assert [r["label"] for r in windows.class_ordinal(df, [], "k", [F.col("n")]).orderBy("label").collect()] == ["a#1", "a#2", "b#1"]


def test_weighted_mean_needs_all_datasets(spark):
    df = spark.createDataFrame([("d1", "m1", 0.5, 1), ("d2", "m1", 1.0, 3), ("d1", "m2", 0.9, 1), ("d1", "m3", None, 1), ("d2", "m3", 0.4, 3)], "d string, m string, v double, w int")
    assert {r["m"]: r["weighted_mean"] for r in aggregates.weighted_mean(df, "d", "m", [], "v", "w").collect()} == pytest.approx({"m1": 0.875, "m3": 0.4})


def test_multiset_scores(spark):
    rng = random.Random(8)
    rows = [(e, rng.choice("ab"), rng.choice("xyz")) for e in range(30) for _ in range(rng.randint(0, 9))]
    got = {r["e"]: r for r in metrics.multiset_prf(spark.createDataFrame(rows, "e int, side string, w string"), ["e"], ["w"], F.col("side") == "a").collect()}
    for e, r in got.items():
        g, t = (Counter(w for x, s, w in rows if x == e and s == side) for side in "ab")
        assert (r["common"], r["missing"], r["extra"]) == (sum((g & t).values()), sum((g - t).values()), sum((t - g).values()))
        assert r["common"] + r["missing"] == r["n_truth"] and 0 <= r["f1"] <= 1
    same = metrics.multiset_prf(spark.createDataFrame([(1, s, w) for s in "ab" for w in "xxy"], "e int, side string, w string"), ["e"], ["w"], F.col("side") == "a").first()
    assert same["precision"] == same["recall"] == same["f1"] == 1.0


def test_outcomes(spark):
    rows = [("known", "match", "p1", ["p1"], True), ("known", "match", "p1", ["p2"], True), ("new", "match", "n", ["p1"], True), ("new", "new", "n", [], True), ("known", "new", "p", [], True), ("known", "unsure", "p", [], True), ("known", None, "p", None, True), ("known", None, "p", None, False)]
    df = spark.createDataFrame(rows, "status string, decision string, entity string, chosen array<string>, found boolean")
    out = df.withColumn("outcome", metrics.outcome(F.col("status"), F.col("decision"), F.col("entity"), F.col("chosen"), F.col("found")))
    assert [r["outcome"] for r in out.collect()] == ["correct", "wrong id", "matched new", "correct", "called new", "unsure", "error", "missing"]
    prf = {r["decision"]: (r["tp"], r["fp"], r["fn"]) for r in metrics.match_prf(out).collect()}
    assert prf == {"match": (1, 2, 5), "new": (1, 1, 1)}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], max(row[j], row[j - 1], last + (x == y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcé", max_size=12), st.text(alphabet="abcé", max_size=12))
def test_common_length(a, b):
    assert search.common_length(a, b) == lcs(a, b)


def test_set_likeness():
    assert search.set_likeness("hans muller", "muller hans wien") == 100.0 and search.set_likeness("", "a") == 0.0
    assert search.set_likeness("hans muler", "hans muller") > 90 and search.set_likeness("abc", "xyz") == 0.0


def strings(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@pytest.mark.parametrize("floor", [100, 90, 82, 60, 33.3])
def test_partition_index_loses_nothing(spark, floor):
    """All pairs of short strings over few letters, of names with up to three edits, and of empty and long ones, against a comparison of all with all."""
    rng = random.Random(6)
    some = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    one = {some(rng.randint(0, 7), "ab") for _ in range(60)} | {some(rng.randint(4, 12), "abcde") for _ in range(60)} | {"", "é" * 30, some(40, "abc")}
    two = set(one)
    for name in list(one):
        for _ in range(rng.randint(1, 3)):
            at = rng.randint(0, len(name))
            name = rng.choice([name[:at] + rng.choice("abz") + name[at:], name[:at] + name[at + 1 :], name[:at] + "z" + name[at + 1 :]])
        two.add(name)
    got = [(r["a"], r["b"], r["ratio"]) for r in search.similar(strings(spark, [*one, None, *one], "a"), strings(spark, [*two, None], "b"), "a", "b", floor).collect()]
    want = {(a, b, search.likeness(a, b)) for a in one for b in two if search.likeness(a, b) >= floor}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_shared_syllable_makes_no_large_bucket(spark):
    """Names of one length that all end alike: single bigrams would compare all with all (a million pairs); what the index proposes grows as the names do."""
    rng = random.Random(7)
    names = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(5)) + "er" for _ in range(2000)})
    proposals = {}
    for n in (500, 1000, 2000):
        df = strings(spark, names[:n:1], "a")
        proposals[n] = search.proposed(df, df.withColumnRenamed("a", "b"), "a", "b").count()
    assert proposals[2000] < 12 * 2000
    largest = search.buckets(df, df.withColumnRenamed("a", "b"), "a", "b").agg(F.max(F.col("n_left") * F.col("n_right"))).first()[0]
    assert largest < 2000


def test_candidates_against_a_plain_search(spark):
    people = spark.createDataFrame(fixtures.PERSONS_SCHEMA_ROWS, readers.PERSONS)
    forms = {(r["pid"], r["form"]) for r in search.name_forms(people).collect()}
    assert ("p1", "muller") in forms and ("p1", "#kg") in forms and ("p2", "schmidt-lang") in forms and ("p2", "lang") in forms and ("p3", "#papst") in forms
    found = search.candidates(spark.createDataFrame([("Hans Muler",)], "mention string"), people).first()
    import math

    weight = math.log(3 / 1)
    expected = 2 * weight * 1.0 + 2 * weight * search.likeness("muler", "muller") / 100
    assert found["pid"] == "p1" and found["score"] == pytest.approx(round(expected, 2))
    assert "spellings: Muller, Hanns Mueller" in {r["pid"]: r["card"] for r in search.rendered(people).collect()}["p1"]


def test_self_comparison_is_perfect(spark):
    twice = [("a", fixtures.GRAPHS[0][1]), ("b", fixtures.GRAPHS[0][1]), fixtures.GRAPHS[2]]
    scores, summary = pipelines.ledger_scores(spark.createDataFrame(twice, "graph string, text string"), "a", "b")
    assert all(r["f1"] == 1.0 for r in scores.collect()) and {r["kind"]: r["micro_f1"] for r in summary.collect()}["combined"] == 1.0
    assert triples.triples(spark.createDataFrame(twice, "graph string, text string")).where("error IS NOT NULL").count() == 1


def test_reach_takes_the_shortest_way(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "src string, dst string")
    got = {(r["node"], r["depth"]) for r in graph.reach(edges, spark.createDataFrame([("a",)], "root string")).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 1)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=8), st.lists(st.sampled_from("ab"), max_size=8))
def test_line_changes_tell_both_sides(a, b):
    rows = diffs.line_diff("\n".join(a), "\n".join(b), context=100)
    if a != b:
        assert [r["text"] for r in rows if r["op"] != "+"] == "\n".join(a).split("\n") and [r["text"] for r in rows if r["op"] != "-"] == "\n".join(b).split("\n")
    assert difflib.SequenceMatcher(None, a, b).ratio() < 1 or not rows


def test_provider_errors_are_rows_and_short_answers_are_asked_again(spark):
    class Flaky:
        def __init__(self):
            self.n = 0

        def generate(self, system, user, model, max_tokens, temperature, thinking):
            self.n += 1
            if user == "bad":
                raise TimeoutError("late")
            if user == "empty" and self.n % 2:
                return models.Answer("")
            return models.Answer("long " * 9, "length" if max_tokens < 20 else "stop")

    asked = models.requests(spark.createDataFrame([("s", "bad"), ("s", "empty"), ("s", "fine")], "a string, b string").coalesce(1), "a", "b", "m", 15)
    none = spark.createDataFrame([], models.ANSWERS)
    got = {r["b"]: r for r in models.answered(asked, none, Flaky, "a", "b", "m", 15, tries=4).join(asked, "key").collect()}
    assert got["bad"]["error"].startswith("TimeoutError") and got["bad"]["attempts"] == 4 and got["empty"]["content"] and got["fine"]["finish_reason"] == "stop"
    total = models.usage(models.answered(asked, none, models.EchoProvider, "a", "b", "m")).first()
    assert total["calls"] == 3 and total["errors"] == 0 and models.usage(none).first()["tokens_per_call"] is None


def test_predictors(spark):
    df = spark.createDataFrame([(1, "with token = 5"), (2, None)], "id int, text string")
    out = models.predicted(df, lambda: models.KeywordClassifier({"secret": ["token"]}, "plain"), "id int, text string, prediction int, prediction_label string, probability double", 1)
    assert {r["id"]: r["prediction_label"] for r in out.collect()} == {1: "secret", 2: "plain"}
    spans = models.predicted(df, lambda: models.PatternTagger({"number": r"\d+"}), "id int, text string, spans array<struct<label:string,start:int,end:int>>")
    assert [tuple(s) for s in spans.where("id = 1").first()["spans"]] == [("number", 13, 14)]


def test_streams_resume_and_upsert(spark, tmp_path):
    src, out, ckpt = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ckpt"
    write = lambda rows: spark.createDataFrame(rows, "k string, v int").coalesce(1).write.mode("append").parquet(src)
    write([("a", 1), ("b", 1)])
    for rows in ([("b", 2)], [("c", 3)]):
        files.run_available(files.stream(spark, src, "k string, v int", 1), ckpt, files.upsert_into(out, ["k"]))
        write(rows)
    files.run_available(files.stream(spark, src, "k string, v int", 1), ckpt, files.upsert_into(out, ["k"]))
    assert {tuple(r) for r in files.current(spark, out, ["k"]).collect()} == {("a", 1), ("b", 2), ("c", 3)}


def test_rounding_is_exact(spark):
    """A million doubles of all sizes, decimal and binary ties among them, against Python's own rounding."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(4)
    n = 250_000
    values = np.concatenate([rng.random(n), rng.integers(0, 2000, n) / 2000, rng.integers(0, 1 << 20, n) / 2.0 ** rng.integers(1, 21, n), rng.standard_normal(n) * 10.0 ** rng.integers(-8, 17, n)])
    values = np.concatenate([values, -values[:1000], [0.0, 0.0005, 0.0015, 0.00049999999999999, 1e-300, 5e-324, 1e300, 2.0**49, 2.0**49 - 0.0625, 2.0**43 + 2**-9, 9007199254740.992, 1.0, 2.0, 0.25, 0.125]])
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(4)
    got = df.select("v", metrics.round3(F.col("v")).alias("r")).toPandas()
    assert (got["r"] == got["v"].map(lambda v: round(v, 3))).all()
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "v double").select(metrics.round3(F.col("v")).alias("r")).collect()
    assert [str(r["r"]) for r in odd] == ["None", "nan", "inf", "-inf"]


def test_frequent_names_are_left_out_only_where_they_cannot_matter(spark, monkeypatch):
    from quire.plans import written_queries

    mentions, persons = written_queries._named_suppliers(spark, "/root/testdata/sf0.001")
    pick = lambda top: {tuple(r) for r in search.candidates(mentions, persons, top=top).collect()}
    all_six = pick(6)
    monkeypatch.setattr(search, "RARE", 1)
    assert pick(6) == all_six and pick(1) == {r for r in all_six if r[3] == 1}


def test_index_of_names_does_not_pass_the_driver(spark):
    rows = spark.createDataFrame([("Hans Muler",), ("Georg",)], "s string")
    plan = search.proposed(rows, rows.withColumnRenamed("s", "t"), "s", "t")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_other_candidates_are_ranked_only_where_the_first_one_is_doubtful(spark, monkeypatch):
    from quire.plans import given_queries, pipelines

    digests, persons = given_queries._digests(spark, "/root/testdata/sf0.001")
    short = "'d-1' AS id, array(named_struct('text', 'Hans', 'kind', 'direct'), named_struct('text', 'Herzog Georg Qqqqqqqqqqqqqqqqqqqq', 'kind', 'direct'), named_struct('text', cast(NULL AS string), 'kind', 'direct')) AS mentions"
    digests = digests.select("id", "mentions").union(spark.sql(f"SELECT {short}"))
    rows = lambda **more: pipelines.reconciliation(digests, persons, pipelines.by_similarity(), **more).select("id", "mention", "kind", "decision", "entity_ids")
    want = sorted(map(str, rows().collect()))
    asked = []

    def candidates(mentions, persons, top=search.TOP, find=search.candidates):
        asked.append((top, mentions.select("mention").where("mention IS NOT NULL").distinct().count()))
        return find(mentions, persons, top=top)

    monkeypatch.setattr(search, "candidates", candidates)
    assert sorted(map(str, rows(enough=pipelines.WEAK).collect())) == want and any("Qqqq" in r and "decision='new'" in r for r in want)
    of_all = asked[0][1]
    assert asked == [(1, of_all), (search.TOP, 1)]
    given_queries.reconciled(spark, "/root/testdata/sf0.001").collect()
    assert {top for top, _ in asked[2:]} == {1}
