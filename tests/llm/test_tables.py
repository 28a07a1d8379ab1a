"""Chats, personal data, shards and the pipeline."""

import random
import zlib

import pytest

import __spark_entry__
import corpus_pipeline
from quire.llm import chat, pii, sharding

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_chats(spark):
    turns = [("u", "hello"), ("a", "hi"), ("u", "bye"), ("a", "so long")]
    rows = [(c, i, r, t) for c, n in ((1, 2), (2, 4), (3, 4), (4, 1)) for i, (r, t) in enumerate(turns[:n])]
    rows += [(5, 0, "u", "hello"), (5, 1, "a", "other"), (6, None, None, None), (None, 0, "u", "alone"), (7, 0, "u", "x"), (7, 0, "a", "y"), (8, 0, "u", "x"), (9, 0, "u", "x"), (9, 0, "u", "x")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, n string, block string").repartition(3)
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert set(got) == {2, 5, 6, None, 7, 8, 9}
    assert got[2]["copies"] == 2 and got[2]["n_turns"] == 4 and got[2]["rendered"].startswith("<|u|>\nhello\n<|end|>\n<|a|>\nhi\n")
    assert got[6]["rendered"] == "<||>\n\n<|end|>\n" and got[9]["n_turns"] == 2
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_chats_come_in_parts(spark):
    rows = [(c, i, "u", f"t{i}") for c, n in ((1, 600), (2, 601), (3, 300)) for i in range(n)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["conv_id"], r["part"], r["n_turns"]) for r in got) == [(2, 0, 256), (2, 1, 256), (2, 2, 89)]


def test_crowded_turns_come_in_pieces(spark):
    """Null conversations and numbers, equal turns, marks inside texts, a very long text: every turn is rendered once."""
    long = "x" * 300_000
    rows = [(None, None, "u", f"text {i % 700}") for i in range(1500)] + [(None, None, "a", "same")] * 600 + [(None, 3, "u", long)]
    rows += [(1, 0, "u", "a <|end|> <\\|x|> < | <|u|>\n"), (1, 1, "<|a", "b")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()
    pieces = {(r["conv_id"], r["part"], r["piece"]): r for r in got}
    assert sorted(k[2] for k in pieces if k[:2] == (None, -1)) == list(range(9)) and all(pieces[None, -1, k]["n_turns"] == 256 for k in range(8))
    whole = "".join(pieces[None, -1, k]["rendered"] for k in range(9))
    turns = whole.split("\n<|end|>\n")[:-1]
    assert sorted(turns) == sorted(f"<|{r}|>\n{t}" for c, n, r, t in rows if c is None and n is None)
    assert turns == sorted(turns, key=lambda x: (x[:6], brute.md5(x.split("\n", 1)[1])[:2], x))
    assert pieces[None, 0, 0]["rendered"] == f"<|u|>\n{long}\n<|end|>\n"
    assert pieces[1, 0, 0]["rendered"] == "<|u|>\na <\\|end|> <\\\\|x|> < | <\\|u|>\n\n<|end|>\n<|<\\|a|>\nb\n<|end|>\n"


def test_chats_against_brute_force(spark):
    rng = random.Random(1)
    convs = {c: [(rng.choice("ua"), rng.choice("xy")) for _ in range(rng.randint(1, 5))] for c in range(150)}
    rows = [(c, i, r, t) for c, ts in convs.items() for i, (r, t) in enumerate(ts)]
    kept = {}
    for c in sorted(convs):
        if not any(len(o) > len(convs[c]) and o[: len(convs[c])] == convs[c] for o in convs.values()):
            kept.setdefault(tuple(convs[c]), c)
    got = {r["conv_id"] for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == set(kept.values())


PII = [
    None, "", "mail a.b@c-d.org, or +1 (555) 010-9999 now", "a@b.c+d@e.f_g@h.i", "1.2.3.4.5 999.1.1.1 0010.0.0.255 1.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112 x 1234567890123456789012",
    "+12 345", "é漢🙂 x@y.zz 漢 +49 30 1234567", "@@ a@b a@b. .@. +", "x" * 30_000 + "@", "1" * 30_000, "a." * 20_000 + "@b.c", "9.9.9.9." * 3_000,
]


def test_base_spans(spark):
    rows = [(i, t, "x", "x") for i, t in enumerate(PII)]
    df = spark.createDataFrame([*rows, rows[2]], "doc_id long, text string, base string, candidates string").repartition(2)
    got = pii.detect(df).collect()
    assert len(got) == len(PII) + 1
    for r in got:
        assert [tuple(s) for s in r["base"]] == brute.base_spans(PII[r["doc_id"]]), PII[r["doc_id"]][:60] if PII[r["doc_id"]] else None
        assert [tuple(s) for s in r["base"]] == [tuple(s) for s in r["spans"] if s["kind"] in pii.BASE_KINDS]
    assert pii.detect(df.limit(0)).count() == 0


def secrets(n):
    rng = random.Random(2)
    return ["".join(rng.choice("0123456789abcdef") for _ in range(20)) + "a1" for _ in range(n)]


def test_contexts_are_learned_and_find_unseen_values(spark):
    keys = secrets(8)
    rows = [(i, f"some words api_key={k} follow") for i, k in enumerate(keys)]
    rows += [(20, "here api_key=hunter-two is one more."), (21, "note: nothing here"), (22, "size=12345 and size=23456 and size=34567"), (23, None), (24, f"api_key={keys[0]} mail a@b.cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.detect(df).collect()}
    text = dict(rows)
    found = {d: [text[d][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "secret"] for d, r in got.items()}
    assert found[20] == ["hunter-two"] and all(found[i] == [k] for i, k in enumerate(keys))
    assert found[21] == [] and found[22] == [] and found[23] == []
    for bound in (2000, 0):
        clean = {r["doc_id"]: r["text"] for r in pii.redact(df.withColumnRenamed("x", "y"), inline_patterns=bound).collect()}
        assert clean[20] == "here api_key=[SECRET] is one more." and clean[23] is None and clean[22] == text[22]
        assert clean[24] == "api_key=[SECRET] mail [EMAIL]"


def test_values_are_found_whole_whatever_their_length(spark):
    keys, long, name, word = secrets(6), "k9-" * 41 + "end", "secret_of_the_service_account_in_use", "w" * 90
    rows = [(i, f"{cue}{k} follow") for cue, at in (('token = "', 0), (f"{name}=", 10), (f"use {word} ", 20)) for i, k in enumerate(keys, at)]
    rows += [(40, f'here token = "{long}" ends'), (41, f"here {name}=hunter-two ends"), (42, f"use {word} {long}, ends"), (43, "1" + "-" * 60_000 + "a " + "#" * 60_000)]
    df, text = spark.createDataFrame(rows, "doc_id long, text string"), dict(rows)
    found = {r["doc_id"]: [text[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]] for r in pii.detect(df).collect()}
    assert found[40] == found[42] == [long] and found[41] == ["hunter-two"] and found[43] == []
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[40] == 'here token = "[SECRET]" ends' and clean[42] == f"use {word} [SECRET], ends"


def test_found_values_support_further_patterns(spark):
    ids = [f"ID-{k}-zx" for k in range(40)]
    hops = [("token = ", secrets(8) + ids[:3]), ("ticket: ", ids[:4]), ("label: ", ids[1:5]), ("other: ", ids[4:8])]
    rows = [(100 * h + i, f"some {cue}{v} here") for h, (cue, values) in enumerate(hops) for i, v in enumerate(values)]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(kinds == (["secret"] if d < 300 else []) for d, kinds in got.items()) and len(got) == len(rows)


def test_spans_and_redaction_against_a_plain_bootstrap(spark):
    """All texts of a small table, with texts of many matches: more than a block of running values holds, and longer than a chunk."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    keys = secrets(900)
    dense = " ".join(f"w\U0001f642 a{i}@b.org api_key={k} {'x' * (i % 90)} 1.2.3.{i % 300}" for i, k in enumerate(keys))
    rows += [(10_001, dense), (10_002, " ".join(f"token = {k}" for k in keys) + " end"), (10_003, "use the api_key=a1b2c3d4 +49 30 1234567 4111 1111 1111 1111"), (10_004, ""), (10_005, None), (10_006, keys[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = dict(zip([r[0] for r in rows], brute.bootstrap([r[1] for r in rows])))
    for r in pii.detect(df).collect():
        assert [tuple(x) for x in r["spans"]] == want[r["doc_id"]]
    assert sum(s[0] not in pii.BASE_KINDS for spans in want.values() for s in spans) > 1700
    text = dict(rows)
    for r in pii.redact(df).collect():
        assert r["text"] == (None if text[r["doc_id"]] is None else brute.redacted(text[r["doc_id"]], want[r["doc_id"]]))


def test_texts_of_very_many_matches(spark):
    numbers = " ".join(str(10**7 + i) for i in range(200_000))
    mails = " ".join(f"a{i}@b.org" for i in range(50_000))
    df = spark.createDataFrame([(1, numbers), (2, mails)], "doc_id long, text string")
    got = {r["doc_id"]: r["base"] for r in pii.detect(df).collect()}
    assert got[1] == [] and len(got[2]) == 50_000 and all(mails[s["start"] : s["end"]] == f"a{i}@b.org" for i, s in enumerate(got[2]))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[1] == numbers and clean[2] == " ".join(["[EMAIL]"] * 50_000)


def test_patterns_need_distinct_seeds(spark):
    rows = [(i, f"api_key={secrets(1)[0]} again") for i in range(9)] + [(50, "api_key=other-value")]
    assert all(not r["spans"] for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_redaction_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "a@b.cc", "en", "s", 6), (2, None, None, None, None)], DOCS)
    out = pii.redact(df.withColumnRenamed("lang", "base").withColumnRenamed("source", "candidates"))
    assert out.columns == ["doc_id", "text", "base", "candidates", "n_chars"] and {tuple(r) for r in out.collect()} == {(1, "[EMAIL]", "en", "s", 6), (2, None, None, None, None)}


def test_shards(spark):
    rows = [(i, "é" * (i % 7) if i % 9 else None, "clash", "clash") for i in range(2000)] + [(None, "a", "", ""), (3, "ééé", "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, size string, shard string").repartition(5)
    got = sharding.assign(df, [1.0] * 24).collect()
    assert len(got) == len(rows)
    assert {r["shard"] for r in got} == set(range(24)) and max(sum(r["shard"] == k for r in got) for k in range(24)) < 150
    for k in range(24):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    more = {r["doc_id"]: r["shard"] for r in sharding.assign(df, [1.0] * 25).collect()}
    assert all(r["grown_shard"] == more[r["doc_id"]] and r["grown_shard"] in (r["shard"], 24) for r in got)
    assert 0.02 < sum(r["grown_shard"] == 24 for r in got) / len(got) < 0.06
    text = {r[0]: r[1] for r in rows}
    assert all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in got)
    assert sharding.assign(df.limit(0), [1.0] * 24).count() == 0


def test_heavier_shards_get_more(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "'' AS text")
    got = sharding.assign(df, [1.0, 1.0, 2.0]).groupBy("shard").count().collect()
    assert abs({r["shard"]: r["count"] for r in got}[2] / 4000 - 0.5) < 0.05
    with pytest.raises(ValueError):
        sharding.assign(df, [1.0, 0.0])


def prose(k):
    """A hundred and twenty words in sentences of nine."""
    rng = random.Random(k)
    words = ["".join(rng.choice(("ka", "ro", "mi", "te", "su", "no")) for _ in range(rng.randint(1, 4))) for _ in range(120)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))


def test_pipeline_stages(spark, tmp_path):
    texts = [prose(k) for k in range(9)]
    passage = " ".join(f"exam{i}" for i in range(30))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(20, texts[0], "en", "s", 1), (21, texts[1] + " tail", "en", "s", 1), (22, "| x | y " * 60, "en", "s", 1), (23, None, None, None, None), (24, texts[2] + " " + passage + ".", "en", "s", 1), (26, " ".join(map(prose, range(50, 70))) + " " + " ".join(passage.split()[:13]), "en", "s", 1)]
    rows += [(25, " ".join(reversed(texts[3].split())) + " write to me@home.org now.", "en", "s", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 22 not in seen["quality_rules"] and 23 not in seen["quality_rules"] and {0, 1, 20, 24, 25} <= set(seen["quality_rules"])
    assert 20 not in seen["near_duplicates"] and 0 in seen["near_duplicates"]
    assert {24, 26} <= set(seen["near_duplicates"]) and not {24, 26} & set(seen["benchmark_passages"]) and 25 in seen["benchmark_passages"]
    assert "[EMAIL]" in seen["personal_data"][25]["text"] and set(seen["tokens"]) == set(seen["personal_data"])
    assert all(r["round_trip"] for r in seen["tokens"].values())
    want = {d: brute.sha(bytes(r["ids"])) for d, r in seen["tokens"].items()}
    assert {r["doc_id"]: brute.sha(bytes(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want


def test_every_benchmark_passage_goes(spark, tmp_path):
    """Thirteen words of an item in five thousand others; twelve are no passage. Nulls, repeated rows and clashing columns pass through the stage."""
    item = [f"exam{i}" for i in range(20)]
    words = [f"w{i}" for i in range(5000)]
    text = lambda k: " ".join([*words[:2500], *item[3 : 3 + k], *words[2500:]])
    rows = [(1, text(13)), (2, text(12)), (3, None), (3, None), (None, "plain"), (5, "")]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], "doc_id long, text string, n_hit string, spans string")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.benchmark_passages(spark, df, str(tmp_path))
    assert out.columns == df.columns and sorted(map(str, (r["doc_id"] for r in out.collect()))) == ["2", "3", "3", "5", "None"]


def test_stages_take_edge_rows(spark, tmp_path):
    """Null ids and texts, empty and very long texts, a repeated row and extra columns: every stage has rows of them and all but the last keep the columns."""
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = prose(1) + " " + " ".join(prose(k) for k in range(100, 400))
    rows = [(1, prose(0)), (1, prose(0)), (None, prose(2)), (3, None), (None, None), (5, ""), (6, long)]
    df = spark.createDataFrame([(*r, "en", "s", 1, "kept", 2) for r in rows], f"{DOCS}, fp string, votes long")
    seen = {name: stage(spark, df, str(tmp_path)) for name, stage in corpus_pipeline.STAGES}
    assert all(seen[n].columns == df.columns for n in seen if n != "tokens")
    count = lambda n: sorted((str(r["doc_id"]), brute.md5(r["text"] or "")) for r in seen[n].collect())
    whole = sorted((str(i), brute.md5(t or "")) for i, t in rows)
    assert count("quality_rules") == [r for r in whole if r[1] != brute.md5("")]
    assert count("near_duplicates") == sorted({r for r in whole if r not in (("None", brute.md5("")), ("5", brute.md5("")))})
    assert count("benchmark_passages") == count("personal_data") == whole
    assert sorted(str(r["doc_id"]) for r in seen["tokens"].where("round_trip").collect()) == [r[0] for r in whole]
    assert [r["n_chars"] for r in seen["personal_data"].where("doc_id = 6").collect()] == [len(long)]


def test_pipeline_takes_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_operators_are_registered():
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
