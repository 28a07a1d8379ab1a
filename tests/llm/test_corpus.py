"""Filter audit, packing and lexical search against plain versions, on small tables with edge rows."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quire.llm import audit, lexical, packing, registry

from . import brute

PATH = public_tokenizers.path(registry.PACK_FILE)


def edge_documents(seed=7):
    """(id, text, lang): nulls in each column, empty and very long texts, copies, a repeated row, symbols, capitals."""
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "délta", "x1", "1,2", "the", "of", "Ünder", "straße", "%"]
    docs = [(i, " ".join(rng.choice(words[: rng.randint(2, 11)]) for _ in range(rng.choice([1, 5, 30, 250]))), rng.choice(["en", "de", None])) for i in range(60)]
    docs += [(100 + i, docs[i][1], "fr") for i in range(0, 30, 3)] + [(200 + i, "A copy OF Many #", "en") for i in range(40)]
    docs += [(None, None, None), (None, "alpha beta", "en"), (300, None, "en"), (301, "", None), (302, " \t\n", "de"), (303, "... !", "")]
    return docs + [docs[5], (304, "the alpha " * 60_000, "en"), (305, " ".join(f"w{i}" for i in range(300)), "en"), (306, "a\x00b\x0bc\x1cd e", "en")]


def frame(spark, docs):
    return spark.createDataFrame([(*d, "clash", 1, 2) for d in docs], "doc_id long, text string, lang string, term string, row int, fails int").repartition(3)


def labels(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, quality int, toxic int, part string")


def test_audit_against_brute_force(spark):
    docs = edge_documents()
    said = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 320, 2)] + [(None, 1, 1), (3, None, 1), (5, 1, None), (5, 0, 1)]
    got = audit.replay(audit.failures(frame(spark, docs), labels(spark, said))).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == brute.audited(docs, said) and len(got) == 600 * 4


def test_audit_sends_no_lanes_through_the_driver(spark):
    docs = spark.range(40).selectExpr("id doc_id", "'en' lang", "concat('t', id % 30) text")
    said = spark.range(40).selectExpr("id doc_id", "1 quality", "0 toxic")
    plan = audit.failures(docs, said)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 2


def test_audit_of_nothing_and_of_fewer_filters(spark):
    none = frame(spark, edge_documents()).limit(0)
    assert audit.replay(audit.failures(none, labels(spark, []))).count() == 0
    flags = spark.createDataFrame([("p", 0, True, False), ("p", 1, True, False), ("p", 3, False, True)], "part string, fails int, good boolean, toxic boolean")
    got = {(r["filter_order"], r["step"]): tuple(r)[3:] for r in audit.replay(flags, "XY").collect()}
    assert got == {("XY", 1): (1, 2, 0, 1, 1, 1, 3), ("XY", 2): (1, 0, 1, 0, 0, 0, 1), ("YX", 1): (2, 1, 0, 0, 0, 1, 1), ("YX", 2): (1, 1, 1, 1, 1, 0, 3)}
    with pytest.raises(ValueError):
        audit.replay(flags, "ABCDEF")


def plain_ids(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("text", ["", "plain  words\n\n here", "a<|endoftext|> b", " " * 1_000_000, "x" * 100_000, "Ünïcode 👩‍👩‍👧 1234567 '’s it's", "\x00﻿‍"])
def test_encoder_gives_what_the_library_gives(text):
    assert [*packing.encoder(PATH)(text), 1] == plain_ids(text)


def test_encoder_of_other_files_is_the_library():
    other = public_tokenizers.path("word_bpe_49k.json")
    assert packing.encoder(other)("Some words") == Tokenizer.from_file(other).encode("Some words", add_special_tokens=False).ids


def test_packing_covers_every_id_once(spark):
    docs = edge_documents()
    packed = packing.pack(frame(spark, docs), PATH, block=64, with_ids=True)
    rows = packed.collect()
    want = sorted(map(tuple, (plain_ids(t) for _, t, _ in docs)))
    # Pieces of one document, found by id; repeated and null ids are checked as multisets of pieces below.
    single = {i: t for i, t, _ in docs if sum(i == j for j, _, _ in docs) == 1 and i is not None}
    for i, text in single.items():
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        ids = plain_ids(text)
        assert [r["start"] for r in mine] == list(itertools.accumulate([0] + [r["length"] for r in mine]))[:-1]
        assert [x for r in mine for x in r["ids"]] == ids and {r["doc_tokens"] for r in mine} == {len(ids)}
    assert sum(r["length"] for r in rows) == sum(map(len, want))
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and 0 < r["length"] == len(r["ids"]) for r in rows)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by_sequence.values():
        placed.sort()
        assert [o for o, _ in placed] == list(itertools.accumulate([0] + [n for _, n in placed]))[:-1] and sum(n for _, n in placed) <= 2048
    windows = packing.sequences(packed, pad=1).collect()
    assert len(windows) == len(by_sequence) and all(len(w["ids"]) == 2048 and set(w["ids"][w["n_ids"] :]) <= {1} for w in windows)


def test_packing_of_nothing(spark):
    assert packing.pack(frame(spark, edge_documents()).limit(0), PATH).count() == 0


def test_packing_pads_little(spark):
    """Whole documents of the smallest tables: under two per cent of the windows is padding."""
    lengths = {}
    for r in registry.op12_packing(spark, "/root/testdata/sf0.01").collect():
        lengths[r["sequence_id"]] = lengths.get(r["sequence_id"], 0) + r["length"]
    assert max(lengths.values()) <= 2048 and sum(lengths.values()) > 0.98 * 2048 * len(lengths)


def test_differencing_levels_and_adds_windows():
    rng = random.Random(3)
    for n in (1, 2, 7, 300):
        sizes = [rng.randint(1, 2047) for _ in range(n)]
        found = packing.windows(sizes)
        assert sorted(i for w in found for i in w) == list(range(n)) and all(sum(sizes[i] for i in w) <= 2048 for w in found)
    assert len(packing.windows([1500] * 4)) == 4  # three windows could hold the sum, but not the pieces
    assert packing.differenced([8, 7, 6, 5, 4], 2)[1] == 16  # the textbook case: differences 8-7, 6-5, then 4
    assert packing.windows([]) == []


def test_halves():
    assert packing.halves(100) == [50, 25, 25] and packing.halves(5) == [5] and all(sum(packing.halves(n)) == n for n in range(1, 2100))


@pytest.mark.parametrize("limit", [lexical.BROADCAST_BYTES, 0])
def test_search_against_brute_force(spark, limit):
    docs = edge_documents()
    items = [(1, "the alpha OF délta"), (2, "copy many"), (3, None), (4, ""), (5, "nowhere"), (1, "straße"), (None, "x1 x1 ünder"), (6, "a b c d e w7 1")]
    rows = spark.createDataFrame([(*i, 1, "clash") for i in items], "item_id long, text string, row int, term string")
    got = lexical.ranked(frame(spark, docs), rows, top=7, broadcast_bytes=limit)
    assert sorted(map(tuple, got.collect()), key=repr) == brute.ranked([d[:2] for d in docs], items, 7)
    assert lexical.ranked(frame(spark, docs).limit(0), rows, broadcast_bytes=limit).count() == 0
    assert lexical.ranked(frame(spark, docs), rows.limit(0), broadcast_bytes=limit).count() == 0


def test_search_in_a_saved_index(spark, tmp_path):
    """An index of all terms, a folder for each bucket, answers like one made for the items."""
    docs = edge_documents()
    lexical.save(lexical.postings(frame(spark, docs)), f"{tmp_path}/index")
    items = spark.createDataFrame([(1, "the alpha")], "item_id long, text string")
    got = lexical.search(spark.read.parquet(f"{tmp_path}/index"), lexical.item_terms(items), 5)
    assert sorted(map(tuple, got.collect()), key=repr) == brute.ranked([d[:2] for d in docs], [(1, "the alpha")], 5)
