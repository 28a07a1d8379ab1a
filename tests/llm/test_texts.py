"""Tokens, counts, quality, fingerprints and passages against brute force, edge rows included."""

import random
import struct

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import byte_bpe, decontaminate, licenses, quality, simhash, substrings, token_counts
from quire.llm.components import components

from . import brute

BPE, PIECES = P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model")
PROSE = "The ledger of the house was kept by two scribes, and the second one wrote in a hurry. "
LONG = "x" * 60_000 + " " + "a b " * 20_000
TEXTS = [None, "", " ", "\n\n", "one", "one two three", PROSE, PROSE * 9, PROSE * 9, "Über % straße 漢字 🙂\x00\tend", "| a | b | c | " * 40, "Same line here\n" * 30, "  double  spaces <s> ▁x ", LONG]
SCHEMA = "doc_id long, text string, n_tokens string, kept string, fp string, base string, votes string, spans string, size string, shard string, ids string, `__row` string, digest string"


@pytest.fixture(scope="module")
def docs(spark):
    """Edge rows with columns that clash with what operators make; row 8 repeats row 7, and the last row repeats the one before."""
    rows = [(i, t, *["clash"] * 11) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[-2]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def reference_bpe():
    bpe = byte_bpe.tokenizer(BPE, P.PATTERN)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_bpe_on_edge_rows(docs, none):
    enc = reference_bpe()
    rows = byte_bpe.encode_decode(docs, BPE, P.PATTERN).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        ids = enc.encode_ordinary(TEXTS[r["doc_id"]] or "")
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids) and r["n_tokens"] == len(ids)
        assert bytes(r["decoded"]) == (TEXTS[r["doc_id"]] or "").encode()
    assert byte_bpe.encode_decode(none, BPE, P.PATTERN).count() == 0
    packed = byte_bpe.encode(docs, BPE, P.PATTERN)
    assert {(r["doc_id"], bytes(r["decoded"])) for r in byte_bpe.decode(packed, BPE, P.PATTERN).collect()} == {(i, (t or "").encode()) for i, t in enumerate(TEXTS)}


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_bpe_round_trip(text):
    bpe = byte_bpe.tokenizer(BPE, P.PATTERN)
    assert bpe.encode(text) == reference_bpe().encode_ordinary(text)
    assert bpe.decode(bpe.encode(text)) == text.encode()


def test_merge_tree_takes_the_leftmost_of_equal_ranks():
    ranks = {bytes([c]): c for c in range(256)} | {b"ab": 300, b"abab": 301}
    assert byte_bpe.merge_piece(b"ababab", ranks) == [301, 300]


def test_token_counts_on_edge_rows(docs, none):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = token_counts.count_tokens(docs, PIECES, 100).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = TEXTS[r["doc_id"]] or ""
        n = len(model.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 100)
        assert len(model.encode(text[: r["fit_chars"]])) <= 100
    assert token_counts.count_tokens(none, PIECES, 100).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab the▁ing é\n\t漢🙂<s>0", max_size=40))
def test_every_prefix_has_its_count(text):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counts = token_counts.counter(PIECES).prefixes(text)
    assert counts.tolist() == [len(model.encode(text[:i])) for i in range(len(text) + 1)]


def test_prefix_table_answers_budgets(spark):
    row = token_counts.count_tokens(spark.createDataFrame([(1, PROSE)], "doc_id long, text string"), PIECES, 5, with_prefixes=True).first()
    assert len(row["prefix_tokens"]) == len(PROSE) + 1 and row["prefix_tokens"][row["fit_chars"]] <= 5


def test_quality_measures(docs, none):
    rows = quality.judged(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute.quality(TEXTS[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])
    assert quality.judged(none).count() == 0 and quality.keep_good(none).count() == 0
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert sorted(r["doc_id"] for r in quality.keep_good(docs).collect()) == sorted(r["doc_id"] for r in rows if r["doc_id"] in kept)
    assert quality.keep_good(docs).columns == docs.columns


def test_quality_model_learns_which_rules_tell():
    good, junk, noisy = (quality.GOOD,) * 9, (quality.BAD,) * 3 + (quality.GOOD,) * 6, (quality.GOOD,) * 3 + (quality.BAD,) + (quality.GOOD,) * 3 + (quality.BAD,) * 2
    model = quality.fit({quality.pattern(good): 8000, quality.pattern(junk): 500, quality.pattern(noisy): 400})
    assert model.posterior(good) > 0.9 and model.posterior(junk) < 0.1 and model.posterior(noisy) < 0.1
    assert all(b > g for b, g in zip(model.bad_on_bad[:4], model.bad_on_good[:4]))
    assert model.posterior((quality.ABSTAIN,) * 9) == pytest.approx(model.good)


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    rows = quality.judged(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) >= 0.97 * len(rows)


@pytest.mark.parametrize("junk", [0, 1, 40])
def test_clean_texts_stay_whatever_the_share_of_junk(junk):
    rng = random.Random(junk)
    word = lambda: "".join(rng.choice(("ka", "ro", "mi", "te", "su")) for _ in range(rng.randint(1, 4)))
    clean = [" ".join(word() + ("." if i % 11 == 10 else "") for i in range(rng.randint(60, 300))) for _ in range(300)]
    texts = clean + ["| " + " | ".join(word() for _ in range(80)), "Same old line of words.\n" * 40, "AGAIN " * 90, "%%% &&& " * 60] * junk
    found = [quality.measures(t.encode(), t) for t in texts]
    patterns = [quality.pattern(quality.votes(m)) for m in found]
    model = quality.fit({p: patterns.count(p) for p in set(patterns)})
    kept = [not quality.base_failed(m) and model.posterior(quality.unpack(p)) >= quality.THRESHOLD for m, p in zip(found, patterns)]
    assert all(kept[:300]) and not any(kept[300:])


ITEMS = [(1, PROSE * 2), (2, "two scribes and"), (3, None), (4, ""), (1, PROSE * 2), (None, "漢字 🙂 end of"), (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen")]


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_decontamination_both_ways(spark, docs, none, bound):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontaminate.contamination(docs, bench, broadcast_bytes=bound).collect()
    assert len(rows) == len(TEXTS) + 1
    items = [("null" if i is None else i, t) for i, t in ITEMS]
    for r in rows:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) == brute.contamination(TEXTS[r["doc_id"]], items)
    for r in rows:
        assert_spans(TEXTS[r["doc_id"]], items, r)
    for share in (0.0, 0.05):
        clean = decontaminate.keep_clean(docs, bench, broadcast_bytes=bound, share=share)
        assert clean.columns == docs.columns
        assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in rows if not (r["contaminated"] if share else r["n_hit"]))
    cut = decontaminate.cut_passages(docs, bench, broadcast_bytes=bound)
    assert cut.columns == docs.columns and cut.count() == len(rows) and decontaminate.cut_passages(none, bench, broadcast_bytes=bound).count() == 0
    found = {r["doc_id"]: r["spans"] for r in rows}
    for r in cut.collect():
        text = TEXTS[r["doc_id"]]
        want = None if text is None else "".join(c for i, c in enumerate(text) if not any(s["start"] <= i < s["end"] for s in found[r["doc_id"]][:200])) if len(text) < 5000 else r["text"]
        assert r["text"] == want and r["n_tokens"] == "clash"
    assert decontaminate.contamination(none, bench, broadcast_bytes=bound).count() == 0
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, empty, broadcast_bytes=bound).where("contaminated").count() == 0


def assert_spans(text, items, row):
    """The spans hold the hit words and no others."""
    hit, words = brute.hit_words(text, items), list(brute.TEXT_WORD.finditer(brute.lower(text or "")))
    inside = {k for k, m in enumerate(words) if any(s["start"] <= m.start() and m.end() <= s["end"] for s in row["spans"])} if len(words) < 5000 else hit
    assert inside == hit and all(a["end"] < b["start"] for a, b in zip(row["spans"], row["spans"][1:]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.sampled_from("abc"), min_size=1, max_size=30))
def test_winnowing_misses_no_window(doc, item):
    index = decontaminate.Index([("i", " ".join(item).encode())], 13)
    words = decontaminate.words_of(" ".join(doc).encode())
    row = decontaminate._row(" ".join(doc), words, index)
    got = (*row[:4], row[5])
    assert got == brute.contamination(" ".join(doc), [("i", " ".join(item))])


def near_copies():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for g in range(12):
        words = [rng.choice(vocabulary) for _ in range(200)]
        for _ in range(5):
            changed = list(words)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(200)] = rng.choice(vocabulary)
            out.append(" ".join(changed))
    return out


def test_simhash_components(spark, none):
    texts = [*TEXTS, *near_copies()]
    rows = [(i, t) for i, t in enumerate(texts)]
    clashing = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in [*rows, rows[-1]]], "doc_id long, text string, fp string, root string, component_id string")
    found = simhash.near_duplicates(clashing.repartition(3)).collect()
    prints = {i: brute.fingerprint(t) for i, t in rows}
    edges = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    want = brute.components(list(prints), edges)
    assert len(found) == len(rows) + 1
    for r in found:
        assert r["fp"] % (1 << 64) == prints[r["doc_id"]] and r["component_id"] == want[r["doc_id"]]
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_ring_join_is_complete_with_either_key(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(40)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centres for _ in range(6)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) % (1 << 64)).bit_count() <= 4}
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    for segments in (1, 2):
        assert {(r["u"], r["v"]) for r in simhash.links(table, segments).distinct().collect()} == want
    near = simhash.flip_links(table).collect()
    assert all(((r["u"] ^ r["v"]) % (1 << 64)).bit_count() <= 2 for r in near)


def _near_copies():
    """Groups of texts with some words changed, a passage that many share, a chain, and texts of a few words."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, passage = [], [word() for _ in range(60)]
    for size, changes in ((2, 3), (2, 8), (40, 2), (12, 5)):
        base = [word() for _ in range(200)]
        for _ in range(size):
            copy = list(base)
            for at in rng.sample(range(200), rng.randint(0, changes)):
                copy[at] = word()
            rows.append(" ".join(copy))
    rows += [" ".join([*(word() for _ in range(60)), *passage]) for _ in range(20)]
    chain = [word() for _ in range(300)]
    rows += [" ".join(chain[i * 12 : i * 12 + 200]) for i in range(6)]
    rows += ["one two", "One  two", "one two three", "", rows[5], rows[0].upper()]
    return list(enumerate(rows))


def test_keep_one_against_brute_force(spark):
    """Groups by exact Jaccard similarity of 0.8 over five words, or fingerprints within four bits."""
    rows = _near_copies()
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5)) for i, t in rows}
    prints = {i: simhash.fingerprint(simhash.shingle_hashes(t.encode(), 5)) % (1 << 64) for i, t in rows}
    alike = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4 or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0
    edges = [(a, b) for a in sets for b in sets if a < b and alike(a, b)]
    want = sorted(set(brute.components(list(sets), edges).values()))
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, text string, key string, bands string").repartition(5)
    kept = simhash.keep_one(df, similarity=0.8, k=5)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == want
    assert len(want) < len(rows) - 50


def test_large_groups_of_near_copies_cost_their_rows(spark, monkeypatch):
    """Copies changed in so many places of their own that many are below 0.8 to all others: the groups of brute force, without comparing their pairs."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))

    def changed(words: list[str], most: int) -> list[str]:
        out = list(words)
        for at in rng.sample(range(len(words)), rng.randint(0, most)):
            out[at] = rng.choice(("", word(), f"{out[at]} {word()}"))
        return out

    base = [word() for _ in range(120)]
    far = changed(base, 12)
    texts = [changed(base, 12) for _ in range(320)] + [changed(far, 6) for _ in range(60)] + [base[:100] + changed(base[100:], 9) for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5)) for i, t in rows}
    prints = {i: simhash.fingerprint(simhash.shingle_hashes(t.encode(), 5)) % (1 << 64) for i, t in rows}
    alike = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4 or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    want = sorted(set(brute.components(list(sets), [(a, b) for a in sets for b in sets if a < b and alike(a, b)]).values()))
    compared, exact = [], simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda pairs, *more: compared.append(pairs.count()) or exact(pairs, *more))
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), similarity=0.8, k=5)
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    assert 50 < len(want) < len(rows) - 50 and sum(compared) < 12 * len(rows)


def test_pairs_that_share_their_differences(spark):
    """All pairs at 0.8 of which one is below 0.8 to the centre, whatever the centre; none that both share too little."""
    rng = random.Random(5)
    sets = {0: set(range(100))}
    for i in range(1, 160):
        start = sets[rng.choice([0, 0, 0, *range(i)])]
        sets[i] = set(rng.sample(sorted(start), len(start) - rng.randint(0, len(start) // 8))) | {rng.randrange(100, 400) for _ in range(rng.randint(0, 20))}
    like = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    for centre in (0, 7, 150):
        rows = [(centre, centre, len(sets[centre]), i, i, len(s), i, like(s, sets[centre]), sorted(s ^ sets[centre])) for i, s in sets.items() if i != centre]
        ddl = "key_u long, u long, n_u int, key_v long, v long, n int, now long, alike boolean, differ array<long>"
        found = {(min(r["u"], r["v"]), max(r["u"], r["v"])) for r in simhash.sharing(spark.createDataFrame(rows, ddl), 0.8).collect()}
        near = {r[3] for r in rows if r[7]}
        want = {(a, b) for a in sets for b in sets if a < b and centre not in (a, b) and not {a, b} <= near and like(sets[a], sets[b])}
        assert want <= found and len(want) > 20 and len(found) < 160 * 159 // 4


def test_bands_depend_on_sets_alone():
    hashes = simhash.shingle_hashes(" ".join(f"w{i}" for i in range(5000)).encode(), 5)
    assert simhash.bands(hashes) == simhash.bands(hashes[::-1] + hashes[:9]) and simhash.bands([]) == (0, [])
    assert len(simhash.bands(hashes)[1]) == simhash.BANDS and simhash.bands(hashes)[0] == len(hashes)


def test_null_ids_have_components(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (None, "z y x w v u t")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in found) == [("7", "7"), ("None", "7"), ("None", "7"), ("None", "None")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("7", "a b c d e f"), ("None", "z y x w v u t")]


def test_one_id_with_several_texts(spark):
    """The smallest id names the component; rows of that id with another text go by the digest, and repeated rows stay once."""
    rows = [(1, "a b c d e f", "x"), (1, "A b c d e f", "x"), (2, "a b c d e f", "y"), (1, "z y x w v u t", "z"), (1, "z y x w v u t", "z")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert sorted((r["doc_id"], r["text"].lower(), r["fp"]) for r in kept) == [(1, "a b c d e f", "x"), (1, "z y x w v u t", "z")]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 1), (2, 3)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(40)] + [(100, 101)]])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute.components(sorted({n for e in edges for n in e}), edges)


@pytest.mark.parametrize("unit, least", [("sentence", 10), ("sentence", substrings.MIN_WORDS), ("line", 1)])
def test_repeats(spark, docs, none, unit, least):
    passage = "First of all the clerk came in. He sat down at once. Then he wrote the whole long night through and all of the next day too."
    rows = [(1, f"Own words here {passage} and more"), (2, f"Other words\nbefore {passage} Nothing else."), (3, "He sat down at once. Alone."), (4, None), (5, ""), (6, PROSE + "So it was for years."), (7, PROSE + "So it was for years."), (8, "the same\nIn\n the  SAME \n\nin"), (9, "own\nin")]
    got = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), min_words=least, unit=unit)
    want = brute.repeats(rows, least, unit)
    assert sorted(tuple(r) for r in got.collect()) == want
    if unit == "line":
        assert {w[0] for w in want} == {7, 8, 9} and [(8, *w[1:4]) for w in want if w[0] == 8] == [(8, 13, 22, 2), (8, 25, 27, 1)]
        return
    assert {w[0] for w in want} == {2, 7}
    cleaned = {r["doc_id"]: r["text"] for r in substrings.without(spark.createDataFrame(rows, "doc_id long, text string"), got).collect()}
    assert cleaned[7].strip() == "" and cleaned[1] == rows[0][1] and "He sat down" not in cleaned[2] and cleaned[2].startswith("Other words\nbefore First")


def test_repeats_on_edge_rows(spark, docs, none):
    """All of them, the very long text and the clashing columns too; the repeated row has the number of the one before, and ranks with it."""
    for unit, least in (("sentence", substrings.MIN_WORDS), ("line", 1)):
        edge = substrings.repeats(docs, min_words=least, unit=unit)
        once = sorted(tuple(r) for r in edge.where("doc_id <> 12").collect())
        assert edge.columns == ["doc_id", "start", "end", "n_words", "first_id", "first_start"]
        assert once == [r for r in brute.repeats(list(enumerate(TEXTS)), least, unit) if r[0] != 12]
        assert substrings.repeats(none, min_words=least, unit=unit).count() == 0
    with pytest.raises(ValueError):
        substrings.repeats(docs, unit="page")


def test_a_repeated_row_is_an_occurrence(spark):
    got = substrings.repeats(spark.createDataFrame([(1, PROSE * 2), (1, PROSE * 2), (None, PROSE * 2)], "doc_id long, text string").coalesce(1), min_words=10)
    assert {(str(r["doc_id"]), r["first_id"]) for r in got.collect()} == {("1", 1), ("None", 1)}


def test_passages_without_sentence_ends_are_found(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(rng.randint(3, 40))) + f" {passage} " + " ".join(word() for _ in range(30))) for i in range(12)]
    got = substrings.repeats(spark.createDataFrame([*rows, (50, " ".join(word() for _ in range(200)))], "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == set(range(1, 12)) and {r["first_id"] for r in got} == {0}
    text = dict(rows)
    assert all(text[r["doc_id"]][r["start"] : r["end"]] in passage for r in got)


LICENSE_COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def test_licenses(spark, docs, none):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files. Etc."
    prose = "She was released from the hospital under the terms of her MIT license plate deal."
    rows = [(1, "x\n\nReleased under the MIT License.\ny"), (2, "Licensed under CC BY-NC 4.0. All rights\nreserved"), (3, "under the license of a mit"), (4, None), (5, mit), (6, "cc by cc by"), (7, "released " * 3 + "mit"), (8, prose)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert tuple(got[i][c] for c in LICENSE_COLUMNS) == brute.licenses(text, licenses.TEMPLATES, licenses.PHRASES)
    assert got[1]["labels"] == ["mit"] and got[1]["score"] == 1.0 and got[1]["n_base"] == 0 and got[1]["first_word"] is None
    assert [(m["block"], m["first"], m["end"]) for m in got[1]["matches"]] == [(1, 1, 6)]
    assert got[2]["base_labels"] == ["cc-by", "reserved"] and (got[2]["first_word"], got[2]["last_word"]) == (2, 7)
    assert got[5]["labels"] == ["mit"] and got[6]["n_base"] == 2 and all(got[i]["labels"] == [] for i in (3, 4, 7, 8))
    edge = licenses.scan(docs).collect()
    assert len(edge) == len(TEXTS) + 1 and licenses.scan(none).count() == 0
    for r in edge:
        assert tuple(r[c] for c in LICENSE_COLUMNS) == brute.licenses(TEXTS[r["doc_id"]], licenses.TEMPLATES, licenses.PHRASES)
    with pytest.raises(ValueError):
        licenses.scan(none, templates=[("one", "word")])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=16), st.dictionaries(st.tuples(st.sampled_from([b"a", b"b"]), st.sampled_from([b"b", b"c"])), st.integers(0, 9)))
def test_containment_join_is_exact(block, frequency):
    templates = [("one", "a b c d e f"), ("two", "a b c"), ("three", "h g")]
    scanner = licenses.Scanner(templates, frequency, 0.8)
    have, wanted = set(zip(block, block[1:])), {label: set(zip(t.split(), t.split()[1:])) for label, t in templates}
    want = sorted((label, len(w & have) / len(w)) for label, w in wanted.items() if 10 * len(w & have) >= 8 * len(w))
    assert sorted(scanner.block([w.encode() for w in block])) == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n\t\r#", max_size=40))
def test_blocks_are_sentences_over_lines(text):
    assert [[w.decode() for w in b] for b in licenses.blocks(text.encode())] == brute.blocks(text)


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal",
    "bsd": " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\r\npurpose with or without fee is hereby granted, provided that",
    "lgpl": "# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed",
}


def test_wrapped_licenses(spark):
    rows = [*WRAPPED.items(), ("apart", WRAPPED["mit"].replace("\n", "\n\n")), ("list", "released\n" + "x\n" * 30 + "under\nthe\n" + "y\n" * 30 + "license\nmit")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for label in WRAPPED:
        assert label in got[label]["labels"] and got[label]["score"] >= 0.8
        assert [m["block"] for m in got[label]["matches"] if m["label"] == label] == [0]
        assert tuple(got[label][c] for c in LICENSE_COLUMNS) == brute.licenses(WRAPPED[label], licenses.TEMPLATES, licenses.PHRASES)
    assert got["apart"]["labels"] == got["list"]["labels"] == []


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_items_that_repeat_an_id_with_other_texts(spark, bound):
    long, short = " ".join(f"q{i}" for i in range(40)), " ".join(f"r{i}" for i in range(14))
    items = [(1, long), (1, short), (None, short + " end"), (None, long + " more"), (1, short)]
    texts = ["x y " + long + " z", "a " + short + " b", short + " end " + long, "none of it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=bound).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) == brute.contamination(texts[r["doc_id"]], [("null" if i is None else i, t) for i, t in items])


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_random_items_with_repeated_ids_and_stock_phrases(spark, bound):
    rng = random.Random(11)
    stock = " ".join(f"s{i}" for i in range(15))
    word = lambda: rng.choice("abcdefghij")
    items = [(rng.choice([1, 2, 3, None]), " ".join([*(word() for _ in range(rng.randint(0, 20))), *([stock] if rng.random() < 0.6 else []), *(word() for _ in range(rng.randint(0, 20)))])) for _ in range(30)]
    texts = [" ".join([*(word() for _ in range(rng.randint(0, 40))), *([stock] if rng.random() < 0.5 else []), *([rng.choice(items)[1].upper()] if rng.random() < 0.5 else [])]) for _ in range(40)]
    texts += ["own " * 5000 + " ".join(items[0][1].split()[:13]) + " tail"]
    named = [("null" if i is None else i, t) for i, t in items]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string").repartition(3)
    rows = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=bound).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = texts[r["doc_id"] or 0]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) == brute.contamination(text, named)
        assert_spans(text, named, r)
