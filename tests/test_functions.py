"""Text, dates, numerals, chunks and answers: known values and properties."""

import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import answers, calendar, chunks, dates, feasts, geometry, numerals, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("raw", "want"), [("ﬁn¬ ¶ů ﬄ⸗ꝛ", "fin- u ffl-r"), ("aͤ oͤ uͤ", "ä ö ü"), ("ü ñ", "u n"), ("⅙", "1/6"), (None, None)])
def test_glyphs(spark, raw, want):
    assert one(spark, text.normalize_glyphs, raw) == want


@pytest.mark.parametrize(("raw", "want"), [(None, 1), ("", 1), ("a", 2), ("ä漢", 6)])
def test_byte_length(spark, raw, want):
    assert one(spark, text.byte_length, raw) == want


def test_words_are_unicode(spark):
    assert one(spark, text.words, "Frü-her, 漢字 x_1!") == ["Frü", "her", "漢字", "x_1"]


@pytest.mark.parametrize(("f", "raw", "want"), [
    (text.after_first_hash, "a#b#c", "b#c"), (text.after_first_hash, "plain", "plain"), (text.local_name, "a#b#c", "c"), (text.local_name, "http://x/y/z/", "z"), (text.short_uri, "_:b1", "_:b1"),
    (text.squeeze, " a \n b ", "a b"), (text.middots, " a  b ", "a·b"), (text.safe_name, "org/m:1 x", "org_m_1_x"), (text.url_kind, "ftp://x", "other"), (text.url_kind, "https://x", "url"),
])
def test_strings(spark, f, raw, want):
    assert one(spark, f, raw) == want


def test_parsed_names(spark):
    assert tuple(one(spark, text.name_year, "abc19050101")) == ("abc", "1905") and tuple(one(spark, text.name_year, "1905abc")) == (None, None)
    assert tuple(one(spark, text.report_parts, "l343_m-x.HTML")) == ("l343", "m-x") and tuple(one(spark, text.report_parts, "x.html")) == (None, None)
    assert one(spark, text.day_first_date, "3.11.1905") == datetime.date(1905, 11, 3) and one(spark, text.day_first_date, "soon") is None


def test_root_prefix_is_a_plain_prefix(spark):
    df = spark.createDataFrame([("T1", "T1"), ("T12M1", "T1"), ("anna", "T1"), ("T1", "")], "s string, r string")
    assert [r[0] for r in df.select(text.canonical_id(F.col("s"), F.col("r"))).collect()] == ["E", "E2M1", "anna", "T1"]


def test_words_kept(spark):
    df = spark.createDataFrame([("a b c d", "a x c b d"), ("", "x"), ("a a", "a")], "s string, o string")
    assert [r[0] for r in df.select(text.words_kept(text.words(F.col("s")), text.words(F.col("o")))).collect()] == [75.0, 0.0, 50.0]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é漢.,; \n", max_size=900), st.integers(8, 160))
def test_chunks_fit_and_lose_only_separators(raw, size):
    for cut in (chunks.cut_to_bytes, chunks.cut_by_words):
        parts = cut(raw, size)
        assert all(len(p.encode()) + 1 <= size for p in parts)
    letters = lambda s: [c for c in s if c not in " .,;\n"]
    assert letters("".join(chunks.cut_to_bytes(raw, size))) == letters(raw)
    assert chunks.cut_to_bytes(None) == [] and chunks.cut_to_bytes("") == [""]


def test_chunk_order_survives(spark):
    df = spark.createDataFrame([(1, "one two three. " * 40), (2, None), (None, "x")], "id long, t string").repartition(3)
    rows = chunks.chunked(df, F.col("t"))
    assert rows.where("id = 2").first()["chunk"] is None
    joined = {r["id"]: r["text"] for r in chunks.rejoined(rows, ["id"]).collect()}
    assert joined[1].startswith("one two three") and None not in joined
    tokens = df.where("id = 1").select(chunks.byte_tokens(F.lit("é")).alias("t")).select("t", chunks.from_byte_tokens(F.col("t")).alias("s")).first()
    assert tokens["t"] == [198, 172, 1] and tokens["s"] == "é"


@pytest.mark.parametrize(("phrase", "year", "iso"), [
    ("dominica oculi", 1455, "1455-03-09"), ("dominica post Ascensionis", 1455, "1455-05-18"), ("feria 6a ante Geori", 1456, "1456-04-23"), ("in previgilia Nativitatis Christi", 1456, "1456-12-23"),
    ("in octava pasche", 1455, "1455-04-13"), ("Sabbato ante Agathe", 1457, "1457-01-29"), ("anno quo supra", 1455, "1455"), ("in die penthe- costes", 1455, "1455-05-25"), ("dominica infra octavam nativitatis marie", 1455, "1455-09-14"),
    ("feria quinta Ascensionis", 1455, None), ("per tempora", 1455, None), ("in die Martini", None, None),
])
def test_date_phrases(phrase, year, iso):
    found = dates.phrase_date(phrase, year)
    assert found["iso"] == iso and (found["reason"] is None) == (iso is not None)


def test_names_need_a_date_word_in_free_text():
    assert dates.first_date("solvit Geori de Wien", 1455)["iso"] is None and dates.first_date("solvit in die Geori", 1455)["iso"] == "1455-04-24"
    assert dates.phrase_date("Geori", 1455)["ambiguous"] is True


@pytest.mark.parametrize(("token", "near", "year"), [("lvio", 1455, 1456), ("limo", 1450, 1451), ("lxiiicio", 1462, 1463), ("ixo", 1498, None), ("io", 1499, 1501), ("abc", 1450, None), ("lvio", None, None)])
def test_years(token, near, year):
    assert dates.year_of(token, near) == year


def test_easter_is_a_sunday_in_columns_and_in_python(spark):
    rows = spark.range(1300, 1600).select(F.col("id").cast("int").alias("y")).select("y", calendar.julian_easter(F.col("y")).alias("e")).select("*", calendar.weekday(F.col("e")).alias("w")).collect()
    assert all(r["w"] == 0 and r["e"] == dates.easter(r["y"]) for r in rows)
    assert dates.week_day(datetime.date(1455, 5, 15)) == 4
    table = calendar.feast_table(spark)
    found = calendar.feast_dates(spark.createDataFrame([(1455,), (1456,)], "year int"), table).collect()
    assert len(found) == 2 * 125 and all(r["feast_date"] == dates.feast_day(r["feast"], r["year"]) for r in found)
    assert {k for k, _ in feasts.SPELLINGS} <= set(feasts.FROM_EASTER) | set(feasts.ON_DAY) | set(feasts.ADVENT)
    sundays = {r["feast"] for r in table.where(calendar.is_sunday_feast(table)).collect()}
    assert sundays == {f for f in [r["feast"] for r in table.collect()] if dates.on_sundays(f)}


@pytest.mark.parametrize(("raw", "value"), [("viij̸", 7.5), ("ij̸C xxxiiii", 184), ("iC lxxxij̸", 181.5), ("iiC vi", 206), ("x̸", 9.5), ("ix", 9), ("xl", 40)])
def test_numerals(raw, value):
    assert numerals.numeral_value(raw) == value


def test_misreadings_and_amounts(spark):
    assert numerals.misread("viij̸") == 8.5 and numerals.misread("ij̸C") == 200.5 and numerals.misread("viii") is None
    assert numerals.amount("i lb. i ort")[:2] == (1.25, "lbdwien") and numerals.amount("vi lb. minus lx d.") == (1380.0, "d", True)
    for refused in ("iii lb. xxx d.", "ort", "solvit ii lb.", "", "i lb. minus i fl. rhen."):
        with pytest.raises(numerals.Unclear):
            numerals.amount(refused)
    assert [a["unit"] for a in numerals.amounts("item v lb. d. Wien. et xx gr.")] == ["lbdwien", "gr"]
    assert one(spark, numerals.roman_value, "mcdliv") == 1454 and one(spark, numerals.roman_value, "abc") is None


def test_answers(spark):
    assert one(spark, answers.cleaned, "<think>a\nb</think>\n```xml\n<p/>\n```\n") == "<p/>" and one(spark, answers.cleaned, "a ```x``` b") == "a ```x``` b"
    assert one(spark, answers.braces, 'so: {"a": {"b": 1}} done') == '{"a": {"b": 1}}' and one(spark, answers.braces, "none") is None
    assert one(spark, answers.expanded_persons, '["A", "", null]') == ["A"] and one(spark, answers.expanded_persons, '{"persons": ["B"]}') == ["B"] and one(spark, answers.expanded_persons, "x") == []
    assert one(spark, answers.tag_counts, "<p>a</p><p/><closer>x</closer>") == "p:2 closer:1" and one(spark, answers.tag_counts, "<p>") == ""


def test_polygons(spark):
    assert tuple(one(spark, lambda c: geometry.bbox(geometry.polygon(c)), "1,2 30,4 x 5,60")) == (1, 30, 2, 60)
    turned = one(spark, lambda c: geometry.sheared_rotated(geometry.polygon(c), F.lit(0.0), F.lit(90.0), F.lit(0), F.lit(0)), "2,0")
    assert abs(turned[0]["x"]) < 1e-9 and abs(turned[0]["y"] - 2) < 1e-9


def test_feasts_are_found_alike_in_any_case():
    finder, _ = dates.feast_finder()
    for text in ("feria 3a post OCULI", "in die Sancti  Georii et viti", "\u017fancti Martini", "lxx\u0130 me pasce", "Nativitatis sancti Johannis Baptiste", "nichil", ""):
        one, two = finder.search(text, 0), dates.feasts_named(text)(0)
        assert (one and (one.span(), one.lastindex)) == (two and (two.span(), two.lastindex))


def test_phrases_are_read_once_and_by_all_cores(spark):
    from quire.plans import catalogue, given_queries

    dates._remembered.cache_clear()
    assert [dates.first_date("dominica post Oculi", 1455) for _ in range(3)][0]["iso"] and dates._remembered.cache_info().misses == 1
    plan = given_queries.doubtful_feasts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1
    for name in ("free_text_dates", "date_phrases", "free_text_amounts", "denarii"):
        assert "REPARTITION_BY_NUM" in catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
