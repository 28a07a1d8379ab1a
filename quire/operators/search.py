"""Name search: mentions to persons of a catalogue, by rarity-weighted fuzzy tokens.

Distinct tokens are compared with distinct name forms, not mentions with persons, and of those only the pairs that a partition index proposes: see ``proposed``.
"""

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.arrow import arrow_udf
from quire.session import dealt
from quire.sources.folders import kept

FLOOR, FORMS, TOP = 82, 30, 6
#: A token that leads to more persons is frequent; such are joined in so many tasks each.
RARE, LANES = 100, 32
#: Words of rank and of connection in names.
TITLES = [
    "kg", "kgin", "kr", "ks", "hg", "hgin", "ehg", "ehgin", "gf", "gfin", "mgf", "pfgf", "landgf", "burggf", "fst", "frh", "bf", "ebf", "kard",
    "papst", "abt", "propst", "dr", "mag", "ritter", "meister", "doge", "sultan", "prinz", "kfst", "kaiser", "könig", "herzog", "graf", "infant", "dauphin",
]
GLUE = ["von", "zu", "zum", "zur", "van", "de", "der", "des", "di", "da", "d", "aus", "le", "la", "del", "della", "und", "il", "lo", "genannt", "gen"]
_PART = r"[^\s,;:()/]+"


def folded(s: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", s or "") if not unicodedata.combining(c)).lower()


@arrow_udf("string")
def fold(values: pd.Series) -> pd.Series:
    return values.map(folded)


def parts(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PART), F.lit(0))


def stripped(token: Column) -> Column:
    return F.regexp_replace(token, r"^[.'\-]+|[.'\-]+$", "")


def tokens(text: Column) -> Column:
    """array<string> of name tokens: each part and its hyphenated parts (a part without a hyphen comes twice), four letters or more, a capital first, no
    title and no connecting word."""
    both = F.flatten(F.transform(parts(text), lambda p: F.concat(F.array(p), F.split(p, "-"))))
    usable = lambda t: (F.length(t) >= 4) & F.substring(t, 1, 1).rlike(r"\p{Lu}") & ~F.lower(t).isin(*TITLES, *GLUE)
    return F.filter(F.transform(both, stripped), usable)


def titles(text: Column) -> Column:
    """array<string> of the words of rank, in lower case."""
    return F.filter(F.transform(parts(text), lambda p: F.lower(stripped(p))), lambda t: t.isin(*TITLES))


def head_name(headword: Column) -> Column:
    """The headword before its first slash, without what stands in brackets."""
    return F.trim(F.regexp_replace(F.substring_index(headword, "/", 1), r"\(.*?\)", ""))


def without_titles(text: Column) -> Column:
    return F.array_join(F.filter(parts(text), lambda p: ~F.lower(stripped(p)).isin(*TITLES, *GLUE)), " ")


def name_forms(persons: DataFrame) -> DataFrame:
    """Distinct rows (pid, form) of a catalogue (schema PERSONS of the readers); words of rank are forms with a # before them."""
    nothing = F.array().cast("array<string>")
    sources = F.concat(F.array(head_name(F.col("headword")), F.col("label")), F.coalesce("variants", nothing), F.coalesce("aliases", nothing), F.coalesce("profile.mention_forms", nothing))
    words = persons.select(F.col("id").alias("pid"), F.explode(F.flatten(F.transform(sources, tokens))).alias("t")).select("pid", "t").distinct()
    ranks = persons.select(F.col("id").alias("pid"), F.explode(titles(F.col("label"))).alias("t")).distinct()
    return words.select("pid", fold(F.col("t")).alias("form")).union(ranks.select("pid", F.concat(F.lit("#"), fold(F.col("t"))).alias("form"))).distinct()


def weights(forms: DataFrame, n: DataFrame) -> DataFrame:
    """Rows (form, df, weight): ln(persons / persons with the form). n: one row with the number of persons."""
    return forms.groupBy("form").agg(F.count_distinct("pid").alias("df")).crossJoin(F.broadcast(n)).select("form", "df", F.log(F.col("n") / F.col("df")).alias("weight"))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def likeness(a: str, b: str) -> float:
    """0 to 100: twice the longest common subsequence over both lengths; two empty strings are alike."""
    n = len(a) + len(b)
    return 100.0 if n == 0 else 200.0 * common_length(a, b) / n


def set_likeness(a: str, b: str) -> float:
    """0 to 100 by the words both have and the words only one has: best of the three ways to compare them. A common word with nothing left on one side is 100."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, one, two = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not one or not two):
        return 100.0
    if not both:
        return likeness(one, two)
    # All begin with the words they share and a blank, which the longest common subsequence may take.
    n, m, k = len(both), len(one), len(two)
    return max(200.0 * (n + 1 + common_length(one, two)) / (2 * n + m + k + 2), 200.0 * n / (2 * n + 1 + m), 200.0 * n / (2 * n + 1 + k))


@arrow_udf("double")
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness(x, y) for x, y in zip(a, b)], dtype="float64")


@arrow_udf("double")
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([set_likeness(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


#: Two lengths whose strings have at most so many ways to lose the letters they do not share, three at most, meet by what is left; up to so many edits, two segments make a
#: key; beyond, one does, as the places of two become too many.
WAYS, PAIRS = 100, 6
#: Where a segment starts and how long it is, of n that cut a string of lb letters: the last ones are the longer by one.
_START = "({0} - 1) * (lb div n) + greatest(0, {0} - 1 - (n - lb % n)) + 1"
_SIZE = "lb div n + CASE WHEN {0} > n - lb % n THEN 1 ELSE 0 END"
_CHOICES = "CASE {0} - common WHEN 0 THEN 1 WHEN 1 THEN {0} WHEN 2 THEN {0} * ({0} - 1) / 2 WHEN 3 THEN {0} * ({0} - 1) * ({0} - 2) / 6 ELSE 1000000 END"


#: The distinct strings that s becomes without ``gone`` letters, three at most: letter after letter, from left to right.
_RESTS = """array_distinct(transform(aggregate(slice(array(1, 2, 3), 1, gone), array(struct(s AS t, 1 AS p)), (acc, _) -> flatten(transform(filter(acc, y -> y.p <= length(y.t)), x ->
    transform(sequence(x.p, length(x.t)), q -> struct(concat(substring(x.t, 1, q - 1), substring(x.t, q + 1)) AS t, q AS p))))), z -> z.t))"""


def _cut(strings: DataFrame, column: str, own: str, other: str, floor: float) -> DataFrame:
    """Rows (s, la, lb, k, n, i, j, rests): each distinct string with each length of its partners, the edits allowed, the segments, and each pair of segments that may be the one that matches.

    Where what is left is the key, i is -1 and rests are the strings that are left.
    """
    ratio = floor / (200 - floor)
    rows = dealt(strings.select(F.col(column).alias("s")).where("s IS NOT NULL").distinct(), "s").withColumn(own, F.length("s"))
    rows = rows.withColumn(other, F.explode(F.sequence(F.ceil(F.col(own) * ratio - 1e-9).cast("int"), F.floor(F.col(own) / ratio + 1e-9).cast("int"))))
    rows = rows.withColumn("common", F.ceil((F.col("la") + F.col("lb")) * (floor / 200) - 1e-9).cast("int")).where("common <= least(la, lb)")
    rows = rows.withColumn("k", F.expr("la + lb - 2 * common")).withColumn("n", F.expr(f"greatest(1, least(k + CASE WHEN k <= {PAIRS} THEN 2 ELSE 1 END, lb))"))
    pairs = f"""CASE WHEN greatest({_CHOICES.format("la")}, {_CHOICES.format("lb")}) <= {WAYS} THEN array(struct(-1 AS i, -1 AS j))
                     WHEN n - k >= 2 THEN flatten(transform(sequence(1, n - 1), i -> transform(sequence(i + 1, n), j -> struct(i AS i, j AS j))))
                     WHEN n - k = 1 THEN transform(sequence(1, n), i -> struct(i AS i, i AS j)) ELSE array(struct(0 AS i, 0 AS j)) END"""
    rows = rows.select("s", "la", "lb", "k", "n", (F.col(own) - F.col("common")).alias("gone"), F.expr(f"inline({pairs})"))
    return rows.withColumn("rests", F.expr(f"CASE WHEN i = -1 THEN {_RESTS} END"))


_KEY = ["la", "lb", "i", "j", "one", "two"]


def indexed(right: DataFrame, column: str, floor: float = FLOOR) -> DataFrame:
    """The index: rows (_KEY, s) of the strings and their pairs of segments, or what is left of them."""
    segment = lambda x: f"substring(s, {_START.format(x)}, {_SIZE.format(x)})"
    one = F.expr(f"CASE WHEN i = -1 THEN rests WHEN i > 0 THEN array({segment('i')}) ELSE array('') END")
    two = F.expr(f"CASE WHEN j > i THEN {segment('j')} ELSE '' END")
    return _cut(right, column, "lb", "la", floor).select("la", "lb", "i", "j", F.explode(one).alias("one"), two.alias("two"), "s")


def probes(left: DataFrame, column: str, floor: float = FLOOR) -> DataFrame:
    """Rows (_KEY, s) of what the strings ask the index for: the pieces that stand where a segment may have been moved to, or what is left of them."""
    rows = _cut(left, column, "la", "lb", floor).withColumns({"pi": F.expr(_START.format("i")), "si": F.expr(_SIZE.format("i")), "pj": F.expr(_START.format("j")), "sj": F.expr(_SIZE.format("j"))})
    # Moved by as many letters as there are edits before it, or by two, four, … fewer.
    rows = rows.withColumn("move", F.explode(F.expr("CASE WHEN i <= 0 THEN array(0) ELSE sequence(1 - i, i - 1, 2) END")))
    rows = rows.withColumn("more", F.explode(F.expr("CASE WHEN j > i THEN sequence(i + 1 - j, j - i - 1, 2) ELSE array(0) END")))
    fits = """i <= 0 OR (pi + move >= 1 AND pi + move + si - 1 <= la AND abs(la - lb - move - more) <= k - j + CASE WHEN j > i THEN 2 ELSE 1 END
              AND (j = i OR (pj + move + more >= pi + move + si AND pj + move + more + sj - 1 <= la)))"""
    one = "CASE WHEN i = -1 THEN rests WHEN i > 0 THEN array(substring(s, pi + move, si)) ELSE array('') END"
    two = "CASE WHEN j > i THEN substring(s, pj + move + more, sj) ELSE '' END"
    return rows.where(fits).select("la", "lb", "i", "j", F.explode(F.expr(one)).alias("one"), F.expr(two).alias("two"), "s")


def proposed(left: DataFrame, right: DataFrame, a: str, b: str, floor: float = FLOOR) -> DataFrame:
    """Distinct rows (a, b): all pairs of strings at least ``floor`` alike, and few others.

    Strings of la and lb letters are that alike when k = la + lb - 2 * (letters in common) insertions and deletions turn one into the other. The second is cut into k + 2
    segments. Each edit touches one of them, so two are whole. Counted from the left, take the first that is preceded by as many edits as segments, and the next such
    one behind it: edits before either are then known, so each stands at one of few places in the first string. Pairs of segments, with both lengths, are the key; a
    syllable that all names share is one segment and makes no bucket by itself.

    Segments of short strings are short, so for these the key is what is left when the letters that need not be shared are gone: only strings that are alike meet there.
    Strings with fewer than k + 2 letters, and those with many edits, have k + 1 segments and a key of one; where even these are more than letters (low floors, short strings with
    many ways to lose letters) all of two lengths are compared.

    The sides meet by a shuffle: Spark's estimate does not count the hundreds of keys of a string, and by it would send them all through the driver.
    """
    if not 0 < floor <= 100:
        raise ValueError("the floor is a likeness above 0, to 100")
    return probes(left, a, floor).withColumnRenamed("s", a).join(indexed(right, b, floor).withColumnRenamed("s", "__b").hint("merge"), _KEY).select(a, F.col("__b").alias(b)).distinct()


def buckets(left: DataFrame, right: DataFrame, a: str, b: str, floor: float = FLOOR) -> DataFrame:
    """Rows (_KEY, n_left, n_right): how many strings of each side meet in a bucket of the index, to see how skewed it is."""
    sides = [side.groupBy(*_KEY).agg(F.count("*").alias(n)) for side, n in ((probes(left, a, floor), "n_left"), (indexed(right, b, floor), "n_right"))]
    return sides[0].join(sides[1], _KEY)


def similar(left: DataFrame, right: DataFrame, a: str, b: str, floor: float = FLOOR) -> DataFrame:
    """Rows (a, b, ratio) of strings at least ``floor`` alike, all of them. Nulls are like nothing."""
    return proposed(left, right, a, b, floor).withColumn("ratio", ratio(F.col(a), F.col(b))).where(F.col("ratio") >= floor)


def candidates(mentions: DataFrame, persons: DataFrame, mention: str = "mention", floor: float = FLOOR, most_forms: int = FORMS, top: int = TOP) -> DataFrame:
    """Rows (mention, pid, score, rank) for distinct mentions.

    A word of rank adds its weight, a token the best likeness / 100 * weight over its most similar forms (ties by form); persons are
    ranked by score, then likeness of the whole mention to their label, then id. The limits are the search's own.

    Where as many persons as are wanted, found by rare tokens and words of rank, score more than the frequent ones can add up to, persons who have only these are not looked at.
    For other mentions they are: mentions times persons with a frequent name, over all tasks.
    """
    said = mentions.select(mention).distinct()
    forms = name_forms(persons)
    weighed = weights(forms, persons.agg(F.count("*").alias("n")))
    ranks = said.select(mention, F.explode(titles(F.col(mention))).alias("t")).select(mention, F.concat(F.lit("#"), fold(F.col("t"))).alias("form"))
    by_rank = ranks.join(weighed, "form").join(forms, "form").select(mention, "pid", F.col("weight").alias("part"))
    toks = said.select(mention, F.posexplode(tokens(F.col(mention))).alias("at", "t")).select(mention, "at", fold(F.col("t")).alias("token"))
    pairs = similar(toks, weighed, "token", "form", floor)
    best_forms = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("ratio"), "form"))
    held = pairs.withColumn("__r", best_forms).where(F.col("__r") <= most_forms).drop("__r").join(weighed, "form")
    per_token = kept(held.join(forms, "form").groupBy("token", "pid").agg(F.max(F.col("ratio") / 100 * F.col("weight")).alias("part")))
    of_token = kept(toks.join(per_token.groupBy("token").agg(F.count("*").alias("n"), F.max("part").alias("most")), "token"))
    rare, frequent = of_token.where(F.col("n") <= RARE), of_token.where(F.col("n") > RARE).select(mention, "at", "token", "most")
    by_rare = kept(by_rank.union(rare.join(per_token, "token").select(mention, "pid", "part")).groupBy(mention, "pid").agg(F.sum("part").alias("part")))
    # The least score of those wanted, if there are as many: nobody below it is among them.
    nth = F.row_number().over(Window.partitionBy(mention).orderBy(F.desc("part")))
    least = by_rare.withColumn("__n", nth).where(F.col("__n") == top).select(mention, F.col("part").alias("least"))
    settled = frequent.groupBy(mention).agg(F.sum("most").alias("bound")).join(least, mention, "left").select(mention, F.coalesce(F.col("least") > F.col("bound") + 1e-6, F.lit(False)).alias("settled"))
    frequent = frequent.join(settled, mention)
    of_found = frequent.where("settled").join(by_rare.select(mention, "pid"), mention).join(per_token.hint("merge"), ["token", "pid"]).select(mention, "pid", "part")
    lane = F.pmod(F.xxhash64(mention), F.lit(LANES)).cast("int").alias("lane")
    open_ones = frequent.where("NOT settled").select(mention, "token", lane)
    names = per_token.join(open_ones.select("token").distinct(), "token", "left_semi").withColumn("lane", F.explode(F.array(*map(F.lit, range(LANES)))))
    by_all = dealt(open_ones, "token", "lane").join(dealt(names, "token", "lane").hint("merge"), ["token", "lane"]).select(mention, "pid", "part")
    scored = by_rare.union(of_found).union(by_all).groupBy(mention, "pid").agg(F.sum("part").alias("raw"))
    plain = said.withColumn("__said", fold(F.col(mention))), persons.select(F.col("id").alias("pid"), fold(F.col("label")).alias("__label"))
    labelled = scored.join(plain[1], "pid").join(plain[0], mention).withColumn("whole", token_set_ratio("__said", "__label"))
    rank = F.row_number().over(Window.partitionBy(mention).orderBy(F.desc("raw"), F.desc("whole"), "pid"))
    return labelled.withColumn("rank", rank).where(F.col("rank") <= top).select(mention, "pid", F.round("raw", 2).alias("score"), "rank")


def name_similarity(pairs: DataFrame, persons: DataFrame, mention: str = "mention") -> DataFrame:
    """Adds similarity to rows (mention, pid): the best likeness of the mention, words of rank gone, to the person's names."""
    nothing = F.array().cast("array<string>")
    given = F.trim(F.substring_index(F.coalesce("subentry", F.lit("")), ",", 1))
    names = F.concat(F.array(F.concat_ws(" ", head_name(F.col("headword")), given), head_name(F.col("headword"))), F.coalesce("variants", nothing), F.coalesce("profile.mention_forms", nothing))
    known = persons.select(F.col("id").alias("pid"), F.explode(F.filter(names, lambda n: F.trim(n) != "")).alias("name")).distinct()
    plain = lambda c: F.when(without_titles(c) != "", without_titles(c)).otherwise(c)
    compared = pairs.select(mention, "pid").distinct().join(known, "pid").withColumn("s", token_set_ratio(fold(plain(F.col(mention))), fold(plain(F.col("name")))))
    return pairs.join(compared.groupBy(mention, "pid").agg(F.max("s").alias("similarity")), [mention, "pid"], "left")


def rendered(persons: DataFrame) -> DataFrame:
    """Rows (pid, card): a person as a short text for a judge; the numbers of spellings, aliases, places and examples are the card's own."""
    p = F.col("profile")
    nothing = F.array().cast("array<string>")
    spellings = F.slice(F.filter(F.concat(F.coalesce("variants", nothing), F.coalesce(p["mention_forms"], nothing)), lambda v: v != ""), 1, 8)
    lines = F.array(
        F.concat(F.lit("- id: "), F.col("id")),
        F.concat(F.lit("  label: "), F.col("label")),
        F.when(F.size(spellings) > 0, F.concat(F.lit("  spellings: "), F.array_join(spellings, ", "))),
        F.when(F.size("aliases") > 0, F.concat(F.lit("  aliases: "), F.array_join(F.slice("aliases", 1, 4), "; "))),
        F.concat(
            F.lit("  attested: "), p["date_min"], F.lit(" to "), p["date_max"], F.lit(", digests: "), F.size(p["digests"]).cast("string"), F.lit(", places: "),
            F.coalesce(F.nullif(F.array_join(F.slice(p["places"], 1, 6), ", "), F.lit("")), F.lit("-")),
        ),
        F.array_join(F.transform(F.slice(p["examples"], 1, 2), lambda e: F.concat(F.lit("  example ("), e["digest_id"], F.lit(", "), e["date"], F.lit("): "), F.left(e["text"], F.lit(220)))), "\n"),
    )
    return persons.select(F.col("id").alias("pid"), F.array_join(F.filter(lines, lambda x: x.isNotNull() & (x != "")), "\n").alias("card"))
