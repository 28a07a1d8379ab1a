"""Personal data: fixed formats, and bootstrapped contextual extraction. DataFrame functions only.

Base spans have fixed formats (e-mail, IP, card, phone). Their values, and long mixed hexadecimal strings, seed the bootstrap. A
candidate is an identifier-like value with the lexical pattern to its left: a name with its separator (``token = "``), or the
two words before it. Patterns and the distinct values they hold form a graph. A round scores each pattern by the share of its
values that are known as one kind, weighing values found so far by their best pattern; patterns with enough distinct known values and a high
share are accepted and keep their kind, and the values they hold are known in the next round, until no pattern is added and no score rises. The candidates that accepted patterns hold are
spans of the pattern's kind, seen before or not, unless a base span lies there.

All formats are written so that a failed place is not tried again from within (possessive runs, starts at the edge of a run). Places come from
running sums over the matches, overlaps from running extremes over sorted spans, both made in blocks, and texts are cut by chunks; so a text of many
matches costs little more than time in proportion to its length. Offsets are code points, ends exclusive.

Null and empty texts have no spans. Repeated documents count once as evidence (values are distinct) and get a row each. Rows are told
apart by a number of their own, so ids may be null or repeat. Other columns are not read by ``detect`` and are kept by ``redact``.
Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import checkpointed

BASE_KINDS = ("email", "ip", "card", "phone")
_FORMATS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Text that must be there for a format to match; saves the pattern on most texts.
_NEEDS = {"email": "@", "phone": "+"}
#: A name and its separator before a value; and a token with a digit.
_NAMED = r"(?<![A-Za-z0-9_])[A-Za-z_]{2,}+ ?[=:] ?[\"']?[^\s\"'=:;,<>()|]{4,}+"
_TOKEN = r"(?<!\S)(?=[^\s0-9]*+[0-9])\S{5,}+"
_SECRET = r"(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{16,64}"
#: Distinct known values a pattern needs, and their share.
SUPPORT, CONFIDENCE = 3, 0.7
#: Rounds go on until no score rises by more than this.
SETTLED = 0.01
#: Accepted patterns up to this number are kept in the plan as a constant when texts are redacted.
INLINE_PATTERNS = 2_000


#: Running values are made within blocks of so many elements, as an array grows by copying it; a text is cut by chunks of so many code points.
BLOCK, CHUNK = 128, 1024


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value bound, so that it is made once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running values of ``op(value so far, or null, and the next)``, associative, over an array."""

    def folded(array: Column) -> Column:
        first = F.slice(array, 1, 1)
        return F.aggregate(F.slice(array, 2, F.greatest(F.size(array) - 1, F.lit(0))), first, lambda acc, x: F.concat(acc, F.array(op(F.get(acc, F.size(acc) - 1), x))))

    def joined(blocks: Column) -> Column:
        return _let(
            F.struct(blocks.alias("of"), folded(F.transform(blocks, lambda x: F.get(x, F.size(x) - 1))).alias("upto")),
            lambda s: F.flatten(F.transform(s["of"], lambda x, b: F.when(b == 0, x).otherwise(F.transform(x, lambda v: op(F.get(s["upto"], b - 1), v))))),
        )

    def whole(array: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(array), F.lit(BLOCK))
        return F.when(F.size(array) <= BLOCK, folded(array)).otherwise(_let(F.transform(starts, lambda at: folded(F.slice(array, at, BLOCK))), joined))

    return _let(values, lambda array: F.when(F.size(array) > 0, whole(array)).otherwise(array))


def _sum(so_far: Column, x: Column) -> Column:
    return F.coalesce(so_far, F.lit(0)) + x


def _found(text: Column, pattern: str, need: str | None) -> Column:
    """array<struct<start, value, gap>>: the non-overlapping matches, where they start, and the stretch of text before each."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if need:
        matches = F.when(text.contains(need), matches).otherwise(F.array().cast("array<string>"))

    def placed(s: Column) -> Column:
        steps = F.transform(s["found"], lambda x, i: F.length(s["pieces"][i]) + F.coalesce(F.length(F.get(s["found"], i - 1)), F.lit(0)))
        made = _let(F.struct(_running(steps, _sum).alias("starts"), s["found"].alias("found"), s["pieces"].alias("pieces")), _zipped)
        return F.when(F.size(s["found"]) > 0, made).otherwise(F.array().cast("array<struct<start:int,value:string,gap:string>>"))

    pieces = lambda m: F.when(F.size(m) > 0, F.split(text, pattern, -1))
    return _let(matches, lambda m: _let(F.struct(m.alias("found"), pieces(m).alias("pieces")), placed))


def _zipped(s: Column) -> Column:
    return F.transform(s["found"], lambda x, i: F.struct(s["starts"][i].alias("start"), x.alias("value"), s["pieces"][i].alias("gap")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.coalesce(part(x).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(n.between(16, 19), F.call_function("luhn_check", _digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


_SPAN = "struct<kind:string,start:int,end:int>"
_CANDIDATE = "struct<named:boolean,pattern:string,value:string,start:int,end:int,seed:string>"


def _seed(value: Column) -> Column:
    kind = F.when(value.rlike(f"^(?:{_SECRET})$"), "secret")
    for k in BASE_KINDS:
        kind = kind.when(value.rlike(f"^(?:{_FORMATS[k]})$") & _valid(k, value), k)
    return kind


def _trimmed(value: Column) -> Column:
    """Without closing punctuation and symbols."""
    return F.regexp_replace(value, r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", "")


def _base_spans(kind: str) -> Column:
    held = F.filter(f"__f_{kind}", lambda x: _valid(kind, x["value"]))
    return F.transform(held, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["value"])).cast("int").alias("end")))


def _named_candidate(m: Column) -> Column:
    cue = F.regexp_extract(m["value"], r"^[A-Za-z_]+ ?[=:] ?[\"']?", 0)
    value = _trimmed(F.substring(m["value"], F.length(cue) + 1, F.length(m["value"])))
    return _candidate(True, F.lower(cue), value, m["start"] + F.length(cue))


def _worded_candidate(m: Column) -> Column:
    lead = F.regexp_extract(m["value"], r"^[^\p{L}\p{N}+]*", 0)
    value = _trimmed(F.substring(m["value"], F.length(lead) + 1, F.length(m["value"])))
    # The two words before, at the end of the text's stretch between two candidates: it is cut at the third space from its end.
    cue = F.lower(F.regexp_extract(F.substring_index(m["gap"], " ", -3), r"(?<!\S)(\S++ \S++) $", 1))
    return _candidate(False, cue, value, m["start"] + F.length(lead))


def extract(df: DataFrame, text: Column) -> DataFrame:
    """Adds base: array of spans by kind and start; candidates: array of candidates by their start."""
    out = df.withColumn("__text", F.coalesce(text, F.lit("")))
    patterns = _FORMATS | {"named": _NAMED, "token": _TOKEN}
    out = out.withColumns({f"__f_{name}": _found(F.col("__text"), pattern, _NEEDS.get(name)) for name, pattern in patterns.items()})
    out = out.withColumn("base", F.concat(*map(_base_spans, BASE_KINDS)).cast(f"array<{_SPAN}>"))
    both = F.concat(F.transform("__f_named", _named_candidate), F.transform("__f_token", _worded_candidate))
    usable = F.filter(both, lambda c: (F.length(c["pattern"]) > 0) & (F.length(c["value"]) >= 4))
    seeded = F.transform(
        usable, lambda c: F.struct(c["named"].alias("named"), c["pattern"].alias("pattern"), c["value"].alias("value"), c["start"].alias("start"), c["end"].alias("end"), _seed(c["value"]).alias("seed"))
    )
    out = out.withColumn("candidates", seeded.cast(f"array<{_CANDIDATE}>"))
    return out.drop("__text", *[f"__f_{name}" for name in patterns])


def _candidate(named: bool, pattern: Column, value: Column, start: Column) -> Column:
    return F.struct(F.lit(named).alias("named"), pattern.alias("pattern"), value.alias("value"), start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("end"))


def accepted_patterns(candidates: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int | None = None) -> DataFrame:
    """Rows (pattern, kind, score) from candidates (pattern, value, seed): one kind for each accepted pattern.

    rounds: at most so many; by default until nothing changes.
    """
    edges = checkpointed(candidates.groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = edges.where("seed IS NOT NULL").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("known")).distinct()
    known = seeds
    accepted = candidates.sparkSession.createDataFrame([], "pattern string, kind string, score double")
    done = 0
    while rounds is None or done < rounds:
        # Seeds and values found in earlier rounds both support a pattern; edges and known are distinct.
        mass = edges.join(known, "value").groupBy("pattern", "kind").agg(F.sum("known").alias("mass"), F.count("*").alias("support")).where(F.col("support") >= support)
        held = accepted.select("pattern", F.col("kind").alias("held"), F.col("score").alias("before"))
        scored = mass.join(sizes, "pattern").join(held, "pattern", "left").withColumn("score", F.greatest(F.col("mass") / F.col("n"), F.coalesce("before", F.lit(0.0))))
        scored = scored.where((F.col("score") >= confidence) & (F.col("held").isNull() | (F.col("held") == F.col("kind"))))
        # One kind has the majority of a pattern's values, as the share must pass a half.
        best = scored.groupBy("pattern").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score"), F.max(F.coalesce("before", F.lit(0.0))).alias("before"))
        best = checkpointed(best)
        accepted = best.drop("before")
        done += 1
        # A new pattern's score rises from nothing.
        if (best.agg(F.max(F.col("score") - F.col("before"))).first()[0] or 0.0) <= SETTLED:
            break
        found = edges.where("seed IS NULL").join(accepted, "pattern").select("value", "kind", F.col("score").alias("known"))
        known = seeds.union(found).groupBy("value", "kind").agg(F.max("known").alias("known"))
    return accepted


def _clear_of(spans: Column, blockers: Column) -> Column:
    """The spans (array<struct<kind, start, end>>) that overlap no blocker. Sorted by start, a span must lie behind all ends so far and before the next start."""

    def judged(all_: Column) -> Column:
        ends = _running(F.transform(all_, lambda x: F.when(~x["own"], x["end"])), F.greatest)
        starts = F.reverse(_running(F.reverse(F.transform(all_, lambda x: F.when(~x["own"], x["start"]))), F.least))
        bound = F.struct(all_.alias("all"), ends.alias("ends"), starts.alias("starts"))
        free = lambda s, x, i: x["own"] & F.coalesce(s["ends"][i] <= x["start"], F.lit(True)) & F.coalesce(s["starts"][i] >= x["end"], F.lit(True))
        return _let(bound, lambda s: F.transform(F.filter(s["all"], lambda x, i: free(s, x, i)), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))

    marked = lambda array, own: F.transform(array, lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"), x["kind"].alias("kind")))
    merged = F.array_sort(F.concat(marked(blockers, False), marked(spans, True)))
    return F.when((F.size(spans) > 0) & (F.size(blockers) > 0), _let(merged, judged)).otherwise(spans)


def all_spans(base: Column, found: Column) -> Column:
    """Base spans and the found ones clear of them (array<struct<named, start, end, kind>>), sorted by kind as listed and start.

    Found spans come from two patterns whose matches do not overlap among themselves; of a span after a name and one after two words that overlap, the first goes.
    """
    of = lambda named: F.transform(F.filter(found, lambda c: c["named"] == F.lit(named)), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))).cast(f"array<{_SPAN}>")
    rank = lambda kind: F.coalesce(F.nullif(F.array_position(F.lit(list(BASE_KINDS)), kind), F.lit(0)), F.lit(99))

    def sorted_(spans: Column) -> Column:
        sortable = F.transform(spans, lambda s: F.struct(rank(s["kind"]).alias("rank"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        return F.transform(F.array_sort(sortable), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    with_named = F.concat(base, _clear_of(of(True), base))
    made = _let(with_named, lambda held: sorted_(F.concat(held, _clear_of(of(False), held))))
    return F.when(F.size(found) > 0, made).otherwise(sorted_(base)).cast(f"array<{_SPAN}>")


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, base, spans): arrays of spans (kind, start, end); spans has base and the discovered ones."""
    rows = df.select(F.col(id_col), F.col(text_col).alias("__source"), F.monotonically_increasing_id().alias("__row"))
    # One pass over the texts; what is kept of them is small.
    rows = checkpointed(extract(rows, F.col("__source")).drop("__source"))
    candidates = rows.where(F.size("candidates") > 0).select("__row", F.inline("candidates"))
    accepted = accepted_patterns(candidates).select("pattern", "kind")
    found = candidates.join(accepted, "pattern").groupBy("__row").agg(F.collect_list(F.struct("named", "start", "end", "kind")).alias("found"))
    found = found.select("__row", "found")
    none = F.array().cast("array<struct<named:boolean,start:int,end:int,kind:string>>")
    joined = rows.join(found, "__row", "left")
    return joined.select(id_col, "base", all_spans(F.col("base"), F.coalesce("found", none)).alias("spans"))


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """The text between two places, from its chunks."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
    one = F.substring(F.get(chunks, first), start % CHUNK + 1, end - start)
    more = F.concat(
        F.substring(F.get(chunks, first), start % CHUNK + 1, F.lit(CHUNK)),
        F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
        F.coalesce(F.substring(F.get(chunks, last), F.lit(1), end % CHUNK), F.lit("")),
    )
    return F.when(start >= end, F.lit("")).when(first == last, one).otherwise(more)


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced from the first one's start on."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def made(s: Column) -> Column:
        # Ends of all spans so far; a span that begins before them lies in one that is replaced already.
        upto = lambda i: F.coalesce(F.get(s["upto"], i - 1), F.lit(0))
        piece = lambda x, i: F.concat(_cut(s["chunks"], upto(i), x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        pieces = F.transform(s["spans"], lambda x, i: F.when(x["start"] < upto(i), F.lit("")).otherwise(piece(x, i)))
        return F.concat(F.array_join(pieces, ""), _cut(s["chunks"], upto(F.size(s["spans"])), F.length(text)))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    bound = _let(ordered, lambda o: _let(F.struct(o.alias("spans"), _running(F.transform(o, lambda x: x["end"]), F.greatest).alias("upto"), chunks.alias("chunks")), made))
    return F.when(F.size(spans) > 0, bound).otherwise(text)


def redact(df: DataFrame, text_col: str = "text", inline_patterns: int = INLINE_PATTERNS) -> DataFrame:
    """The rows with all their columns, spans in the text replaced.

    The accepted patterns come from one pass over all texts. Up to ``inline_patterns`` of them become a constant of the second pass, which then
    needs no shuffle; beyond, spans are joined to the rows.
    """
    # Kept as a table before it is filtered: a filter would be pushed below, and the extraction evaluated once more for it.
    evidence = checkpointed(extract(df.select(F.col(text_col).alias("__source")), F.col("__source")).select("candidates"))
    accepted = accepted_patterns(evidence.where(F.size("candidates") > 0).select(F.inline("candidates"))).select("pattern", "kind")
    few = accepted.limit(inline_patterns + 1).collect()
    none = F.array().cast("array<struct<named:boolean,start:int,end:int,kind:string>>")
    held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__kept"), F.col(text_col).alias("__source"))
    if len(few) > inline_patterns:
        rows = checkpointed(extract(held.withColumn("__row", F.monotonically_increasing_id()), F.col("__source")))
        found = rows.select("__row", F.inline("candidates")).join(accepted, "pattern").groupBy("__row").agg(F.collect_list(F.struct("named", "start", "end", "kind")).alias("found"))
        rows = rows.join(found, "__row", "left").withColumn("found", F.coalesce("found", none))
    else:
        rows = extract(held, F.col("__source"))
        if few:
            kinds = F.create_map(*[F.lit(x) for r in few for x in (r["pattern"], r["kind"])])
            hits = F.filter("candidates", lambda c: F.map_contains_key(kinds, c["pattern"]))
            rows = rows.withColumn("found", F.transform(hits, lambda c: F.struct(c["named"].alias("named"), c["start"].alias("start"), c["end"].alias("end"), kinds[c["pattern"]].alias("kind"))))
        else:
            rows = rows.withColumn("found", none)
    rows = rows.withColumn("spans", all_spans(F.col("base"), F.col("found")))
    source = F.col("__source")
    return rows.select(*[(redacted(source, F.col("spans")) if c == text_col else F.col("__kept")[c]).alias(c) for c in df.columns])
