"""Cleaning and reading the answers of language models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of editorial intervention, and the elements their encoding may use.
INTERVENTION_TYPES = ["Abbreviation", "Correction", "Supplement", "Omission", "Uncertainty", "Redundant Text"]
INTERVENTION_TAGS = ["choice", "abbr", "expan", "sic", "corr", "supplied", "gap", "unclear", "surplus"]
#: The elements counted in a letter.
LETTER_TAGS = ["opener", "dateline", "salute", "p", "closer", "signed", "postscript", "address"]


def cleaned(raw: Column) -> Column:
    """Without thinking passages, and without a code fence around the whole answer."""
    text = F.regexp_replace(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""), r"(?U)^\s+|\s+$", "")
    fenced = r"(?s)^```[a-zA-Z]*\s*\n(.*?)\n```\s*$"
    return F.when(text.rlike(fenced), F.regexp_replace(F.regexp_extract(text, fenced, 1), r"(?U)^\s+|\s+$", "")).otherwise(text)


def braces(raw: Column) -> Column:
    """From the first ``{`` to the last ``}``; null without them. Not yet checked to be JSON."""
    return F.nullif(F.regexp_extract(cleaned(raw), r"(?s)\{.*\}", 0), F.lit(""))


def salvaged(raw: Column) -> Column:
    """VARIANT of the object or list that opens first in the answer; null where neither can be read."""
    text = cleaned(raw)
    brace, bracket = F.instr(text, "{"), F.instr(text, "[")
    as_object = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    as_list = F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit(""))
    object_first = (brace > 0) & ((bracket == 0) | (brace < bracket))
    return F.try_parse_json(F.when(object_first, as_object).otherwise(as_list))


def expanded_persons(raw: Column) -> Column:
    """array<string> of names from {"persons": [...]} or a bare list; empty without names."""
    v = salvaged(raw)
    names = F.coalesce(F.try_variant_get(v, "$.persons", "array<string>"), F.try_variant_get(v, "$", "array<string>"), F.array().cast("array<string>"))
    return F.filter(names, lambda n: n.isNotNull() & (F.trim(n) != ""))


def judgement(raw: Column, shortlist: Column) -> Column:
    """struct<decision, entity_ids, reason>: a one-element list is unwrapped, a single entity_id becomes a list, ids off the short list go, and a
    match without an id is unsure."""
    v = salvaged(raw)

    def get(path: str, kind: str) -> Column:
        return F.coalesce(F.try_variant_get(v, f"$.{path}", kind), F.try_variant_get(v, f"$[0].{path}", kind))

    single = get("entity_id", "string")
    ids = F.coalesce(get("entity_ids", "array<string>"), F.when(single.isNotNull(), F.array(single)), F.array().cast("array<string>"))
    known = F.filter(ids, lambda i: F.array_contains(shortlist, i))
    said = get("decision", "string")
    return F.struct(
        F.when(said.isNull(), "error").when((said == "match") & (F.size(known) == 0), "unsure").otherwise(said).alias("decision"), known.alias("entity_ids"), get("reason", "string").alias("reason")
    )


def well_formed(xml: Column) -> Column:
    """Whether a fragment is well-formed; errors are a false, never a failed query."""
    wrapped = F.concat(F.lit("<x>"), xml, F.lit("</x>"))
    bad = F.from_xml(wrapped, F.lit("_bad STRING, y STRING"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})["_bad"]
    return xml.isNotNull() & bad.isNull()


def tags(xml: Column) -> Column:
    """array<string> of the names of start tags, in order."""
    return F.regexp_extract_all(xml, F.lit(r"<([A-Za-z_][\w.-]*)"), F.lit(1))


def tags_allowed(xml: Column, allowed: list[str] = INTERVENTION_TAGS) -> Column:
    """Well-formed, all elements allowed, and none with an attribute."""
    plain = ~xml.rlike(r"<[A-Za-z_][\w.-]*\s+[A-Za-z_]")
    return well_formed(xml) & F.forall(tags(xml), lambda t: t.isin(*allowed)) & plain


def tag_counts(xml: Column, of: list[str] = LETTER_TAGS) -> Column:
    """``tag:n`` of the tags that occur, in the given order, joined by spaces; empty for what is not well-formed."""
    counted = lambda found: F.transform(F.lit(of), lambda t: F.concat(t, F.lit(":"), F.size(F.filter(found, lambda x: x == t)).cast("string")))
    # As the element of an array the tags are found once, not once for each that is counted.
    parts = F.element_at(F.transform(F.array(tags(xml)), counted), 1)
    return F.when(well_formed(xml), F.array_join(F.filter(parts, lambda p: ~p.endswith(":0")), " ")).otherwise("")


def attempt_status(answer: Column, finish_reason: Column) -> Column:
    """empty: ask again; truncated: ask with more room; ok."""
    return F.when(F.coalesce(F.trim(answer), F.lit("")) == "", "empty").when(finish_reason == "length", "truncated").otherwise("ok")
