"""Text functions: columns to columns, inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Glyphs of historical prints and what they are read as.
GLYPHS = [
    ("ﬁ", "fi"), ("ﬂ", "fl"), ("¬", "-"), ("¶", ""), ("˖", "+"), ("‟", '"'), ("⅙", "1/6"), ("ﬀ", "ff"), ("ꝓ", "ff"), ("ů", "u"),
    ("̃", ""), ("̈", ""), ("ﬄ", "ffl"), ("⸗", "-"), ("ꝛ", "r"), ("aͤ", "ä"), ("oͤ", "ö"), ("uͤ", "ü"),
]

WORD = r"(?U)\w+"


def normalize_glyphs(text: Column) -> Column:
    """Read historical glyphs as modern letters, in the order of GLYPHS; combining diaereses go before vowels with a small e are read."""
    for glyph, reading in GLYPHS:
        text = F.replace(text, F.lit(glyph), F.lit(reading))
    return text


def byte_length(text: Column) -> Column:
    """UTF-8 bytes plus one for the end mark; null and empty give 1."""
    return F.octet_length(F.coalesce(text, F.lit(""))) + 1


def words(text: Column) -> Column:
    """array<string> of runs of word characters of any script."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def squeeze(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def after_first_hash(uri: Column) -> Column:
    """What follows the first ``#``; the whole where there is none."""
    return F.when(F.instr(uri, "#") > 0, F.regexp_replace(uri, "(?s)^[^#]*#", "")).otherwise(uri)


def local_name(uri: Column) -> Column:
    """What follows the last ``#``, else the last ``/`` once closing slashes are gone."""
    bare = F.regexp_replace(uri, "/+$", "")
    return F.when(F.instr(uri, "#") > 0, F.substring_index(uri, "#", -1)).otherwise(F.substring_index(bare, "/", -1))


def short_uri(uri: Column) -> Column:
    """The local name; blank nodes (``_:id``) stay as they are."""
    return F.when(uri.startswith("_:"), uri).otherwise(local_name(uri))


def canonical_id(short: Column, root: Column) -> Column:
    """``E`` in place of the entry's own prefix. A plain prefix test: root T1 also rewrites T12."""
    return F.when((F.length(root) > 0) & short.startswith(root), F.concat(F.lit("E"), F.substring(short, F.length(root) + 1, F.length(short)))).otherwise(short)


def words_kept(source: Column, output: Column) -> Column:
    """Percentage (one decimal) of the source's words found in the output in order, each sought from where the last one was found."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("kept"))

    def step(acc: Column, word: Column) -> Column:
        rest = F.slice(output, acc["at"] + 1, F.greatest(F.size(output) - acc["at"], F.lit(0)))
        found = F.array_position(rest, word).cast("int")
        return F.when(found > 0, F.struct((acc["at"] + found).alias("at"), (acc["kept"] + 1).alias("kept"))).otherwise(acc)

    kept = F.aggregate(source, start, step, lambda acc: acc["kept"])
    return F.round(100.0 * kept / F.greatest(F.size(source), F.lit(1)), 1)


def url_kind(url: Column) -> Column:
    """``url`` for http and https, else ``other``."""
    return F.when(url.rlike("^https?://"), "url").otherwise("other")


def name_year(anno_id: Column) -> Column:
    """struct<short_title, year> of ids such as ``abc19050101``; nulls where the id is not of that form."""
    get = lambda g: F.nullif(F.regexp_extract(anno_id, r"^([a-zA-Z]+)(\d{4})", g), F.lit(""))
    return F.struct(get(1).alias("short_title"), get(2).alias("year"))


def path_parts(path: Column) -> Column:
    """struct<newspaper, year, page> from .../newspaper/year/page.ext."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return F.struct(F.try_element_at(parts, F.lit(-3)).alias("newspaper"), F.try_element_at(parts, F.lit(-2)).alias("year"), stem.alias("page"))


def mirrored(path: Column, source_root: str, target_root: str) -> Column:
    """The path below another root; files outside the source root go directly below it."""
    root = source_root.rstrip("/") + "/"
    inside = F.substring(path, len(root) + 1, 1_000_000)
    return F.concat(F.lit(target_root.rstrip("/") + "/"), F.when(path.startswith(root), inside).otherwise(F.substring_index(path, "/", -1)))


def image_name(path: Column) -> Column:
    """The name of a page's XML or enhanced image as that of its picture: no ``_enhanced``, .jpg as .png."""
    return F.regexp_replace(F.regexp_replace(path, "_enhanced", ""), r"\.jpg$", ".png")


def day_first_date(text: Column) -> Column:
    """DATE of a day-first date such as 3.11.1905, 03/11/1905 or 3-11-1905; null where it is none."""
    plain = F.regexp_replace(F.trim(text), r"[/-]", ".")
    return F.to_date(F.try_to_timestamp(plain, F.lit("d.M.yyyy")))


def middots(text: Column) -> Column:
    """Words joined by middle dots."""
    return F.regexp_replace(F.trim(text), r"(?U)\s+", "·")


def request_key(*parts: Column) -> Column:
    """sha256 of the parts as JSON with sorted names p0, p1, ...; equal requests get equal keys."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def safe_name(name: Column) -> Column:
    """A name for files: slashes, colons and blanks become underscores."""
    return F.translate(name, "/\\: ", "____")


def retry_after(header: Column, default: float = 5.0) -> Column:
    """Seconds of a Retry-After header; the default where it is no number."""
    return F.coalesce(header.try_cast("double"), F.lit(default))


def backoff(attempt: Column, base: float = 2.0, most: float = 60.0) -> Column:
    """Seconds to wait before the given attempt, doubling up to a bound."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


def prompt(*parts: Column) -> Column:
    """Stripped parts that are not empty, joined by a blank line."""
    return F.array_join(F.filter(F.array(*[F.trim(p) for p in parts]), lambda p: (p.isNotNull()) & (p != "")), "\n\n")


def listed(items: Column) -> Column:
    """One item as it is; several as a dashed list."""
    return F.when(F.size(items) == 1, items[0]).otherwise(F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i)), "\n"))


def is_local_model(name: Column) -> Column:
    """Whether a model's name starts like one that is run in house."""
    return F.lower(name).rlike("^(qwen|glm|gemma|kimi)")


def types_in_list(types: Column, allowed: list[str]) -> Column:
    """Whether all of the ``;``-separated types are allowed; null counts as an empty type."""
    return F.forall(F.split(F.coalesce(types, F.lit("")), ";"), lambda t: F.trim(t).isin(*allowed))


def report_parts(name: Column) -> Column:
    """struct<dataset, model> of report files such as L343_model.html; nulls for other names."""
    get = lambda g: F.nullif(F.regexp_extract(name, r"(?i)^(L\d+)_(.+)\.html$", g), F.lit(""))
    return F.struct(get(1).alias("dataset"), get(2).alias("model"))


def in_batch(ordinal: Column, batch_range: str) -> Column:
    """Rows of ``a-b``, counted from 0, the end excluded."""
    a, b = (int(x) for x in batch_range.split("-"))
    return (ordinal >= a) & (ordinal < b)
