"""Benchmark decontamination by winnowing.

Of every ``w`` consecutive k-gram hashes the least one (the rightmost on ties) is kept with its position. Two texts that
share t = w + k - 1 words keep the same one of them at the same place of the shared span, so a join of the kept
fingerprints misses no span of t words. A joined fingerprint is extended to the windows of t words round it: those whose digest (128 bits of
their words) is a window of an item are hits, whatever the hashes were. A fingerprint is looked up once, not once for each item that has it, and
a window names its items only after it is a hit; so a phrase that many items share costs a document no more than its own words and the items' names.

The guaranteed length t is the window: 13 words, or all words of a shorter benchmark item. Each length that occurs among
the items has its own level (k = min(K, t)); nearly all benchmarks have one level.

Where the benchmark's size is proven small its index is broadcast and one pass over the documents does everything, with no
shuffle. Beyond the bound, fingerprints and windows of documents are shuffled to those of the items; a list holds word numbers of one text or names of items, never texts.
Both ways give the same rows.

A null or empty text has no words and no hits. Repeated documents get a row each; items count by their id (a null
id reads "null"), whose windows are those of all its texts. Very long texts cost time in proportion to their words. Empty tables give no rows, or documents
without hits. Only the id and text columns are read; ``keep_clean`` and ``cut_passages`` keep all columns.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from hashlib import md5
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import checkpointed, filter_texts, map_texts, replace_texts
from quire.session import bounded_batches

WINDOW = 13
K = 7
#: The index is broadcast when the benchmark's texts have at most so many bytes.
BROADCAST_BYTES = 8 << 20
#: Share of hit words from which ``keep_clean`` drops a document; 0 drops all that hold a window.
SHARE = 0.05

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def words_of(utf8: bytes) -> list[bytes]:
    """Lower-cased words: runs of letters a-z, digits and bytes outside ASCII."""
    return utf8.translate(_LOWER).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint64, len(words)) + np.uint64(1)


def winnow(hashes: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and their word positions that guarantee every shared span of t words."""
    k = min(K, t)
    w, n = t - k + 1, len(hashes) - k + 1
    if len(hashes) < t:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams = grams * _BASE + hashes[j : j + n]
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(29)
    least, at = grams[: n - w + 1], np.arange(n - w + 1)
    for j in range(1, w):
        other = grams[j : j + n - w + 1]
        closer = other <= least
        at = np.where(closer, np.arange(j, j + n - w + 1), at)
        least = np.where(closer, other, least)
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    at = at[first]
    return grams[at], at


def level_of(n_words: int, window: int) -> int:
    return min(n_words, window)


def digest_of(window: list[bytes]) -> bytes:
    return md5(b" ".join(window)).digest()


def starts_round(places: Iterable[int], t: int, n: int) -> list[int]:
    """Starts of the windows of t words, in a text of n, that hold a k-gram at one of the places."""
    reach, found, last = t - min(K, t), [], -1
    for p in sorted(places):
        found += range(max(last + 1, p - reach, 0), min(p, n - t) + 1)
        last = max(last, min(p, n - t))
    return found


class Index:
    """Fingerprints and windows of benchmark items, by level."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        prints: dict[int, list[np.ndarray]] = defaultdict(list)
        names: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
        for name, utf8 in items:
            if words := words_of(utf8):
                t = level_of(len(words), window)
                prints[t].append(winnow(word_hashes(words), t)[0])
                for i in range(len(words) - t + 1):
                    names[t][digest_of(words[i : i + t])].add(name)
        self.levels = {}
        for t, parts in prints.items():
            own = np.unique(np.concatenate(parts))
            seen = np.zeros(1 << _BITS, bool)
            seen[own & np.uint64((1 << _BITS) - 1)] = True
            self.levels[t] = (own, seen, {d: frozenset(x) for d, x in names[t].items()})

    def hits(self, words: list[bytes]) -> tuple[bytearray, set[str]]:
        """A byte for each word, 1 where it is hit; and the names of the items."""
        hit, found, sets = bytearray(len(words)), set(), set()
        hashes = word_hashes(words)
        for t, (prints, seen, names) in self.levels.items():
            own, at = winnow(hashes, t)
            maybe = np.flatnonzero(seen[own & np.uint64((1 << _BITS) - 1)])
            if not len(maybe):
                continue
            maybe = maybe[np.isin(own[maybe], prints)]
            for start in starts_round(at[maybe].tolist(), t, len(words)):
                named = names.get(digest_of(words[start : start + t]))
                if named:
                    hit[start : start + t] = b"\x01" * t
                    sets.add(named)
        for named in sets:
            found |= named
        return hit, found


def runs(hit: bytearray) -> list[tuple[int, int]]:
    """(first word, end) of the runs of hit words."""
    return [m.span() for m in _RUN(hit)]


_RUN = re.compile(b"\x01+").finditer
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").finditer


def spans_of(text: str, hit: bytearray) -> list[tuple[int, int]]:
    """Code-point offsets of the runs of hit words, ends exclusive."""
    if not any(hit):
        return []
    at = [m.span() for m in _WORD(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in runs(hit)]


def _row(text: str, words: list[bytes], index: Index) -> tuple:
    hit, found = index.hits(words)
    n, items = hit.count(1), sorted(found)
    return len(words), n, len(items), items, [{"start": a, "end": b} for a, b in spans_of(text, hit)], n > 0 and 20 * n >= len(words)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FIELDS = [
    ("n_words", "long", pa.int64()), ("n_hit", "long", pa.int64()), ("n_items", "long", pa.int64()), ("items", "array<string>", pa.list_(pa.string())),
    ("spans", "array<struct<start:int,end:int>>", _SPANS), ("contaminated", "boolean", pa.bool_()),
]

_INDEX: dict = {}  # the last index that this Python worker has built, by its token


def _index_of(token: str, held, window: int) -> Index:
    if token not in _INDEX:
        _INDEX.clear()
        _INDEX[token] = Index(held.value, window)
    return _INDEX[token]


def _held(documents: DataFrame, items: DataFrame, window: int):
    """Gives the index, which each Python worker builds once from the broadcast items."""
    held = documents.sparkSession.sparkContext.broadcast([(r[0], r[1].encode("utf-8")) for r in items.collect()])  # at most broadcast_bytes
    token = uuid.uuid4().hex
    return lambda: _index_of(token, held, window)


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> tuple[DataFrame, int]:
    """The items (item, item_text) and a bound of their bytes."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("item_text"))
    return items, items.agg(F.sum(F.octet_length("item_text") + F.octet_length("item") + 64)).first()[0] or 0


def contamination(
    documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Rows (id, n_words, n_hit, n_items, items array<string>, spans, contaminated) of the documents.

    spans: code-point offsets of the runs of hit words. contaminated: at least a twentieth of the words are hit.
    """
    items, size = _items(benchmark, item_col, item_text_col)
    if size <= broadcast_bytes:
        index = _held(documents, items, window)
        return map_texts(documents, {id_col: F.col(id_col)}, F.col(text_col), lambda utf8, text: _row(text, words_of(utf8), index()), _FIELDS)
    texts = _keyed(documents, text_col).select("__key", F.col(f"__kept.`{id_col}`").alias("__id"))
    found = _shuffled(documents, items, text_col, window)
    return texts.join(found, "__key").select(F.col("__id").alias(id_col), *[f[0] for f in _FIELDS])


def keep_clean(
    documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES, share: float = SHARE,
) -> DataFrame:
    """The documents, with all their columns, without those where at least ``share`` of the words, and one in any case, are hit."""
    items, size = _items(benchmark, item_col, item_text_col)
    if size > broadcast_bytes:
        bad = _shuffled(documents, items, text_col, window).where((F.col("n_hit") > 0) & (F.col("n_hit") >= share * F.col("n_words"))).select("__key")
        return _keyed(documents, text_col).join(bad, "__key", "left_anti").select(*[F.col(f"__kept.`{c}`") for c in documents.columns])
    index = _held(documents, items, window)

    def clean(utf8: bytes, _: str) -> bool:
        hit, _ = index().hits(words_of(utf8))
        n = hit.count(1)
        return not n or n < share * len(hit)

    return filter_texts(documents, text_col, clean)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return "".join([*out, text[at:]])


def cut_passages(
    documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The documents, with all their columns, the runs of hit words cut from the texts. A null text stays null."""
    items, size = _items(benchmark, item_col, item_text_col)
    if size <= broadcast_bytes:
        index = _held(documents, items, window)
        return replace_texts(documents, text_col, lambda utf8, text: without_spans(text, spans_of(text, index().hits(words_of(utf8))[0])))
    text = F.col(f"__kept.`{text_col}`")
    found = _shuffled(documents, items, text_col, window).where("n_hit > 0").select("__key", "spans")
    # Where each piece between two spans starts: the spans are in order and apart.
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("spans")),
        lambda i: F.substring(text, F.coalesce(F.get("spans", i - 1)["end"], F.lit(0)) + 1, F.coalesce(F.get("spans", i)["start"], F.length(text)) - F.coalesce(F.get("spans", i - 1)["end"], F.lit(0))),
    )
    joined = _keyed(documents, text_col).join(found, "__key", "left")
    cut = F.when(F.col("spans").isNull(), text).otherwise(F.array_join(pieces, ""))
    return joined.select(*[(cut if c == text_col else F.col(f"__kept.`{c}`")).alias(c) for c in documents.columns])


def _keyed(documents: DataFrame, text_col: str) -> DataFrame:
    """(__key, __kept, the columns as one): the key is the text's digest, which takes equal documents together and tells repeated or missing ids apart."""
    key = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    return documents.select(key.alias("__key"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__kept"))


_PRINT = ("prints", "array<struct<level:int,print:long,at:int>>", pa.list_(pa.struct([("level", pa.int32()), ("print", pa.int64()), ("at", pa.int32())])))
_WINDOW = ("windows", "array<struct<level:int,at:int,digest:binary>>", pa.list_(pa.struct([("level", pa.int32()), ("at", pa.int32()), ("digest", pa.binary())])))


def _prints(words: list[bytes], levels: Iterable[int]) -> list[dict]:
    hashes, rows = word_hashes(words), []
    for t in levels:
        if len(words) >= t:
            prints, at = winnow(hashes, t)
            rows += [{"level": t, "print": h, "at": p} for h, p in zip(prints.view(np.int64).tolist(), at.tolist())]
    return rows


def _windows(words: list[bytes], starts: Iterator[tuple[int, int]]) -> list[dict]:
    return [{"level": t, "at": i, "digest": digest_of(words[i : i + t])} for t, i in starts]


def _shuffled(documents: DataFrame, items: DataFrame, text_col: str, window: int) -> DataFrame:
    """Rows (__key, *_FIELDS) of the distinct texts. Fingerprints meet distinct fingerprints, windows distinct windows; only hit windows meet names."""
    keyed = _keyed(documents, text_col).select("__key", F.coalesce(F.col(f"__kept.`{text_col}`"), F.lit("")).alias("__t"))
    texts = keyed.groupBy("__key").agg(F.min("__t").alias("__t"))

    def of_item(utf8: bytes, _: str) -> tuple:
        words = words_of(utf8)
        t = level_of(len(words), window)
        return (_prints(words, [t]), _windows(words, ((t, i) for i in range(len(words) - t + 1)))) if words else ([], [])

    bounded_batches(documents.sparkSession)
    index = checkpointed(map_texts(items.distinct(), {"item": F.col("item")}, F.col("item_text"), of_item, [_PRINT, _WINDOW]))
    held_prints = index.select(F.inline("prints")).select("level", "print").distinct()
    named = index.select("item", F.inline("windows")).select("level", "digest", "item").distinct()
    levels = sorted(r[0] for r in held_prints.select("level").distinct().collect())  # at most ``window`` numbers

    prints = map_texts(texts, {"__key": F.col("__key")}, F.col("__t"), lambda utf8, _: (_prints(words_of(utf8), levels),), [_PRINT]).select("__key", F.inline("prints"))
    # A list of places is bounded by its text's words.
    places = prints.join(held_prints, ["level", "print"], "left_semi").groupBy("__key").agg(F.collect_list(F.struct("level", "at")).alias("places"))
    near = texts.join(places, "__key").select("__key", "__t", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words, by_level = words_of(text.encode("utf-8")), defaultdict(list)
                for x in found:
                    by_level[x["level"]].append(x["at"])
                at = [m.span() for m in _WORD(text)]
                made = _windows(words, ((t, i) for t, p in by_level.items() for i in starts_round(p, t, len(words))))
                rows.append([w | {"start": at[w["at"]][0], "end": at[w["at"] + w["level"] - 1][1]} for w in made])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, placed)], names=["__key", "windows"])

    placed = pa.list_(pa.struct([("level", pa.int32()), ("at", pa.int32()), ("digest", pa.binary()), ("start", pa.int32()), ("end", pa.int32())]))
    windows = near.mapInArrow(run, "__key string, windows array<struct<level:int,at:int,digest:binary,start:int,`end`:int>>").select("__key", F.inline("windows"))
    hits = checkpointed(windows.join(named.select("level", "digest").distinct(), ["level", "digest"], "left_semi"))
    names = hits.select("__key", "level", "digest").distinct().join(named, ["level", "digest"]).select("__key", "item").distinct()
    names = names.groupBy("__key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    # Runs: a window that begins behind all ends so far opens one.
    before = Window.partitionBy("__key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.max(F.col("at") + F.col("level")).over(before), F.lit(-1))
    opened = hits.groupBy("__key", "at").agg(F.max("level").alias("level"), F.min("start").alias("start"), F.max("end").alias("end")).withColumn("__last", last)
    counted = opened.withColumn("__run", F.sum((F.col("at") > F.col("__last")).cast("int")).over(Window.partitionBy("__key").orderBy("at")))
    spans = counted.groupBy("__key", "__run").agg(F.min("at").alias("a"), F.max(F.col("at") + F.col("level")).alias("b"), F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("__key").agg(F.sum(F.col("b") - F.col("a")).cast("long").alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    sized = map_texts(texts, {"__key": F.col("__key")}, F.col("__t"), lambda utf8, _: (len(words_of(utf8)),), [("n_words", "long", pa.int64())])
    n_hit, items_ = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return sized.join(spans, "__key", "left").join(names, "__key", "left").select(
        "__key", "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), items_.alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def _oracle() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}')"
    return rf"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark), docs AS (SELECT doc_id, {words} AS w FROM documents),
sizes AS (SELECT DISTINCT least(len(w), {WINDOW}) AS m FROM items WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM (SELECT item, w, least(len(w), {WINDOW}) AS m, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM items WHERE len(w) > 0)
),
doc_windows AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, sizes WHERE len(w) >= m)
),
hits AS (SELECT doc_id, d.m, i, item FROM doc_windows d JOIN item_windows t ON d.m = t.m AND d.win = t.win),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM docs LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""


ORACLE = _oracle()
