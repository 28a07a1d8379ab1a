"""SimHash near-duplicates with pigeonring filtering.

A document's fingerprint has bit b set where more than half of its shingle hashes have it. Two fingerprints link when at
most four bits differ. Cut into five segments on a ring, two linked fingerprints have a segment from which every chain of l
consecutive segments differs in at most l * 4 / 5 bits: 0, 1, 2, 3 and 4 for l = 1 to 5. Candidates agree on such a first
segment (the join key), must keep within the budget of each longer chain, and only then meet the full Hamming check.

Equal fingerprints are folded first, so copies cost one row. How many distinct fingerprints a group of near copies can have within
a few bits is bounded by their number of places, not by the group's size. Fingerprints one bit flip from a common
value link by themselves, so these are joined through that value first (one row for each flip, no pairs); the ring join then only
keeps pairs that are not yet connected.

``keep_one`` also links texts by the exact Jaccard similarity of their shingles, as four bits are far tighter than a similarity of 0.8: see there.

Null and empty texts have fingerprint zero and link as any other. Ties of a bit count as unset. Repeated rows are copies. The
component is named by its smallest id; null ids count only if a component has no other. Very long texts are hashed in blocks. Ids are read as they are, other columns are
not read and ``keep_one`` keeps them. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import checkpointed, map_texts, sliced, written
from quire.llm.components import components
from quire.session import bounded_batches

SHINGLE, SEED, BITS = 4, 42, 4
#: (shift, width) of the five segments.
SEGMENTS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
_BLOCK = 1 << 14
#: Links by Jaccard similarity: bands of least values, values of a band, and differing bits that a pair may have.
BANDS, BAND_ROWS, LOOSE_BITS = 20, 6, 20
#: Buckets of at most so many texts are compared pair by pair.
SMALL = 32
_SEEDS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), np.uint64)
_XOR, _ODD = _SEEDS[0], 2 * _SEEDS[1] + 1

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def shingle_hashes(utf8: bytes, k: int = SHINGLE) -> list[int]:
    """XXH64 of every k consecutive lower-cased words, joined by a space, repeats included."""
    words = utf8.lower().split()
    joined = b" ".join(words)
    if len(words) <= k:
        return [_hash(joined)] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-k])).tolist()
    return [_hash(joined[a:b]) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())]


def fingerprint(hashes: list[int]) -> int:
    """Signed 64-bit fingerprint: bits set in more than half of the hashes."""
    if not hashes:
        return 0
    ones = np.zeros(64, np.int64)
    array = np.array(hashes, ">u8")
    for i in range(0, len(array), _BLOCK):
        ones += np.unpackbits(array[i : i + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp long)."""
    return map_texts(df, {id_col: F.col(id_col)}, F.col(text_col), lambda utf8, _: (fingerprint(shingle_hashes(utf8)),), [("fp", "long", pa.int64())])


def _mask(i: int, length: int) -> int:
    """Bits of ``length`` segments of the ring from i on, as a signed 64-bit number."""
    bits = 0
    for s in range(i, i + length):
        shift, width = SEGMENTS[s % len(SEGMENTS)]
        bits |= ((1 << width) - 1) << shift
    return bits - (1 << 64) if bits >> 63 else bits


def _segment(fp: Column, i: int) -> Column:
    shift, width = SEGMENTS[i % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _keys(fp: Column, segments: int, near: bool) -> Column:
    """array<struct<start, key>>: the first ``segments`` segments of each chain; near: also with one bit of the second one flipped."""
    keys = []
    for i, _ in enumerate(SEGMENTS):
        key = _segment(fp, i)
        if segments == 2:
            second = _segment(fp, i + 1)
            flips = [0, *(1 << b for b in range(SEGMENTS[(i + 1) % len(SEGMENTS)][1]))] if near else [0]
            keys += [F.struct(F.lit(i).alias("start"), (F.shiftleft(key, 13) + second.bitwiseXOR(F.lit(f))).alias("key")) for f in flips]
        else:
            keys.append(F.struct(F.lit(i).alias("start"), key.alias("key")))
    return F.array(*keys)


def _within(differ: Column, start: Column) -> Column:
    """Chains from ``start`` keep within their budgets, then the full check."""
    chains = F.lit(False)
    for i, _ in enumerate(SEGMENTS):
        fits = F.lit(True)
        for length in range(2, len(SEGMENTS)):
            fits = fits & (F.bit_count(differ.bitwiseAND(F.lit(_mask(i, length)))) <= length * BITS // len(SEGMENTS))
        chains = F.when(start == i, fits).otherwise(chains)
    return chains & (F.bit_count(differ) <= BITS)


def links(distinct: DataFrame, key_segments: int | None = None) -> DataFrame:
    """Links (u, v), u < v, between fingerprints of column fp that differ in at most four bits.

    distinct: fp and optionally group; pairs within one group are left out. key_segments: segments in the join key, 1 or 2; by
    default the one that costs less. Both give the same links, each up to five times.
    """
    grouped = distinct if "group" in distinct.columns else distinct.withColumn("group", F.col("fp"))
    if key_segments is None:
        n = distinct.count()
        key_segments = 1 if n * n * 5 / 2 / (1 << 13) < 300 * 75 * n else 2
    a = grouped.select(F.col("fp").alias("u"), F.col("group").alias("gu"), F.inline(_keys(F.col("fp"), key_segments, False)))
    b = grouped.select(F.col("fp").alias("v"), F.col("group").alias("gv"), F.inline(_keys(F.col("fp"), key_segments, True)))
    b = b.withColumnsRenamed({"start": "start_b", "key": "key_b"})
    differ = F.col("u").bitwiseXOR(F.col("v"))
    on = (F.col("start") == F.col("start_b")) & (F.col("key") == F.col("key_b")) & (F.col("u") < F.col("v")) & (F.col("gu") != F.col("gv")) & _within(differ, F.col("start"))
    return a.join(b, on).select("u", "v")


def flip_links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) of fingerprints that are at most one flip from a common value, hence two bits apart: each to the least of them."""
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)])
    near = distinct.select("fp", F.explode(flips).alias("value"))
    least = near.groupBy("value").agg(F.min("fp").alias("u"), F.max("fp").alias("top")).where("u < top").select("value", "u")
    return near.join(least, "value").where("fp > u").select("u", F.col("fp").alias("v")).distinct()


def _grouped(only: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, rep, group): the least fingerprint that edges reach."""
    roots = components(edges)
    return checkpointed(only.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("group")))


def _labelled(prints: DataFrame, rep: Column, more: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(fp, rep, root) of the distinct fingerprints and (root, name) of their components; rep: an aggregate over the rows of a fingerprint, name: the least one of a component.

    more: gives further edges between fingerprints from (distinct fingerprints, edges so far).
    """
    only = checkpointed(prints.groupBy("fp").agg(rep.alias("rep")))
    grouped = _grouped(only, flip_links(only.select("fp")))
    within = grouped.where("fp != group").select(F.col("group").alias("u"), F.col("fp").alias("v"))
    edges = links(grouped.select("fp", "group")).union(within)
    if more is not None:
        edges = checkpointed(edges.distinct())
        edges = edges.union(more(only, edges))
    # A table of its own, so that both sides of the join are dealt anew and a root with many fingerprints can be split.
    labelled = _grouped(only, edges).withColumnRenamed("group", "root")
    return labelled, checkpointed(labelled.groupBy("root").agg(F.min("rep").alias("name")))


def bands(hashes: list[int]) -> tuple[int, list[int]]:
    """(number of distinct hashes, a signed 64-bit key of each band of least values); no hashes: no keys."""
    if not hashes:
        return 0, []
    array = np.unique(np.array(hashes, np.uint64))
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(array), _BLOCK >> 3):
        mixed = (array[i : i + (_BLOCK >> 3), None] ^ _XOR) * _ODD
        np.minimum(least, mixed.min(axis=0), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    keys = np.array([xxhash.xxh64_intdigest(row.tobytes(), seed=band) for band, row in enumerate(rows)], np.uint64)
    return len(array), keys.view(np.int64).tolist()


def _could_link(a: str, b: str, similarity: float) -> Column:
    """What pairs of that similarity meet: set sizes in proportion (always), fingerprints within LOOSE_BITS (but for about one in ten thousand at 0.8)."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (small >= F.lit(similarity) * large) & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= LOOSE_BITS)


def _beside(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs with text_u and text_v, those of one key_u mostly in runs."""
    bounded_batches(pairs.sparkSession)
    second = texts.select(F.col("key").alias("key_v"), F.col("text").alias("text_v"))
    first = texts.select(F.col("key").alias("key_u"), F.col("text").alias("text_u"))
    # Pairs are small rows and their comparison is not: dealt over all cores by a number that adaptive execution leaves alone.
    dealt = pairs.repartition(2 * pairs.sparkSession.sparkContext.defaultParallelism, "key_v").sortWithinPartitions("key_u")
    return dealt.join(second, "key_v").join(first, "key_u")


def _compared(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[frozenset[int], set[int]]]]]:
    """Batches of (key_u, text_u, text_v, ...) with the shingle sets of both texts of each row."""
    last, known = None, frozenset()
    for batch in sliced(batches):
        sets = []
        for key, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if key != last:
                last, known = key, frozenset(shingle_hashes(a.encode("utf-8"), k))
            sets.append((known, set(shingle_hashes(b.encode("utf-8"), k))))
        yield batch, sets


def _similar(a: frozenset[int], b: set[int], similarity: float) -> bool:
    shared = len(a & b)
    return shared >= similarity * (len(a) + len(b) - shared)


def _alike(pairs: DataFrame, texts: DataFrame, similarity: float, k: int) -> DataFrame:
    """Edges (u, v) of the pairs (u, v, key_u, key_v) whose shingle sets have at least that Jaccard similarity, counted exactly."""
    both = _beside(pairs, texts).select("key_u", "text_u", "text_v", "u", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _compared(batches, k):
            yield batch.select([3, 4]).filter(pa.array([_similar(a, b, similarity) for a, b in sets], pa.bool_()))

    return checkpointed(both.mapInArrow(run, "u long, v long").distinct())


def _differences(placed: DataFrame, texts: DataFrame, similarity: float, k: int) -> DataFrame:
    """The rows (key_u, u, n_u, key_v, v, n, now) with alike, whether the two texts are that similar, and differ, the hashes that only one of them has."""
    columns = ["key_u", "u", "n_u", "key_v", "v", "n", "now"]
    both = _beside(placed, texts).select("key_u", "text_u", "text_v", *columns[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _compared(batches, k):
            alike = pa.array([_similar(a, b, similarity) for a, b in sets], pa.bool_())
            differ = pa.array([np.fromiter(a ^ b, np.uint64, len(a ^ b)).view(np.int64) for a, b in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[3:], alike, differ], names=[*columns, "alike", "differ"])

    ddl = ", ".join(f"{c} {placed.schema[c].dataType.simpleString()}" for c in columns)
    return written(both.mapInArrow(run, f"{ddl}, alike boolean, differ array<bigint>"))


def sharing(placed: DataFrame, similarity: float) -> DataFrame:
    """Pairs (key_u, key_v, u, v, once each) of rows of ``_differences`` under one centre that may be that similar and are in different components: all that are, and few others.

    What two texts x and y do not share is what their differences from the centre do not share. With c = (1 - similarity) / (1 + similarity), n a set's
    size, d that of its difference from the centre and e = d - c n, they are similar where their differences share t = (e_x + e_y) / 2 hashes or more.
    Let e_x <= e_y. Not both are similar to the centre (they would be in one component), so e_y > c n_centre and t exceeds e_x and (e_x + c n_centre) / 2;
    as the shared are at most d_x, and n_x at most n_y / similarity, t is also at least e_y - c n_y / similarity, and at least (e_y - c n_centre) / 2. So
    the rarest d - t + 1 hashes of both have one in common, after which as many must be left as the pair's own t asks for. Near copies
    that were changed at places of their own differ by hashes of their own, which meet nothing.
    """
    c = (1 - similarity) / (1 + similarity)
    apart = placed.select("key_u", "n_u", "key_v", "v", "n", "now", F.explode("differ").alias("hash"))
    rare = apart.groupBy("key_u", "hash").agg(F.count("*").alias("held"))
    ordered = apart.join(rare, ["key_u", "hash"]).groupBy("key_u", "key_v").agg(
        *(F.first(x).alias(x) for x in ("n_u", "v", "n", "now")), F.sort_array(F.collect_list(F.struct("held", "hash"))).alias("differ")
    )
    e, centre = F.col("e"), F.lit(c) * F.col("n_u")

    def kept(least: Column) -> Column:
        return F.col("d") - F.greatest(F.lit(1), F.ceil(least - 1e-6)) + 1

    sized = ordered.withColumn("d", F.size("differ")).withColumn("e", F.col("d") - F.lit(c) * F.col("n"))
    sized = sized.withColumn("as_less", kept(F.greatest(e, (e + centre) / 2)))
    sized = sized.withColumn("as_more", F.when(e > centre - 1e-6, kept(F.greatest(e - F.lit(c / similarity) * F.col("n"), (e - centre) / 2))).otherwise(0))
    first = F.slice("differ", 1, F.greatest("as_less", "as_more", F.lit(0)).cast("int"))
    spread = checkpointed(sized.select("key_u", "key_v", "v", "now", "e", "d", "as_less", "as_more", F.posexplode(first).alias("at", "of")))
    sides = spread.select("key_u", F.col("of.hash").alias("hash"), "as_less", "as_more", "at", F.struct("e", F.col("key_v").alias("key")).alias("m"), F.col("v").alias("fp"), "now", (F.col("d") - F.col("at")).alias("left"))
    less = sides.where("at < as_less").select("key_u", "hash", *(F.col(x).alias(f"{x}_x") for x in ("m", "fp", "now", "left")))
    more = sides.where("at < as_more").select("key_u", "hash", *(F.col(x).alias(f"{x}_y") for x in ("m", "fp", "now", "left")))
    enough = F.least("left_x", "left_y") >= (F.col("m_x.e") + F.col("m_y.e")) / 2 - 1e-6
    met = less.join(more, ["key_u", "hash"]).where((F.col("m_x") < F.col("m_y")) & (F.col("now_x") != F.col("now_y")) & enough)
    return met.select(F.col("fp_x").alias("u"), F.col("fp_y").alias("v"), F.col("m_x.key").alias("key_u"), F.col("m_y.key").alias("key_v"))


def similar_links(rows: DataFrame, df_texts: DataFrame, only: DataFrame, edges: DataFrame, similarity: float, k: int, small: int = SMALL) -> DataFrame:
    """Further edges (u, v) between fingerprints: those of texts with a Jaccard similarity over k-word shingles.

    rows: (id, key, fp, n, bands) of every row; df_texts: (id, key, text). Texts that agree in a band of least values are candidates. In each band's
    bucket all are first compared with its head, the text whose buckets hold the most texts in all: of a group of near copies the one that most others
    are nearest to. What is then in different components is compared pair by pair in buckets of at most ``small`` texts; in larger ones every
    text's difference from a centre is taken, and only pairs that share enough of their differences are compared: see ``sharing``. Both ways
    try all pairs that can be similar, so a large group of near copies costs a row for each copy, not its pairs.
    """
    least_id = F.min(F.struct(F.col("id").isNull().alias("late"), "id"))
    folded = rows.groupBy("key").agg(least_id.alias("of"), F.min("fp").alias("fp"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    member = folded.join(_grouped(only, edges).select("fp", "group"), "fp").select(F.struct("group", "key", "fp", "n").alias("m"), "of", F.posexplode("bands").alias("band", "bucket"))
    sizes = member.groupBy("band", "bucket").agg(F.min("m.group").alias("a"), F.max("m.group").alias("b"), F.count("*").alias("size")).where("a < b").drop("a", "b")
    met = written(member.join(sizes, ["band", "bucket"]))
    weights = met.groupBy(F.col("m.key").alias("weighed")).agg((-F.sum("size")).alias("rank"))
    heads = met.join(weights, F.col("m.key") == F.col("weighed")).groupBy("band", "bucket").agg(F.min(F.struct("rank", "m.key", "m.fp", "m.n", "m.group")).alias("h"))
    shared = written(met.join(heads, ["band", "bucket"]))

    needed = shared.select(F.col("of.id").alias("needed_id"), F.col("m.key").alias("needed")).distinct()
    is_needed = F.col("id").eqNullSafe(F.col("needed_id")) & (F.col("key") == F.col("needed"))
    texts = written(df_texts.join(needed, is_needed, "left_semi").dropDuplicates(["id", "key"]).select("key", F.coalesce("text", F.lit("")).alias("text")))

    def ends(a: str, b: str) -> list[Column]:
        return [F.col(f"{a}.fp").alias("u"), F.col(f"{b}.fp").alias("v"), F.col(f"{a}.key").alias("key_u"), F.col(f"{b}.key").alias("key_v")]

    stars = written(shared.where((F.col("m.group") != F.col("h.group")) & _could_link("h", "m", similarity)).select(ends("h", "m")).distinct())
    by_head = _alike(stars, texts, similarity, k)

    groups = _grouped(only, edges.union(by_head)).select("fp", F.col("group").alias("now"))
    open_rows = shared.join(groups, F.col("m.fp") == groups["fp"]).select("band", "bucket", "size", "h", "m", "now")
    mixed = open_rows.where("m.key != h.key").groupBy("band", "bucket").agg(F.min("now").alias("a"), F.max("now").alias("b")).where("a < b").select("band", "bucket")
    still = written(open_rows.join(mixed, ["band", "bucket"]))

    few = still.where(F.col("size") <= small).select("band", "bucket", "m", "now")
    other = few.select("band", "bucket", F.col("m").alias("o"), F.col("now").alias("now_o"))
    apart = (F.col("now") != F.col("now_o")) & (F.col("m.key") < F.col("o.key")) & _could_link("m", "o", similarity)
    rest = few.join(other, ["band", "bucket"]).where(apart).select(ends("m", "o"))

    # Any text can be the centre; the head of the head's heaviest bucket is one that the buckets of a large group have in common.
    centres = shared.groupBy(F.col("m.key").alias("of_head")).agg(F.min("h").alias("centre"))
    placed = still.where(F.col("size") > small).join(centres, F.col("h.key") == F.col("of_head")).where("m.key != centre.key")
    placed = placed.select(*ends("centre", "m"), F.col("centre.n").alias("n_u"), F.col("m.n").alias("n"), "now").distinct()
    placed = _differences(placed, texts, similarity, k)

    ordered = [F.col("u"), F.col("v"), F.least("key_u", "key_v").alias("key_u"), F.greatest("key_u", "key_v").alias("key_v")]
    tried = stars.select(ordered).select("key_u", "key_v")
    pairs = rest.union(sharing(placed, similarity)).select(ordered).dropDuplicates(["key_u", "key_v"]).join(tried, ["key_u", "key_v"], "left_anti")
    return by_head.union(placed.where("alike").select("u", "v").distinct()).union(_alike(checkpointed(pairs.select("u", "v", "key_u", "key_v")), texts, similarity, k))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp, component_id): component_id is the smallest id that links reach."""
    prints = checkpointed(fingerprints(df, id_col, text_col))
    labelled, named = _labelled(prints, F.min(id_col))
    of_print = labelled.join(named, "root").select("fp", F.col("name").alias("component_id"))
    return prints.join(of_print, "fp").select(id_col, "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, k: int = SHINGLE) -> DataFrame:
    """One row, with all its columns, of each group of near-duplicates: that of the smallest id, and of those with one id or none that of the smallest digest of the text; a repeated row stays once.

    Groups are what links between fingerprints over k-word shingles within four bits reach and, with a similarity, also links between texts whose shingle sets
    have at least that Jaccard similarity. Those are about ten bits apart at 0.8, too many for the ring join, so their candidates come from bands of least
    values (0.998 of the pairs at 0.8, more above, less below: BANDS and BAND_ROWS are made for 0.8) and are checked exactly.
    """
    digest = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    picked = df.select(F.col(id_col).alias("id"), digest.alias("key"), F.col(text_col).alias("text"))

    def each(utf8: bytes, _: str) -> tuple:
        hashes = shingle_hashes(utf8, k)
        return fingerprint(hashes), *(bands(hashes) if similarity is not None else (0, []))

    fields = [("fp", "long", pa.int64()), ("n", "int", pa.int32()), ("bands", "array<bigint>", pa.list_(pa.int64()))]
    prints = written(map_texts(picked, {"id": F.col("id"), "key": F.col("key")}, F.col("text"), each, fields))
    _, named = _labelled(
        prints,
        F.min(F.struct(F.col("id").isNull().alias("late"), "id", "key")),
        None if similarity is None else lambda only, edges: similar_links(prints, picked, only, edges, similarity, k),
    )
    names = named.select(F.col("name.id").alias("__name"), F.col("name.key").alias("__digest"))
    kept = df.join(names, F.col(id_col).eqNullSafe(F.col("__name")) & (digest == F.col("__digest")), "left_semi")
    # Repeats are rare: whether there are any is counted on ids and digests alone.
    if prints.groupBy("id", "key").count().where("count > 1").limit(1).count() == 0:
        return kept
    return kept.withColumn("__mark", digest).dropDuplicates([id_col, "__mark"]).drop("__mark")
