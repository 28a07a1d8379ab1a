"""Packing of token sequences by Karmarkar-Karp multiway differencing.

A document's ids, with an id that ends it, are cut into full windows, which are sequences of their own, and a rest. Rests meet in blocks of
about ``BLOCK`` pieces. In a block every piece starts as a partial partition of k windows, one of them filled. The two partitions whose fullest and
emptiest windows differ most are merged, fullest against emptiest, until one is left: its windows are nearly equal. k is the least number that can hold the
block, and rises whenever a window exceeds the capacity. Windows that no piece touched yet are not stored, so merges of small partitions are cheap.

Whole rests level to within a few per cent only. So the rests whose checksum is divisible by ``LEVELLERS`` are cut into halves, quarters and so on
down to ``LEAST`` ids; with these the windows fill to within one per cent. All other documents that fit a window stay whole.

Blocks are drawn by the pieces' numbers in a written table, so no id, text or copy can fill one, and a lost task deals the same blocks again. A null
text is empty: its one id is the end. Repeated rows are packed one by one; ids are carried, never compared. Very long texts make full
windows and one rest. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from bisect import insort
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm.common import map_texts, written

WINDOW, BLOCK, LEVELLERS, LEAST = 2048, 2048, 8, 16
#: The split pattern of byte-level pre-tokenizers (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranked(described: dict) -> tiktoken.Encoding | None:
    """The same vocabulary as ranks, where ids order its merges and nothing but the byte-level split comes before them; else None."""
    model, before = described["model"], described["pre_tokenizer"]
    simple = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    split = before == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": before.get("trim_offsets"), "use_regex": True} if before else False
    added = described["added_tokens"]
    if not simple or not split or described["normalizer"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["special"] for t in added):
        return None
    vocabulary, byte_of = model["vocab"], _byte_of()
    merged = [vocabulary[m.replace(" ", "") if isinstance(m, str) else "".join(m)] for m in model["merges"]]
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    if merged != sorted(merged) or len(merged) + 256 != len(ranks):
        return None
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@cache
def encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a text as the tokenizers library gives them for the file, without the special tokens it would add round the text.

    Byte-level files are read as ranks, which is several times faster; texts that the faster library refuses (runs of a million spaces) and other
    files go to the tokenizers library itself.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    with open(path, encoding="utf-8") as f:
        ranked = _ranked(json.load(f))

    def plain(text: str) -> list[int]:
        return whole.encode(text, add_special_tokens=False).ids

    def fast(text: str) -> list[int]:
        try:
            return ranked.encode(text, allowed_special="all")
        except ValueError:
            return plain(text)

    return plain if ranked is None else fast


def halves(n: int, least: int = LEAST) -> list[int]:
    """n as a half, a quarter and so on, none below ``least``."""
    out = []
    while n >= 2 * least:
        out.append((n + 1) // 2)
        n //= 2
    return [*out, n]


def cut(ids: np.ndarray, window: int = WINDOW, levellers: int = LEVELLERS) -> list[tuple[int, int, int]]:
    """(start, length, checksum) of the pieces of a document's ids (little-endian unsigned 32-bit)."""
    n = len(ids)
    lengths = [window] * (n // window)
    rest = n % window
    if rest:
        lengths += halves(rest) if zlib.crc32(ids[n - rest :].tobytes()) % levellers == 0 else [rest]
    starts = np.cumsum([0, *lengths]).tolist()
    return [(a, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in zip(starts, starts[1:])]


def differenced(sizes: list[int], k: int) -> tuple[list[list[int]], int]:
    """(k nearly equal windows or fewer, as lists of positions in sizes; the fullest one's size).

    A partial partition is the ascending list of its filled windows (size, node); a node above the positions joins two others.
    """
    n, joined = len(sizes), []
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    for turn in range(n, 2 * n - 1):
        big, small = sorted((heapq.heappop(heap)[2], heapq.heappop(heap)[2]), key=len, reverse=True)
        # The fullest windows of the small one go to empty windows of the big one, the others, still fullest first, to its emptiest.
        meet = max(0, len(big) + len(small) - k)
        opposed = []
        for (x, i), (y, j) in zip(big[:meet], reversed(small[:meet])):
            opposed.append((x + y, n + len(joined)))
            joined.append((i, j))
        if len(small) <= 8:
            del big[:meet]
            for window in opposed + small[meet:]:
                insort(big, window)
        else:
            big = sorted(big[meet:] + small[meet:] + sorted(opposed))
        emptiest = big[0][0] if len(big) == k else 0
        heapq.heappush(heap, (emptiest - big[-1][0], turn, big))
    out = []
    for _, node in heap[0][2]:
        nodes, members = [node], []
        while nodes:
            at = nodes.pop()
            if at < n:
                members.append(at)
            else:
                nodes.extend(joined[at - n])
        out.append(sorted(members))
    return out, heap[0][2][-1][0]


def windows(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Positions in sizes, none above the capacity, in nearly equal windows; by how much the fullest one exceeds it says how many more are needed."""
    if not sizes:
        return []
    k = -(-sum(sizes) // capacity)
    while True:
        found, fullest = differenced(sizes, k)
        if fullest <= capacity:
            return found
        k = max(k + 1, k * fullest // capacity)


def pieces(df: DataFrame, path: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Rows (id, doc_tokens, start, length, ids_crc32) of every document; with_ids: also ids, an array."""
    kinds = [("start", "bigint", pa.int64()), ("length", "bigint", pa.int64()), ("ids_crc32", "bigint", pa.int64())] + ([("ids", "array<int>", pa.list_(pa.int32()))] if with_ids else [])

    def each(_: bytes, text: str) -> tuple:
        ids = np.array([*encoder(path)(text), end], "<u4")
        found = cut(ids, window)
        return len(ids), [dict(zip((k for k, _, _ in kinds), (*p, *([ids[p[0] : p[0] + p[1]].astype(np.int32)] if with_ids else [])))) for p in found]

    struct = f"array<struct<{', '.join(f'{n}: {t}' for n, t, _ in kinds)}>>"
    fields = [("doc_tokens", "long", pa.int64()), ("pieces", struct, pa.list_(pa.struct([pa.field(n, t) for n, _, t in kinds])))]
    return map_texts(df, {"__id": F.col(id_col)}, F.col(text_col), each, fields).select(F.col("__id").alias("id"), "doc_tokens", F.inline("pieces"))


def pack(df: DataFrame, path: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block: int = BLOCK, with_ids: bool = False) -> DataFrame:
    """Rows (id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one for each piece; with_ids: also ids.

    Sequence ids are even for windows of rests (block and window), odd for full windows.
    """
    cut_up = written(pieces(df, path, end, id_col, text_col, window, with_ids).withColumn("piece", F.monotonically_increasing_id()))
    more = ["ids"] if with_ids else []
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", *more]
    full = cut_up.where(F.col("length") == window).select(*columns, (F.col("piece") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rests = cut_up.where(F.col("length") < window)
    blocks = max(1, round(rests.count() / block))
    dealt = rests.select(*columns, "piece", F.pmod(F.xxhash64("piece"), F.lit(blocks)).alias("block"))

    def packed(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("piece")
        lengths = rows.column("length").to_numpy()
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for at, members in enumerate(windows(lengths.tolist(), window)):
            sequence[members] = at
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        sequence_id = 2 * (rows.column("block").to_numpy() * (1 << 24) + sequence)
        return rows.select(columns).append_column("sequence_id", pa.array(sequence_id)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.schema)
    return full.union(dealt.groupBy("block").applyInArrow(packed, schema)).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame, pad: int, window: int = WINDOW) -> DataFrame:
    """Rows (sequence_id, n_ids, ids): the ids of what ``pack`` gives with ids, in order, padded to a window. A sequence is at most a window of ids, so no group is large."""
    ordered = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("of"), F.sum("length").alias("n_ids"))
    ids = F.flatten(F.transform("of", lambda p: p["ids"]))
    return ordered.select("sequence_id", "n_ids", F.concat(ids, F.array_repeat(F.lit(pad), F.lit(window) - F.size(ids))).alias("ids"))
