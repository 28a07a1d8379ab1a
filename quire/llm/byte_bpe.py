"""Byte-level BPE encoding and decoding.

A piece (one match of the split pattern) is merged with a segment tree over its byte positions. A leaf holds the rank
of the pair that starts there, packed with its position, so the root is the leftmost pair of least rank. A merge changes
three leaves at most (the pair itself, its dead right half and the live left neighbour), each with one walk to the root.

Null text encodes as the empty text: no ids, no bytes. Repeated rows each get their own row. The operators read the id
and text columns only; other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import base64
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Recent, map_texts

_NONE = 1 << 62
#: Encoded pieces kept by each Python worker: at most so many, of at most so many characters.
CACHE_PIECES, CACHE_CHARS = 600_000, 48


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: merge the leftmost pair of least rank until no pair is in the vocabulary.

    node is the segment tree over the byte positions, leaves from ``size`` on; a walk to the root ends early where nothing changes.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n == 0:
        return []
    get = ranks.get
    shift = n.bit_length()
    mask = (1 << shift) - 1
    end = list(range(1, n + 1))  # a live symbol at i covers piece[i:end[i]]
    left = list(range(-1, n))
    size = 1 << (n - 1).bit_length()
    node = [_NONE] * (2 * size)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            node[size + i] = rank << shift | i
    for i in range(size - 1, 0, -1):
        a, b = node[2 * i], node[2 * i + 1]
        node[i] = a if a < b else b
    while node[1] != _NONE:
        i = node[1] & mask
        j = end[i]
        last = end[i] = end[j]
        left[last] = i
        # The pair's dead right half, the pair itself, and the live neighbour on its left.
        for at in (j, i, left[i]):
            if at < 0:
                continue
            leaf = _NONE
            if at != j:
                middle = end[at]
                if middle < n:
                    rank = get(piece[at : end[middle]])
                    if rank is not None:
                        leaf = rank << shift | at
            k = at + size
            if node[k] == leaf:
                continue
            node[k] = leaf
            while k > 1:
                other = node[k ^ 1]
                least = other if other < node[k] else node[k]
                k >>= 1
                if node[k] == least:
                    break
                node[k] = least
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class ByteBpe:
    """A rank file with its split pattern; ``encode`` and ``decode`` are exact inverses on valid UTF-8."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.pieces = Recent(self._packed, CACHE_PIECES, CACHE_CHARS)

    def _packed(self, piece: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in merge_piece(piece.encode("utf-8"), self.ranks))

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return list(memoryview(self.encode_packed(text)).cast("I"))

    def decode_packed(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(packed).cast("I")))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@cache
def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One tokenizer for each Python worker."""
    return ByteBpe(path, pattern)


def encode_decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, ids binary, decoded binary): packed ids, and the bytes that these ids decode to."""

    def each(_: bytes, text: str) -> tuple:
        bpe = tokenizer(path, pattern)
        packed = bpe.encode_packed(text)
        return len(packed) // 4, packed, bpe.decode_packed(packed)

    fields = [("n_tokens", "long", pa.int64()), ("ids", "binary", pa.binary()), ("decoded", "binary", pa.binary())]
    return map_texts(df, {id_col: F.col(id_col)}, F.col(text_col), each, fields)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, ids binary)."""

    def each(_: bytes, text: str) -> tuple:
        packed = tokenizer(path, pattern).encode_packed(text)
        return len(packed) // 4, packed

    return map_texts(df, {id_col: F.col(id_col)}, F.col(text_col), each, [("n_tokens", "long", pa.int64()), ("ids", "binary", pa.binary())])


def encode_checked(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, ids binary, round_trip): round_trip tells whether the ids decode to the text's very bytes."""

    def each(utf8: bytes, text: str) -> tuple:
        bpe = tokenizer(path, pattern)
        packed = bpe.encode_packed(text)
        return len(packed) // 4, packed, bpe.decode_packed(packed) == utf8

    fields = [("n_tokens", "long", pa.int64()), ("ids", "binary", pa.binary()), ("round_trip", "boolean", pa.bool_())]
    return map_texts(df, {id_col: F.col(id_col)}, F.col(text_col), each, fields)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, decoded binary) from packed ids. Null ids decode to no bytes."""
    picked = df.select(F.col(id_col), F.coalesce(F.col(ids_col), F.lit(b"")).alias("__ids"))

    def run(batches):
        bpe = tokenizer(path, pattern)
        for batch in batches:
            out = [bpe.decode_packed(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    return picked.mapInArrow(run, f"`{id_col}` {picked.schema[0].dataType.simpleString()}, decoded binary")
