"""Cutting texts to a byte budget for byte-level models, and putting the pieces together again."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.arrow import arrow_udf

MAX_BYTES = 150
#: Separators from the best place to cut to the worst.
SEPARATORS = ("\n\n", "\n", ". ", "; ", ", ", " ")


def cut_to_bytes(text: str | None, max_bytes: int = MAX_BYTES, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``max_bytes`` UTF-8 bytes, counting one for the end mark.

    A piece too long is halved at the middle occurrence of the first separator that leaves text on both sides (the separator itself goes),
    else at the first character border from the middle byte on. An explicit stack takes the place of recursion.
    """
    if not text:
        return [] if text is None else [text]
    done: list[str] = []
    todo = [text]
    while todo:
        piece = todo.pop()
        utf8 = piece.encode("utf-8")
        if len(utf8) + 1 <= max_bytes or len(piece) == 1:
            done.append(piece)
            continue
        for separator in separators:
            parts = piece.split(separator)
            half = len(parts) // 2
            left, right = separator.join(parts[:half]), separator.join(parts[half:])
            if left and right:
                break
        else:
            middle = len(utf8) // 2
            left = utf8[:middle].decode("utf-8", errors="ignore")
            if len(utf8[:middle]) != len(left.encode("utf-8")):
                left = piece[: len(left) + 1]
            left = left or piece[0]
            right = piece[len(left) :]
        todo += [right, left] if right else [left]
    return done


def cut_by_words(text: str | None, max_len: int = MAX_BYTES) -> list[str]:
    """Pieces of at most ``max_len`` bytes, end mark included, by halving at the middle word, or the middle character of a single word.

    Halves are rounded to even. Line breaks become spaces.
    """
    if text is None:
        return []
    done, todo = [], [text]
    while todo:
        piece = todo.pop()
        if len(piece.encode("utf-8")) + 1 <= max_len or len(piece) <= 1:
            done.append(piece)
            continue
        parts = piece.split()
        if len(parts) > 1:
            half = round(len(parts) / 2)
            left, right = " ".join(parts[:half]), " ".join(parts[half:])
        else:
            half = max(1, round(len(piece) / 2))
            left, right = piece[:half], piece[half:]
        todo += [right, left]
    return done


@arrow_udf("array<string>")
def chunk_bytes(texts: pd.Series) -> pd.Series:
    return texts.map(cut_to_bytes)


@arrow_udf("array<string>")
def chunk_words(texts: pd.Series) -> pd.Series:
    return texts.map(cut_by_words)


@arrow_udf("array<int>")
def byte_tokens(texts: pd.Series) -> pd.Series:
    """Bytes plus 3, then the end mark 1; at most 1024 of them."""
    return texts.map(lambda t: [b + 3 for b in (t or "").encode("utf-8")[:1023]] + [1])


@arrow_udf("string")
def from_byte_tokens(ids: pd.Series) -> pd.Series:
    return ids.map(lambda x: None if x is None else bytes(i - 3 for i in x if 3 <= i <= 258).decode("utf-8", errors="ignore"))


def chunked(df: DataFrame, text: Column, chunk=chunk_bytes) -> DataFrame:
    """A row for each piece: the row's columns, chunk_pos and chunk; a text without pieces keeps one row with nulls."""
    return df.select("*", F.posexplode_outer(chunk(text)).alias("chunk_pos", "chunk"))


def rejoined(chunks: DataFrame, keys: list[str], chunk: str = "chunk", pos: str = "chunk_pos", out: str = "text") -> DataFrame:
    """Pieces joined by spaces in order; rows with a null key go, as they name no row."""
    known = chunks
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    pieces = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(chunk).alias("c"))))
    return known.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda x: x["c"]), " ").alias(out))
