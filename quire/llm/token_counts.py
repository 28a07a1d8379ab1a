"""Token counts by prefix dynamic programming.

For a merge tokenizer the tokens of a prefix, without the last one, are the tokens of the shorter prefix where the last
one starts. So the last token of every prefix follows from those of shorter prefixes: among the vocabulary entries that
end there, it is the one that starts the text or that the merges keep apart from the last token before it. Keeping
the count beside it gives the exact number of tokens of every prefix, each in at most as many steps as the longest
entry has characters, and answers budget and truncation questions without encoding anything again.

No vocabulary entry holds the space mark after another character (checked when the file is read), so merges never cross
such a place: a text is handled as words with the marks before them, and the tables of frequent words are kept.

Null text counts as the empty text: no bytes, no tokens. Repeated rows each get their own row; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Recent, map_texts

MARK = "▁"
#: Prefix tables kept by each Python worker: at most so many, of words of at most so many characters; and pair answers.
CACHE_WORDS, CACHE_CHARS, CACHE_PAIRS = 1_000_000, 40, 1_000_000
_NONE = float("-inf")


class PrefixCounter:
    """Counts of a sentence-piece BPE model with byte fallback, a dummy prefix and no other normalisation."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        self.score = {model.id_to_piece(i): model.get_score(i) for i in range(model.vocab_size()) if not special(i)}
        if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in self.score):
            raise ValueError("an entry of the vocabulary holds the space mark after another character")
        # What a piece starts with, to its number if it is itself one, else to -1.
        self.number = {piece[:k]: -1 for piece in self.score for k in range(1, len(piece))}
        self.number |= {piece: n for n, piece in enumerate(self.score)}
        self.inner = {piece[k : k + 2] for piece in self.score for k in range(len(piece) - 1)}
        self.whole = {piece for piece in self.score if self.merged(piece) == [piece]}
        self.apart_of: dict[int, bool] = {}
        self.words = Recent(self._table, CACHE_WORDS, CACHE_CHARS)
        # Where no entry holds a letter beside a character that is neither letter nor mark, words end there, too.
        mixed = any(regex.search(rf"\p{{L}}[^\p{{L}}{MARK}]|[^\p{{L}}{MARK}]\p{{L}}", piece) for piece in self.score)
        self.split = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if mixed else rf"{MARK}*(?:\p{{L}}+|[^\p{{L}}{MARK}]+)|{MARK}+").findall

    def merged(self, text: str) -> list[str]:
        """The plain merges of a short text: best score first, leftmost on ties."""
        parts, get = list(text), self.score.get
        scores = [get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) != _NONE:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], _NONE)
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], _NONE)
        return parts

    def apart(self, a: str, b: str) -> bool:
        """Whether the merges of a + b end in just these two."""
        return a[-1] + b[0] not in self.inner and b in self.whole or self.merged(a + b) == [a, b]

    def _table(self, word: str) -> bytes:
        """Counts of the prefixes of 1, 2, ... characters, as unsigned 32-bit integers."""
        n, number, apart_of, size = len(word), self.number, self.apart_of, len(self.number)
        last: list = [None] * (n + 1)  # the last token of the prefix: its number, or its text where it has none
        text_of: list = [""] * (n + 1)
        counts = [0] * (n + 1)
        for j in range(n):
            before = last[j]
            for i in range(j + 1, n + 1):
                token = word[j:i]
                own = number.get(token)
                single = i == j + 1
                if own is None and not single:
                    break
                if last[i] is None and (single or own >= 0):
                    if j == 0:
                        fits = single or token in self.whole
                    elif own is None or own < 0 or before < 0:
                        fits = self.apart(text_of[j], token)
                    else:
                        key = before * size + own
                        fits = apart_of.get(key)
                        if fits is None:
                            if len(apart_of) >= CACHE_PAIRS:
                                apart_of.clear()
                            fits = apart_of[key] = self.apart(text_of[j], token)
                    if fits:
                        known = own is not None and own >= 0
                        last[i] = own if known else -1
                        text_of[i] = token
                        counts[i] = counts[j] + (1 if known else len(token.encode("utf-8")))
                if own is None:
                    break
        return array("I", counts[1:]).tobytes()

    def prefixes(self, text: str) -> np.ndarray:
        """Exact token counts of text[:0], text[:1], ..., text. Not monotonic: a longer prefix may merge into fewer."""
        if not text:
            return np.zeros(1, np.int64)
        marked = MARK + text.replace(" ", MARK)
        tables = list(map(self.words.__getitem__, self.split(marked)))
        inside = np.frombuffer(b"".join(tables), np.uint32).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, tables), np.int64, len(tables)) >> 2)
        totals = inside[ends - 1]
        before = np.concatenate(([0], np.cumsum(totals)[:-1]))
        inside += np.repeat(before, np.diff(ends, prepend=0))
        inside[0] = 0  # the empty prefix has no dummy mark
        return inside


@cache
def counter(path: str) -> PrefixCounter:
    """One counter for each Python worker."""
    return PrefixCounter(path)


def longest_within(prefixes: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(prefixes <= budget)[-1])


def count_tokens(df: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", with_prefixes: bool = False) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit, fit_chars[, prefix_tokens]).

    fit_chars: characters of the longest prefix of at most ``limit`` tokens. prefix_tokens: array<int> of the counts of all
    prefixes from the empty one on, for other questions downstream.
    """

    def each(utf8: bytes, text: str) -> tuple:
        counts = counter(path).prefixes(text)
        n = int(counts[-1])
        row = (len(utf8), n, n > limit, len(text) if n <= limit else longest_within(counts, limit))
        return (*row, counts.astype(np.int32)) if with_prefixes else row

    fields = [("n_bytes", "long", pa.int64()), ("n_tokens", "long", pa.int64()), ("over_limit", "boolean", pa.bool_()), ("fit_chars", "long", pa.int64())]
    if with_prefixes:
        fields.append(("prefix_tokens", "array<int>", pa.list_(pa.int32())))
    return map_texts(df, {id_col: F.col(id_col)}, F.col(text_col), each, fields)
