"""Quality rules as weak supervision.

Each rule votes good, bad or abstains. Expectation-maximisation over the counts of vote patterns (at most 3 to the number of rules, however large
the corpus) estimates for each rule how often it votes bad on bad and on good texts, and the share of good texts; the
posterior probability of good then decides, so no single rule rejects a text by itself unless its votes have proved telling.
Abstentions carry no evidence.

Null and empty texts have no words; they fail the base rule (fewer than 50 words) and are not kept. Repeated rows get a row each.
An empty table leaves the initial estimates and no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import checkpointed, filter_texts, map_texts

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
ABSTAIN, BAD, GOOD = 0, 1, 2
THRESHOLD = 0.5
#: Initial estimates: share of good texts, P(bad vote | bad), P(bad vote | good); pseudo-counts that hold the estimates in place.
PRIOR_GOOD, BAD_ON_BAD, BAD_ON_GOOD, PSEUDO = 0.85, 0.4, 0.01, 2.0
ROUNDS = 200

_SYMBOL = re.compile(b"[" + re.escape(SYMBOLS) + b"]")
_END = re.compile(rb"[.!?][\"')\]]*$")


def measures(utf8: bytes, text: str) -> dict[str, float]:
    """Counts of one text that the rules read; words are runs outside ASCII white space."""
    words = utf8.split()
    n = len(words)
    seen: set[bytes] = set()
    lines = dup = 0
    for line in utf8.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeated = 0
    if n >= 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        distinct = len(number)
        pairs = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)[1]
        windows, of = np.unique(pairs[:-1] * np.int64(distinct) + ids[2:], return_inverse=True)
        if len(windows) < n - 2:
            twice = np.flatnonzero(np.bincount(of)[of] > 1)
            covered = np.zeros(n, bool)
            for j in range(3):
                covered[twice + j] = True
            repeated = int(covered.sum())
    else:
        distinct = len(set(words))
    plain = utf8.translate(None, SYMBOLS)
    letters = len(utf8) - len(utf8.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)) - (len(utf8) - len(text)),
        "n_symbols": len(utf8) - len(plain),
        "n_dup_lines": dup,
        "n_repeat_words": repeated,
        "n_symbol_words": sum(1 for w in words if _SYMBOL.search(w)) if n and utf8 != plain else 0,
        "lines": lines,
        "distinct": distinct,
        "letters": letters,
        "upper": letters - (len(utf8) - len(utf8.translate(None, b"abcdefghijklmnopqrstuvwxyz"))),
        "ends": sum(1 for w in words if _END.search(w)) if n else 0,
    }


def _vote(bad: bool, good: bool) -> int:
    return BAD if bad else GOOD if good else ABSTAIN


def votes(m: dict[str, float]) -> tuple[int, ...]:
    """One vote for each rule of RULES."""
    n, lines = m["n_words"], m["lines"]
    if not n:
        return (ABSTAIN,) * len(RULES)
    length, symbols, repeat = m["word_chars"] / n, m["n_symbols"] / n, m["n_repeat_words"] / n
    dup, varied, ends = m["n_dup_lines"] / max(lines, 1), m["distinct"] / n, m["ends"] / n
    upper = m["upper"] / m["letters"] if m["letters"] else 0.0
    return (
        _vote(symbols > 0.1, symbols < 0.02),
        _vote(m["n_symbols"] > 0.05 * m["word_chars"], m["n_symbols"] < 0.01 * m["word_chars"]),
        _vote(m["n_symbol_words"] > 0.1 * n, m["n_symbol_words"] < 0.02 * n),
        _vote(repeat > 0.3, repeat < 0.1),
        _vote(dup > 0.3, lines > 1 and dup < 0.1),
        _vote(length < 3 or length > 10, 3.5 < length < 7),
        _vote(m["letters"] >= 20 and upper > 0.3, m["letters"] >= 20 and upper < 0.1),
        _vote(n >= MIN_WORDS and varied < 0.2, varied > 0.4 or n < MIN_WORDS),
        _vote(n >= MIN_WORDS and (ends < 0.01 or ends > 0.5), 0.03 < ends < 0.3),
    )


RULES = ("symbols", "symbol share", "words with symbols", "repeated words", "repeated lines", "word length", "capitals", "variety", "sentence ends")


def pattern(v: tuple[int, ...]) -> int:
    return sum(x * 3**i for i, x in enumerate(v))


def unpack(code: int) -> tuple[int, ...]:
    return tuple(code // 3**i % 3 for i in range(len(RULES)))


class Model:
    """Estimates: share of good texts and, for each rule, the chance of a bad vote on bad and on good texts."""

    def __init__(self, good: float, bad_on_bad: list[float], bad_on_good: list[float]):
        self.good, self.bad_on_bad, self.bad_on_good = good, bad_on_bad, bad_on_good

    def posterior(self, v: tuple[int, ...]) -> float:
        odds = math.log(self.good / (1 - self.good))
        for x, b, g in zip(v, self.bad_on_bad, self.bad_on_good):
            if x != ABSTAIN:
                odds += math.log(g / b) if x == BAD else math.log((1 - g) / (1 - b))
        return 1 / (1 + math.exp(-odds))


def fit(counts: dict[int, int]) -> Model:
    """Expectation-maximisation over pattern counts. Counts weigh as they are; the pseudo-counts fade as the corpus grows."""
    k = len(RULES)
    model = Model(PRIOR_GOOD, [BAD_ON_BAD] * k, [BAD_ON_GOOD] * k)
    rows = sorted((unpack(c), n) for c, n in counts.items())
    for _ in range(ROUNDS):
        good_n = bad_n = 0.0
        cast = [[[0.0, 0.0], [0.0, 0.0]] for _ in range(k)]  # rule, class, (votes, bad votes)
        for v, n in rows:
            p = model.posterior(v)
            good_n += n * p
            bad_n += n * (1 - p)
            for j, x in enumerate(v):
                if x != ABSTAIN:
                    for c, share in ((0, 1 - p), (1, p)):
                        cast[j][c][0] += n * share
                        cast[j][c][1] += n * share * (x == BAD)
        new = Model(
            (good_n + PSEUDO * PRIOR_GOOD) / (good_n + bad_n + PSEUDO),
            [(cast[j][0][1] + PSEUDO * BAD_ON_BAD) / (cast[j][0][0] + PSEUDO) for j in range(k)],
            [(cast[j][1][1] + PSEUDO * BAD_ON_GOOD) / (cast[j][1][0] + PSEUDO) for j in range(k)],
        )
        moved = max(abs(a - b) for a, b in zip([new.good, *new.bad_on_bad, *new.bad_on_good], [model.good, *model.bad_on_bad, *model.bad_on_good]))
        model = new
        if moved < 1e-9:
            break
    return model


def base_failed(m: dict[str, float]) -> bool:
    return m["n_words"] < MIN_WORDS or 100 * m["n_repeat_words"] > 50 * m["n_words"]


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, the five base counts, base_failed, votes: the packed pattern)."""

    def each(utf8: bytes, text: str) -> tuple:
        m = measures(utf8, text)
        return (*[m[c] for c in _COUNTS], base_failed(m), pattern(votes(m)))

    fields = [(c, "long", pa.int64()) for c in _COUNTS] + [("base_failed", "boolean", pa.bool_()), ("votes", "int", pa.int32())]
    return map_texts(df, {id_col: F.col(id_col)}, F.col(text_col), each, fields)


def _posteriors(patterns: DataFrame) -> tuple[dict[int, float], DataFrame]:
    counts = {r[0]: r[1] for r in patterns.groupBy("votes").count().collect()}  # at most 3 ** len(RULES) rows
    model = fit(counts)
    posterior = {c: model.posterior(unpack(c)) for c in counts}
    spark = patterns.sparkSession
    return posterior, spark.createDataFrame([(int(c), float(p)) for c, p in posterior.items()], "votes int, posterior double")


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (id, the five base counts, base_failed, votes, posterior, kept). One pass over the texts; the measures are kept in a checkpoint."""
    rows = checkpointed(measured(df, id_col, text_col))
    _, known = _posteriors(rows)
    joined = rows.join(F.broadcast(known), "votes")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep_good(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The kept rows with all their columns: one pass counts the patterns, a second one filters."""
    posterior, _ = _posteriors(measured(df.select(F.lit(0).alias("__id"), F.col(text_col).alias("__text_of")), "__id", "__text_of"))

    def keep(utf8: bytes, text: str) -> bool:
        m = measures(utf8, text)
        return not base_failed(m) and posterior[pattern(votes(m))] >= threshold

    return filter_texts(df, text_col, keep)
