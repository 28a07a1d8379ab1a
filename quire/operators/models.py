"""Models behind two small interfaces, with rule-based stand-ins that give the same answers everywhere.

A predictor maps Arrow batches to Arrow batches and is made once for each task. A provider answers prompts; answers are kept in a table by the hash of
the request, so a task that runs again asks nothing twice that an earlier run has stored. No real model is shipped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import request_key

ANSWERS = "key string, content string, finish_reason string, tokens_in long, tokens_out long, attempts int, error string"


class Predictor(Protocol):
    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame: ...


@dataclass
class Answer:
    content: str
    finish_reason: str = "stop"
    tokens_in: int = 0
    tokens_out: int = 0


class Provider(Protocol):
    def generate(self, system: str, user: str, model: str, max_tokens: int, temperature: float, thinking: bool) -> Answer: ...


def predicted(df: DataFrame, make: Callable[[], Predictor], schema: str, batch_rows: int | None = None) -> DataFrame:
    """The predictor over the rows, in batches of the session's Arrow size or smaller ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make()
        for batch in batches:
            for start in range(0, len(batch), batch_rows or max(len(batch), 1)):
                yield predict(batch.iloc[start : start + (batch_rows or len(batch))])

    return df.mapInPandas(run, schema)


def requests(df: DataFrame, system: str, user: str, model: str, max_tokens: int = 4096, temperature: float = 0.0) -> DataFrame:
    """Adds key: the hash of everything that decides the answer."""
    return df.withColumn("key", request_key(F.col(system), F.col(user), F.lit(model), F.lit(max_tokens), F.lit(temperature)))


def answered(asked: DataFrame, cache: DataFrame, make: Callable[[], Provider], system: str, user: str, model: str, max_tokens: int = 4096, temperature: float = 0.0, tries: int = 3) -> DataFrame:
    """Rows of ANSWERS for distinct new keys: those in the cache are left out before any call. Empty answers are asked again, cut ones once with twice the room; errors are rows."""
    new = asked.select("key", F.col(system).alias("system"), F.col(user).alias("user")).dropDuplicates(["key"]).join(cache.where("error IS NULL AND content <> ''").select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for batch in batches:
            rows = []
            for key, sys, usr in batch[["key", "system", "user"]].itertuples(index=False):
                room, doubled, attempt, error, answer = max_tokens, False, 0, None, None
                while attempt < tries:
                    attempt += 1
                    try:
                        answer, error = provider.generate(sys, usr, model, room, temperature, False), None
                    except Exception as why:
                        error = f"{type(why).__name__}: {why}"
                        continue
                    if answer.finish_reason == "length" and not doubled:
                        room, doubled = 2 * room, True
                    elif answer.content.strip():
                        break
                a = answer or Answer("", "error")
                rows.append((key, a.content, a.finish_reason, a.tokens_in, a.tokens_out, attempt, error))
            yield pd.DataFrame(rows, columns=["key", "content", "finish_reason", "tokens_in", "tokens_out", "attempts", "error"])

    return new.mapInPandas(run, ANSWERS)


class EchoProvider:
    """Answers with the prompt in a code fence: a stand-in for tests."""

    def generate(self, system: str, user: str, model: str, max_tokens: int, temperature: float, thinking: bool) -> Answer:
        text = f"<think>{system}</think>\n```text\n{user}\n```"
        cut = text[: 4 * max_tokens]
        return Answer(cut, "length" if len(cut) < len(text) else "stop", len(system.split()) + len(user.split()), len(cut.split()))


class KeywordClassifier:
    """The label of the first keyword found, else the last label; with the share of keywords found as probability. Label numbers decode by place."""

    def __init__(self, keywords: dict[str, list[str]], other: str):
        self.keywords, self.labels = keywords, [*keywords, other]

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for text in batch["text"].fillna(""):
            low = text.lower()
            hits = [sum(w in low for w in words) for words in self.keywords.values()]
            best = max(range(len(hits)), key=lambda i: (hits[i], -i)) if any(hits) else len(hits)
            rows.append((best, self.labels[best], (hits[best] / sum(hits)) if any(hits) else 1.0))
        return batch.assign(prediction=[r[0] for r in rows], prediction_label=[r[1] for r in rows], probability=[r[2] for r in rows])


class PatternTagger:
    """Spans of patterns by label."""

    def __init__(self, patterns: dict[str, str]):
        import re

        self.patterns = {k: re.compile(p) for k, p in patterns.items()}

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:
        spans = [[{"label": k, "start": m.start(), "end": m.end()} for k, p in self.patterns.items() for m in p.finditer(t or "")] for t in batch["text"]]
        return batch.assign(spans=spans)


def usage(answers: DataFrame) -> DataFrame:
    """One row: calls, tokens, errors and the mean of tokens a call (null without calls)."""
    out = answers.agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count("error").alias("errors"), F.sum("attempts").alias("attempts"))
    return out.withColumn("tokens_per_call", F.try_divide("tokens_out", "calls"))


# Parts of the names of models that do not generate text.
NOT_GENERATING = ["embed", "minilm", "bge", "jina", "rerank"]


def generating(name: Column) -> Column:
    """Whether a model of a server's list generates text, by its name."""
    return ~F.lower(name).rlike("|".join(NOT_GENERATING))


def thinking_options(name: Column, enabled: Column) -> Column:
    """JSON of the request options that turn thinking on or off: models of one family have their own name for it."""
    own = F.to_json(F.struct(F.struct(F.when(enabled, "enabled").otherwise("disabled").alias("type")).alias("thinking_config")))
    others = F.to_json(F.struct(F.struct(enabled.alias("enable_thinking")).alias("chat_template_kwargs")))
    return F.when(F.lower(name).contains("kimi"), own).otherwise(others)


def run_log(answers: DataFrame, system: str, model: str, seconds: float, **params: object) -> DataFrame:
    """One row for the log of a run: model, hash of the system prompt, parameters as JSON, totals, tokens an entry and tokens a second."""
    total = F.coalesce(F.col("tokens_in"), F.lit(0)) + F.coalesce(F.col("tokens_out"), F.lit(0))
    return usage(answers).select(
        F.lit(model).alias("model"), F.sha2(F.lit(system), 256).alias("prompt_sha256"), F.lit(json.dumps(params, sort_keys=True)).alias("params"), "calls", "tokens_in", "tokens_out", "errors",
        total.alias("tokens"), F.try_divide(total, "calls").alias("tokens_per_entry"), F.try_divide(total, F.lit(float(seconds))).alias("tokens_per_second"),
    )


def best_class(scores: Column) -> Column:
    """struct<prediction, probability>: the place of the largest score, and its share after a softmax."""
    top = F.array_max(scores)
    rest = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.exp((x - top).cast("double")))
    return F.struct((F.array_position(scores, top) - 1).alias("prediction"), (1.0 / rest).alias("probability"))
