"""Writers. Files come whole or not at all: Spark's committer moves finished files into place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)


def parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*(partition_by or [])).parquet(path)


def work_lists(df: DataFrame, path: str, by: list[str]) -> None:
    """Tab-separated lists, a folder for each group; groups are dealt to writers first, so that a group has one file or few."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).csv(path, sep="\t")


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def text_lines(df: DataFrame, path: str, column: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def xml(df: DataFrame, path: str, root: str, row: str) -> None:
    df.write.mode("overwrite").format("xml").option("rootTag", root).option("rowTag", row).save(path)


def appended_log(df: DataFrame, path: str) -> None:
    """Rows added to a log of text lines."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append").text(path)


#: Rows that are gathered into one text at most; more are refused, not cut.
ONE_TEXT = 100_000


def _few(df: DataFrame, most: int) -> DataFrame:
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return df


def joined_text(df: DataFrame, order: str, text: str, separator: str = "\n\n", most: int = ONE_TEXT) -> DataFrame:
    """One row: the texts in order, of at most ``most`` rows."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return _few(df, most).agg(F.array_join(F.transform(parts, lambda x: x["t"]), separator).alias(text))


def keyed_json(df: DataFrame, key: str, value: str, most: int = ONE_TEXT) -> DataFrame:
    """One row: a JSON object of key to value, of at most ``most`` rows."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))
    return _few(df, most).agg(F.to_json(F.map_from_entries(pairs)).alias("json"))


def markdown(df: DataFrame, most: int = 500) -> str:
    """A table of a small result; more than ``most`` rows are refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda cells: "| " + " | ".join("–" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])
