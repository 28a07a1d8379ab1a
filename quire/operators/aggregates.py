"""Aggregates beyond the built-in ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_concat(df: DataFrame, keys: list[str], order: list[str], text: str, separator: str = " ", out: str = "text") -> DataFrame:
    """The texts of each key in order. Rows with a null key go."""
    known = df
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    return known.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["__t"]), separator).alias(out))


def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def conditional_distinct(df: DataFrame, subject: str, conditions: dict[str, Column], by: list[str]) -> DataFrame:
    """Distinct subjects for which each condition holds."""
    return df.groupBy(*by).agg(*[F.count_distinct(F.when(c, F.col(subject))).alias(n) for n, c in conditions.items()])


def having_all(df: DataFrame, subject: str, item: str, needed: list) -> DataFrame:
    """Subjects that have all the items. One flag for each item, so no subject's items are gathered."""
    flags = df.groupBy(subject).agg(*[F.max(F.col(item).eqNullSafe(F.lit(x)).cast("int")).alias(f"__{i}") for i, x in enumerate(needed)])
    return flags.where(" AND ".join(f"__{i} = 1" for i in range(len(needed)))).select(subject)


def size_ratio(n_test: Column, n_truth: Column) -> Column:
    """Size of one set in per cent of another; 0 where the other is empty."""
    return F.coalesce(F.try_divide(100.0 * n_test, n_truth), F.lit(0.0))


def weighted_mean(df: DataFrame, dataset: str, model: str, by: list[str], value: str, weight: str) -> DataFrame:
    """Mean of a value over datasets, weighted; only models that occur in all datasets. Null values leave both sums."""
    n = df.agg(F.count_distinct(dataset).alias("__n"))
    full = df.groupBy(model).agg(F.count_distinct(dataset).alias("__m")).join(n, F.col("__m") == F.col("__n")).select(model)
    there = df.join(full, model, "left_semi").where(F.col(value).isNotNull())
    return there.groupBy(model, *by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_mean"))


def best_flags(df: DataFrame, group: list[str], value: str, local: Column) -> DataFrame:
    """Adds best, best_local, is_best and is_best_local within each group."""
    w = Window.partitionBy(*group)
    out = df.withColumn("best", F.max(value).over(w)).withColumn("best_local", F.max(F.when(local, F.col(value))).over(w))
    near = lambda c: F.coalesce(F.abs(F.col(value) - F.col(c)) < 1e-9, F.lit(False))
    return out.withColumn("is_best", near("best")).withColumn("is_best_local", local & near("best_local"))


def outcome_table(df: DataFrame, group: str, outcome: str, outcomes: list[str]) -> DataFrame:
    """A row for each group and one named all: counts of each outcome and the total."""
    counts = [F.count_if(F.col(outcome) == o).alias(o) for o in outcomes]
    rolled = df.rollup(group).agg(F.grouping(group).alias("__g"), *counts, F.count("*").alias("total"))
    return rolled.withColumn(group, F.when(F.col("__g") == 1, "all").otherwise(F.col(group).cast("string"))).drop("__g")


def spans_by_label(df: DataFrame, key: str, label: str, start: str, end: str) -> DataFrame:
    """Rows (key, spans map<label, array<struct<start,end>>>)."""
    by = df.groupBy(key, label).agg(F.array_sort(F.collect_list(F.struct(F.col(start).alias("start"), F.col(end).alias("end")))).alias("__s"))
    return by.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(label).alias("k"), F.col("__s").alias("v"))))).alias("spans"))


def spans_wide(df: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """A column of spans for each label."""
    return df.select(key, *[F.try_element_at("spans", F.lit(n)).alias(n) for n in labels])


def totals(df: DataFrame, text: str, seconds: float | None = None) -> DataFrame:
    """One row: rows, bytes, mean bytes, and rows a second; nulls where there is nothing to divide by."""
    out = df.agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("n_bytes"))
    return out.withColumn("mean_bytes", F.try_divide("n_bytes", "n")).withColumn("per_second", F.try_divide(F.col("n").cast("double"), F.lit(seconds).cast("double")))


def known_values(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()
