"""Joins by key, by position, for resuming and for upserts. Spark picks the strategy; nothing here is broadcast by hand unless its size is fixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``: what a dictionary filled in that order would hold. Partial aggregation, no window."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    return df.groupBy(*keys).agg(F.max_by(row, F.col(order)).alias("__row")).select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def lookup(df: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Left join to the last row of each key; status is success, or error for unknown keys."""
    known = latest(right, keys, order).drop(order).withColumn("__known", F.lit(True))
    out = df.join(known, keys, "left")
    return out.withColumn("status", F.when(F.col("__known"), "success").otherwise("error")).drop("__known")


def merge_back(df: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join; rows with a null key get nulls, as such keys name nothing."""
    return df.join(right, keys, "left")


def numbered(df: DataFrame, order: list[Column], partition: list[str], name: str = "ordinal") -> DataFrame:
    """An ordinal from 0 within each partition."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1)


def positional(left: DataFrame, right: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Pairs of rows of equal ordinal, as far as the shorter side goes."""
    return left.join(right, [*keys, ordinal])


def positional_outer(left: DataFrame, right: DataFrame, keys: list[str], ordinal: str = "ordinal", compare: str = "value") -> DataFrame:
    """Both sides by ordinal with a finding: same, different, missing (only left) or extra (only right)."""
    a = left.select(*keys, ordinal, F.col(compare).alias("left_value"), F.lit(True).alias("__a"))
    b = right.select(*keys, ordinal, F.col(compare).alias("right_value"), F.lit(True).alias("__b"))
    both = a.join(b, [*keys, ordinal], "full_outer")
    finding = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").when(F.col("left_value").eqNullSafe(F.col("right_value")), "same").otherwise("different")
    return both.select(*keys, ordinal, "left_value", "right_value", finding.alias("finding"))


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(ids.select(key), key, "left_semi")


def pending(work: DataFrame, done: DataFrame, keys: list[str], size: str | None = None, least: int = 0) -> DataFrame:
    """Work without a finished output; outputs smaller than ``least`` do not count."""
    finished = done.where(F.col(size) >= least) if size else done
    return work.join(finished.select(*keys), keys, "left_anti")


def incomplete(inputs: DataFrame, outputs: DataFrame, group: list[str]) -> DataFrame:
    """Groups (with n_in and n_out) that have fewer outputs than inputs."""
    a, b = inputs.groupBy(*group).agg(F.count("*").alias("n_in")), outputs.groupBy(*group).agg(F.count("*").alias("n_out"))
    return a.join(b, group, "left").withColumn("n_out", F.coalesce("n_out", F.lit(0))).where("n_out < n_in")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows take the place of old ones with their key, the others are added. Repeats of a key on one side stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def united(first: DataFrame, more: DataFrame, group: list[str], key: str, order: str, most: int) -> DataFrame:
    """Candidates of both tables, each key once where it was first seen, at most ``most`` a group (the feature's own limit)."""
    all_ = first.withColumn("__side", F.lit(0)).unionByName(more.withColumn("__side", F.lit(1)))
    rest = [c for c in first.columns if c not in (*group, key)]
    seen = all_.groupBy(*group, key).agg(F.min_by(F.struct(*rest, "__side"), F.struct("__side", order)).alias("__r"))
    flat = seen.select(*group, key, *[F.col("__r")[c].alias(c) for c in rest], F.col("__r.__side").alias("__side"))
    at = F.row_number().over(Window.partitionBy(*group).orderBy("__side", order, key))
    return flat.withColumn("rank", at).where(F.col("rank") <= most).drop("__side")


def reconciled_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows (key, n_left, n_right, finding): missing on the right, extra on it, duplicate on a side, or ok. Null keys are "no id"."""
    a = left.groupBy(key).agg(F.count("*").alias("n_left"))
    b = right.groupBy(key).agg(F.count("*").alias("n_right"))
    both = a.join(b, a[key].eqNullSafe(b[key]), "full_outer").select(F.coalesce(a[key], b[key]).alias(key), F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"))
    finding = F.when(F.col(key).isNull(), "no id").when(F.col("n_right") == 0, "missing").when(F.col("n_left") == 0, "extra").when(F.greatest("n_left", "n_right") > 1, "duplicate").otherwise("ok")
    return both.withColumn("finding", finding)


def grid(*dimensions: DataFrame) -> DataFrame:
    """All combinations of small dimensions."""
    out = dimensions[0]
    for d in dimensions[1:]:
        out = out.crossJoin(d)
    return out


def filled_grid(dimensions: list[DataFrame], facts: DataFrame, keys: list[str]) -> DataFrame:
    """The full grid with the facts; nulls where there are none."""
    return grid(*dimensions).join(facts, keys, "left")


def nearest_century(n: Column, near: Column, tolerance: int = 3) -> Column:
    """A year of the century, the next or the last one within the tolerance; the first that fits."""
    base = F.floor(near / 100) * 100 + n
    fits = F.filter(F.array(base, base + 100, base - 100), lambda y: F.abs(y - near) <= tolerance)
    return F.get(fits, F.lit(0)).cast("int")
