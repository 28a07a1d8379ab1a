"""Checks of an encoding against its input: long rows (check, id, expected, actual, severity), never exceptions, and their application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import after_first_hash, squeeze
from quire.operators.joins import reconciled_ids

FINDINGS = "check string, id string, expected string, actual string, severity string"


def finding(rows: DataFrame, check: str, id_: Column, expected: Column, actual: Column, severity: str = "error") -> DataFrame:
    return rows.select(F.lit(check).alias("check"), id_.cast("string").alias("id"), expected.cast("string").alias("expected"), actual.cast("string").alias("actual"), F.lit(severity).alias("severity"))


def completeness(source: DataFrame, encoded: DataFrame, key: str = "id") -> DataFrame:
    """Findings of ids that are missing, extra, duplicate or null."""
    found = reconciled_ids(source, encoded, key).where("finding <> 'ok'")
    return found.select(F.concat(F.lit("id "), "finding").alias("check"), F.col(key).cast("string").alias("id"), F.col("n_left").cast("string").alias("expected"), F.col("n_right").cast("string").alias("actual"), F.lit("error").alias("severity"))


def fields(source: DataFrame, encoded: DataFrame) -> DataFrame:
    """Findings of entry texts, pointers and rubrics that differ. source: id, entry, pointer, rubric; encoded: id, entry, pointer, rubric of the encoding."""
    a = source.select("id", *[F.col(c).alias(f"want_{c}") for c in ("entry", "pointer", "rubric")])
    both = a.join(encoded.select("id", *[F.col(c).alias(f"got_{c}") for c in ("entry", "pointer", "rubric")]), "id")
    text = lambda c: squeeze(F.coalesce(F.col(c), F.lit("")))
    anchor = lambda c: after_first_hash(squeeze(F.col(c)))
    out = finding(both.where(F.col("got_entry").isNull()), "entry missing", F.col("id"), F.col("want_entry"), F.col("got_entry"))
    out = out.union(finding(both.where(F.col("got_entry").isNotNull() & (text("want_entry") != text("got_entry"))), "entry text", F.col("id"), text("want_entry"), text("got_entry")))
    for c in ("pointer", "rubric"):
        stated = F.coalesce(F.col(f"want_{c}"), F.lit("")) != ""
        out = out.union(finding(both.where(stated & ~anchor(f"want_{c}").eqNullSafe(anchor(f"got_{c}"))), c, F.col("id"), F.col(f"want_{c}"), F.col(f"got_{c}")))
    return out


def years(source: DataFrame, dates: DataFrame) -> DataFrame:
    """Findings of dates whose year is not the declared one; dates: rows (id, when). For report only."""
    both = dates.join(source.select("id", squeeze(F.col("year")).alias("declared")), "id")
    said = F.left(squeeze(F.col("when")), F.lit(4))
    return finding(both.where((F.col("declared") != "") & said.rlike(r"^\d{4}$") & (said != F.col("declared"))), "year", F.col("id"), F.col("declared"), F.col("when"), "report")


def same_party(parties: DataFrame, pairs: tuple = (("from", "to"), ("credit", "debit"))) -> DataFrame:
    """Findings of hosts with one party on both sides. parties: rows (id, host, role, party, rubric); the anonymous and the rubric's own term may stand twice."""
    name = parties.withColumn("name", after_first_hash(F.coalesce("party", F.lit("")))).withColumn("term", F.regexp_replace(after_first_hash(F.coalesce("rubric", F.lit(""))), "^[^_]*_", ""))
    out = None
    for left, right in pairs:
        side = lambda r: name.where(F.col("role") == r).groupBy("id", "host").agg(F.min("name").alias(r), F.min("term").alias(f"term_{r}"))
        both = side(left).join(side(right), ["id", "host"]).where((F.col(left) == F.col(right)) & ~F.col(left).isin("", "anonymous") & (F.col(left) != F.col(f"term_{left}")))
        found = finding(both, "same party", F.col("id"), F.concat(F.lit(f"{left}/{right} of "), F.coalesce("host", F.lit(""))), F.col(left))
        out = found if out is None else out.union(found)
    return out


def several_dates(dates: DataFrame, host: str = "host") -> DataFrame:
    """Findings of hosts with more than one date."""
    many = dates.groupBy(host).agg(F.count("*").alias("n")).where("n > 1")
    return finding(many, "several dates", F.col(host), F.lit("1"), F.col("n"), "report")


def applied(rows: DataFrame, findings: DataFrame, check: str, column: str, accept: Column, key: str = "id") -> DataFrame:
    """The expected values of accepted findings in place of the actual ones: what an interactive correction does, as a join."""
    fixes = findings.where((F.col("check") == check) & accept).groupBy(F.col("id").alias("__id")).agg(F.min("expected").alias("__want"))
    joined = rows.join(fixes, rows[key].cast("string") == F.col("__id"), "left")
    return joined.withColumn(column, F.coalesce("__want", F.col(column))).select(rows.columns)
