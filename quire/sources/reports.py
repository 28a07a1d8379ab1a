"""Scores from HTML reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import report_parts

NUMBER = r"([0-9]+(?:\.[0-9]+)?)"


def _plain(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", ""), r"\s+", " "))


def scores(reports: DataFrame) -> DataFrame:
    """Rows (dataset, model, section, avg, metric, value) from rows (path, text) of reports.

    A section runs from its h2 to the next; its table rows that start with macro or micro hold precision, recall and F1.
    """
    named = reports.select(report_parts(F.substring_index("path", "/", -1)).alias("r"), "text").where("r.dataset IS NOT NULL").select("r.*", "text")
    parts = F.regexp_extract_all("text", F.lit(r"(?is)<h2[^>]*>(?:(?!<h2).)*"), F.lit(0))
    sections = named.select("dataset", "model", F.explode(parts).alias("part")).select("dataset", "model", _plain(F.regexp_extract("part", r"(?is)<h2[^>]*>(.*?)</h2>", 1)).alias("section"), "part")
    rows = sections.select("dataset", "model", "section", F.explode(F.regexp_extract_all("part", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), _plain)
    read = rows.select("dataset", "model", "section", cells.alias("cells")).where(F.lower(F.get("cells", F.lit(0))).rlike("^(macro|micro)"))
    values = F.transform(F.slice("cells", 2, 3), lambda c: F.regexp_extract(c, NUMBER, 1).try_cast("double"))
    metrics = F.arrays_zip(F.array(F.lit("precision"), F.lit("recall"), F.lit("f1")).alias("metric"), values.alias("value"))
    out = read.select("dataset", "model", "section", F.regexp_extract(F.lower(F.col("cells")[0]), "^(macro|micro)", 1).alias("avg"), F.inline(metrics))
    return out.toDF("dataset", "model", "section", "avg", "metric", "value").where("metric IS NOT NULL AND value IS NOT NULL")


def file_metric(name: Column) -> Column:
    """Character error rate in per cent of a model file whose name ends with its accuracy, such as model_0.93.mlmodel."""
    accuracy = F.regexp_extract(name, r"_([01](?:\.\d+)?)\.[A-Za-z]+$", 1).try_cast("double")
    return F.round((1 - accuracy) * 100, 1)


def best_model(files: DataFrame, name: str = "name", by: list[str] | None = None) -> DataFrame:
    """The file of the lowest error rate, of those the first by name, in each group; files whose name has no rate do not count."""
    rated = files.withColumn("cer", file_metric(F.col(name))).where("cer IS NOT NULL")
    best = rated.groupBy(*(by or [])).agg(F.min(F.struct("cer", name)).alias("best")).where("best IS NOT NULL")
    return best.select(*(by or []), F.col("best")[name].alias(name), "best.cer")
