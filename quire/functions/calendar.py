"""The Julian calendar as columns. A DATE is a Julian label: its day arithmetic is used, its weekday functions are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.feasts import ADVENT, FROM_EASTER, ON_DAY


def julian_easter(year: Column) -> Column:
    """Easter Sunday, by Meeus."""
    d = F.pmod(19 * F.pmod(year, F.lit(19)) + 15, F.lit(30))
    e = F.pmod(2 * F.pmod(year, F.lit(4)) + 4 * F.pmod(year, F.lit(7)) + 6 * d + 6, F.lit(7))
    return F.date_add(F.make_date(year, F.lit(3), F.lit(1)), (21 + d + e).cast("int"))


def julian_day(date: Column) -> Column:
    """Julian Day Number of a Julian label."""
    month, year = F.month(date), F.year(date)
    a = F.when(month <= 2, 1).otherwise(0)
    y, m = year + 4800 - a, month + 12 * a - 3
    return (F.dayofmonth(date) + F.floor((153 * m + 2) / 5) + 365 * y + F.floor(y / 4) - 32083).cast("int")


def weekday(date: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.pmod(julian_day(date) + 1, F.lit(7))


def advent_sunday(year: Column, which: Column) -> Column:
    """The Advent Sunday of number 0 to 3; the last is the one on or before 24 December."""
    eve = F.make_date(year, F.lit(12), F.lit(24))
    return F.date_add(F.date_sub(eve, weekday(eve)), (7 * (which - 3)).cast("int"))


def weekday_after(date: Column, day: Column) -> Column:
    """The next such weekday; a week later where the date has it itself."""
    step = F.pmod(day - weekday(date), F.lit(7))
    return F.date_add(date, F.when(step == 0, 7).otherwise(step).cast("int"))


def weekday_before(date: Column, day: Column) -> Column:
    step = F.pmod(weekday(date) - day, F.lit(7))
    return F.date_sub(date, F.when(step == 0, 7).otherwise(step).cast("int"))


def feast_table(spark: SparkSession) -> DataFrame:
    """Rows (feast, from_easter, month, day, advent): a small dimension of fixed size."""
    rows = [(k, n, None, None, None) for k, n in FROM_EASTER.items()] + [(k, None, m, d, None) for k, (m, d) in ON_DAY.items()] + [(k, None, None, None, n) for k, n in ADVENT.items()]
    return spark.createDataFrame(rows, "feast string, from_easter int, month int, day int, advent int")


def feast_dates(years: DataFrame, feasts: DataFrame, year: str = "year") -> DataFrame:
    """Adds feast and feast_date to every year; the feast table is broadcast, being of fixed size."""
    y = F.col(year)
    date = (
        F.when(F.col("from_easter").isNotNull(), F.date_add(julian_easter(y), F.col("from_easter")))
        .when(F.col("advent").isNotNull(), advent_sunday(y, F.col("advent")))
        .otherwise(F.make_date(y, F.col("month"), F.col("day")))
    )
    return years.crossJoin(F.broadcast(feasts)).select(*years.columns, "feast", date.alias("feast_date"))


def is_sunday_feast(feasts: DataFrame) -> Column:
    """Whether a row of the feast table always falls on a Sunday."""
    return feasts["advent"].isNotNull() | F.coalesce(F.pmod(feasts["from_easter"], F.lit(7)) == 0, F.lit(False))
