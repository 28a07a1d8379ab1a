"""Structured Streaming over files. A checkpoint remembers what is done, so a rerun takes only new files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100, format: str = "parquet") -> DataFrame:
    """Rows of files as they come; at most so many files a step keep the work in flight bounded."""
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def run_available(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """All that is there now, step by step through ``each``; it is given a step's number so that a repeated step can be told."""
    query = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upsert_into(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """Each step as a folder of its own below ``path``, so that a repeated step replaces itself; ``current`` gives the last row of each key."""

    def each(batch: DataFrame, step: int) -> None:
        batch.withColumn("__step", F.lit(step)).write.mode("overwrite").parquet(f"{path}/step={step}")

    return each


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The table that upserted steps make."""
    from quire.operators.joins import latest

    return latest(spark.read.parquet(path).drop("step"), keys, "__step").drop("__step")


def windowed_counts(events: DataFrame, time: str, group: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums in tumbling windows with a watermark (an extension; on a stream, windows close once the watermark has passed)."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), group).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
