"""The Spark session with the settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quire", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; keyword names take dots as double underscores."""
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Arrow batches for Python workers: rows and bytes. Spark's own defaults let tens of megabytes of texts pile up in each worker.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "512"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b")}


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches, once for the whole session and all operators alike; values other than Spark's defaults are the session's own and stay."""
    for key, (default, ours) in BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)


#: Spark's own limit for the bytes of a generated method, and the JVM's: it interprets longer ones, which takes several times as long.
METHOD = ("spark.sql.codegen.hugeMethodLimit", "65535", "8000")


def compiled_methods(spark: SparkSession) -> None:
    """Rows of many columns go through generated methods that the JVM compiles, once for the whole session; a value other than Spark's default is the session's own and stays."""
    key, default, ours = METHOD
    if spark.conf.get(key) == default:
        spark.conf.set(key, ours)


#: Tasks for each core where work on a row is long.
TASKS = 4


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows over tasks for all cores, by keys: for long work on each row, as a file has few tasks with rows (one for each of its row groups, however it is split)."""
    return df.repartition(TASKS * df.sparkSession.sparkContext.defaultParallelism, *keys)


def options(spark: SparkSession, defaults: dict[str, object], prefix: str = "quire.") -> dict[str, object]:
    """The defaults, each in its own type, with what the session's configuration says below the prefix (``quire.generation.model``).

    Secrets are not among them: a provider is made on the executors and reads its own from the environment there.
    """
    out = dict(defaults)
    for key, default in defaults.items():
        said = spark.conf.get(prefix + key, None)
        if said is not None:
            out[key] = said.strip().lower() in ("true", "1", "yes") if isinstance(default, bool) else said if default is None else type(default)(said)
    return out
