"""What the training-data operators share: reading, batch sizes, checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import bounded_batches

#: Python works on so many rows of an Arrow batch at a time.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table as read, dealt anew only where its files make fewer partitions than there are cores: small inputs in one file. Larger ones are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _shared_folder(df: DataFrame) -> str:
    """The checkpoint folder below the one that spark.checkpoint.dir names.

    A folder of our own is made only on a single machine where neither the setting nor a checkpoint folder is there (local tests); on a cluster
    a folder that the executors do not share would lose what they write, so its lack is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quire-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint. It stays until the folder goes, unless the session has spark.cleaner.referenceTracking.cleanCheckpoints."""
    _shared_folder(df)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the checkpoint folder: for many rows, a third of a checkpoint's size. It goes when the application ends."""
    path = f"{_shared_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most BATCH_ROWS rows, so that what is made of texts does not pile up where a session has batches of many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def map_texts(
    df: DataFrame,
    keys: dict[str, Column],
    text: Column,
    each: Callable[[bytes, str], tuple],
    fields: list[tuple[str, str, pa.DataType]],
) -> DataFrame:
    """One output row for each input row: the keys, then what ``each(utf8, text)`` returns.

    keys: output name to column. fields: name, DDL type and Arrow type of each returned value. A null text is
    handed over as an empty one. Rows are streamed in batches bounded by rows and bytes; no row waits for another.
    """
    bounded_batches(df.sparkSession)
    names = list(keys)
    picked = df.select(*[c.alias(n) for n, c in keys.items()], F.coalesce(text, F.lit("")).alias("__text"))
    ddl = ", ".join([f"`{n}` {picked.schema[n].dataType.simpleString()}" for n in names] + [f"`{n}` {t}" for n, t, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(len(names)).to_pylist()
            rows = [each(t.encode("utf-8"), t) for t in texts]
            columns = list(zip(*rows)) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(names))] + [pa.array(c, kind) for c, (_, _, kind) in zip(columns, fields)],
                names=names + [n for n, _, _ in fields],
            )

    return picked.mapInArrow(run, ddl)


class Recent(dict):
    """A bounded memo in two generations: what is asked for again outlives the change from one to the next.

    make: gives the value of a key. Keys longer than ``chars`` are made anew each time.
    """

    def __init__(self, make: Callable, entries: int, chars: int):
        super().__init__()
        self.make, self.half, self.chars, self.old = make, entries // 2, chars, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.chars:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def filter_texts(df: DataFrame, text_col: str, keep: Callable[[bytes, str], bool]) -> DataFrame:
    """The rows, all columns as they are, whose text (null: empty) ``keep`` accepts. One pass, no shuffle."""
    bounded_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            yield batch.filter(pa.array([keep((t or "").encode("utf-8"), t or "") for t in texts], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def replace_texts(df: DataFrame, text_col: str, make: Callable[[bytes, str], str]) -> DataFrame:
    """The rows, all columns as they are but for the text, which ``make`` gives anew; a null text stays. One pass, no shuffle."""
    bounded_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [None if t is None else make(t.encode("utf-8"), t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return df.mapInArrow(run, df.schema)
