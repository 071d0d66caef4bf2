"""What the training-data operators share: reading, row keys, Arrow rows, durable cuts of lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside the operators, so that joins and orders keep such rows.
NULL_ID = -(2**63)

#: Rows taken from an Arrow batch at a time, so that a Python worker holds few texts at once.
STEP = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """did (doc_id, NULL_ID for null), th (hash of the text) and text ('' for null).

    (did, th) names a row up to repeated rows of one doc_id and one text, which are
    interchangeable. Other columns, whatever their names, are left behind.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"),
        F.xxhash64(text).alias("th"),
        text.alias("text"),
    )


def public_id(did: str = "did") -> Column:
    return F.when(F.col(did) != NULL_ID, F.col(did))


def rows(batch: pa.RecordBatch, step: int = STEP) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with the UTF-8 bytes of its text column."""
    at = batch.schema.get_field_index("text")
    for i in range(0, batch.num_rows, step):
        part = batch.slice(i, step)
        yield part, part.column(at).cast(pa.binary()).to_pylist()


def ints(part: pa.RecordBatch, name: str) -> list:
    return part.column(part.schema.get_field_index(name)).to_pylist()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors see. Only a session on one machine may go without a setting of it."""
    home = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if home is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        home = tempfile.mkdtemp()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(home)
    return home.rstrip("/")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library made in a shared file system, and what is in it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Spark deletes the shuffle files of a query that is planned and run here as soon as its result is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def durable(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder at once: a lost executor costs no more than a new read."""
    shared_folder(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint()


class Scratch:
    """Tables that steps have written, to be deleted together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame) -> DataFrame:
        self.paths.append(f"{shared_folder(self.spark)}/step-{uuid.uuid4().hex}")
        with shuffles_freed(self.spark):
            df.write.parquet(self.paths[-1])
        return self.spark.read.parquet(self.paths[-1])

    def clear(self) -> None:
        while self.paths:
            remove_folder(self.spark, self.paths.pop())


_scratch: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """What written() makes within is deleted at the end, innermost scope first; what is to outlive it is written by an outer one."""
    own = Scratch(spark)
    mark = _scratch.set(own)
    try:
        yield own
    finally:
        _scratch.reset(mark)
        own.clear()


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder as Parquet: what a checkpoint remembers of partitions and constraints grows with each skew_join, until planning does not end."""
    return (_scratch.get() or Scratch(df.sparkSession)).write(df)


def stay_only(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that stay (did, th) names. Of repeated rows of one doc_id and text, any one."""
    full = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    return full.join(stay, ["did", "th"]).groupBy("did", "th").agg(F.first("row").alias("row")).select("row.*")


def skew_join(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows joined to keys (each once) on the named whole-number columns, of which one value may hold a third of all rows.

    The sides meet on altered keys, so both are shuffled for the join itself, whatever dealt them
    out before; that is when adaptive execution can split the tasks of a hot key.
    """
    altered = [F.col(c).bitwiseXOR(F.lit(1)).alias(f"_{c}") for c in on]
    mine, theirs = rows.select("*", *altered), keys.select(*[c for c in keys.columns if c not in on], *altered)
    return mine.join(theirs, [f"_{c}" for c in on]).drop(*[f"_{c}" for c in on])
