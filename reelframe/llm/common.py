"""What the corpus operators share: reading tables, cutting lineage, batching texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into arrays at once.
CHUNK_BYTES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or else the one set for the context; in a local session one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get()
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="reelframe-")
        spark.sparkContext.setCheckpointDir(path)
    return path


_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What cut() writes inside goes at the end, but for what is cut with keep=True."""
    held = _FOLDER.set(f"{_FOLDER.get() or shared_dir(spark)}/reelframe-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(_FOLDER.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _FOLDER.reset(held)


def cut(df: DataFrame, keep: bool = False, file_rows: int = 0) -> DataFrame:
    """df written as a table in the shared folder and read again.

    Later jobs start from the written files, so a lost executor costs one
    task and iterations do not grow the plan. keep: it outlives scratch().
    file_rows: rows of a file at most, for rows of many kilobytes: a reader
    decodes thousands of rows of a file at once, and holds them all.
    """
    spark = df.sparkSession
    path = f"{(None if keep else _FOLDER.get()) or shared_dir(spark)}/reelframe-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, columns: list[str]) -> str:
    """A column name that none of the columns has, upper and lower case alike."""
    taken = {c.lower() for c in columns}
    return next(x for k in range(len(taken) + 1) if (x := f"_{name}_{k}") not in taken)


def boxed(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """docs as one struct column `row`, beside other columns made from it: any names of its own may be in use."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *columns)


def unboxed(columns: list[str]) -> list[Column]:
    """The columns that boxed() put away."""
    return [F.col("row").getField(c).alias(c) for c in columns]


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of a text column; a longer text stands alone."""
    for batch in batches:
        at, size = 0, 0
        for i, x in enumerate(batch.column(column)):
            n = x.as_buffer().size if x.is_valid else 0
            if size and size + n > most:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n
        if at < batch.num_rows:
            yield batch.slice(at)
    # workers are used again: what the last batches took goes back
    del batches
    pa.default_memory_pool().release_unused()
