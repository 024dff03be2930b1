"""What the training-data operators share: shared storage, Arrow maps, word splitting."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.functions.names import free_name  # noqa: F401  for the operators

BATCH_BYTES = 16 * 1024 * 1024
BATCH_ROWS = 2000
ROWS_PER_PARTITION = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset on one machine, one of our own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = f"file://{os.path.join(tempfile.gettempdir(), 'textloom-shared')}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/textloom/{spark.sparkContext.applicationId}"


_scopes: list[str] = []


def new_place(spark: SparkSession, label: str) -> str:
    return "/".join([_own_folder(spark), *_scopes, f"{label}-{uuid.uuid4().hex}"])


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[Callable[[], None]]:
    """Tables written within go to a folder of their own; gives a function that removes it, for when their result is a table elsewhere."""
    _scopes.append(f"{label}-{uuid.uuid4().hex}")
    place = "/".join([_own_folder(spark), *_scopes])
    try:
        yield lambda: _remove(spark, place)
    finally:
        _scopes.pop()


def gather(df: DataFrame, rows: int) -> DataFrame:
    """df in one partition for each ROWS_PER_PARTITION rows, where that is fewer than it has. Partitions are merged where they lie, without a shuffle."""
    return df.coalesce(max(2, -(-rows // ROWS_PER_PARTITION)))


def cut(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later steps start from files that outlive executors.

    rows: a bound of its rows, where one is known; then it gets only as many files as that calls for.
    """
    spark = df.sparkSession
    place = new_place(spark, label)
    (df if rows is None else gather(df, rows)).write.option("compression", "zstd").parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def _remove(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Remove this application's tables from the shared folder; for when its results have been written."""
    _remove(spark, _own_folder(spark))


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of a bounded size, so that very long texts never meet in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def release() -> None:
    """Give back to the system what this process has freed. Spark keeps Python workers for later tasks, and their allocators keep the most they ever had."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def arrow_map(df: DataFrame, fn, schema: str | StructType) -> DataFrame:
    """df.mapInArrow with bounded batches; fn takes and returns an iterator of record batches. At a task's end its worker gives memory back."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


#: schemes of Hadoop's connectors, by the name that pyarrow has for the same store
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}


def store_of(path: str):
    """pyarrow's file system for a path, and the path within it; raises where pyarrow has none."""
    from pyarrow import fs

    scheme, mark, rest = path.partition("://")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}{mark}{rest}")


def cut_map(df: DataFrame, fn, schema: str | StructType, label: str) -> DataFrame:
    """df.mapInArrow as a table in the shared folder, its files written where the rows are made.

    Each task writes one file under a name of its own and gives the name back; only the files of tasks that finished
    are read, so what lost executors and repeated tasks leave behind counts for nothing. The driver gets one name a
    task. Where pyarrow does not know the folder's store, Spark writes the table.
    """
    spark = df.sparkSession
    place = new_place(spark, label)
    try:
        store_of(place)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return cut(arrow_map(df, fn, schema), label)

    def run(batches):
        from pyarrow import parquet

        store, folder = store_of(place)
        name, writer, held, weight = f"part-{uuid.uuid4().hex}.parquet", None, [], 0
        for out in chain(fn(batches), [None]):
            if out is not None:
                held.append(out)
                weight += out.nbytes
            if held and (out is None or weight >= BATCH_BYTES):
                if writer is None:
                    store.create_dir(folder, recursive=True)
                    writer = parquet.ParquetWriter(f"{folder}/{name}", held[0].schema, filesystem=store, compression="zstd")
                writer.write_table(pa.Table.from_batches(held))
                held, weight = [], 0
        if writer:
            writer.close()
            yield pa.record_batch([pa.array([name])], names=["name"])

    names = arrow_map(df, run, "name string").toArrow()["name"].to_pylist()
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{place}/{n}" for n in names])


def cut_rows(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """cut of narrow rows, its files written as cut_map writes them: on a local file system Spark's JVM forks `chmod` for each file it writes."""
    return cut_map(df if rows is None else gather(df, rows), iter, df.schema, label)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is an empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone: further columns, whatever their names, never meet those an operator adds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df (a table of narrow rows) marked for broadcast if it has at most `rows` rows; beyond that Spark joins it as it sees fit."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
