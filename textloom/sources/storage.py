"""Lineage cut in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df from files in spark.checkpoint.dir; where that is unset on one machine, in a folder of our own."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        place = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not place:
            if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            place = f"file://{os.path.join(tempfile.gettempdir(), 'textloom-shared')}"
        context.setCheckpointDir(place)
    return df.checkpoint()


def release() -> None:
    """Give back to the system what this process has freed. Spark keeps Python workers for later tasks, and their allocators keep the most they ever had."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def spread(df: DataFrame) -> DataFrame:
    """A small input dealt out to all cores: a file with one row group is one task's work, however many cores wait.

    Inputs of more splits than there are cores, by the size of their files, stay as they are, so nothing large is shuffled.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if size < split * cores else df
