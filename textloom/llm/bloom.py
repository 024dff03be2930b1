"""A Bloom filter of a fixed size over 64-bit hashes: what it lets through is joined exactly, so it only saves a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import arrow_map, batch

BITS = 1 << 27  # 16 MB, whatever is put in; once full it lets everything through
PROBES = 4
_STEP = np.uint64(0xBF58476D1CE4E5B9)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES places of each hash in a filter of `bits` (a power of two)."""
    x = hashes.view(np.uint64)
    step = (x * _STEP) | np.uint64(1)
    return np.stack([(x + np.uint64(i) * step) * _MIX >> np.uint64(64 - bits.bit_length() + 1) for i in range(PROBES)]).astype(np.int64)


def build(hashes: DataFrame, column: str, bits: int = BITS, kind: str | None = None) -> tuple[np.ndarray, list[int]]:
    """The filter over a column as 64-bit words, or-ed in the tasks, and the values of the small whole numbers in `kind`.

    At most bits / 64 rows and one a value of `kind` reach the driver.
    """
    schema = pa.schema([("word", pa.int64()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_places(b.column(column).to_numpy(), bits).ravel())
            if len(at):
                word, first = np.unique(at >> 6, return_index=True)
                yield batch(schema, word, np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first).view(np.int64))
                if kind:
                    kinds = np.unique(b.column(kind).to_numpy()).astype(np.int64)
                    yield batch(schema, -1 - kinds, np.zeros(len(kinds), np.int64))

    columns = [column, kind] if kind else [column]
    rows = arrow_map(hashes.select(*columns), run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    word, value = rows["word"].to_numpy(), rows["value"].to_numpy().view(np.uint64)
    out = np.zeros(bits // 64, np.uint64)
    out[word[word >= 0]] = value[word >= 0]
    return out, sorted((-1 - word[word < 0]).tolist())


def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _places(hashes, 64 * len(table))
    return ((table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0)
