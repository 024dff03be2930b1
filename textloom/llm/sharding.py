"""Sharding by a permutation-filled lookup table.

Shards take turns claiming slots of a table of prime size, each in the order of its own permutation of the slots; a
key's hash picks a slot and the slot names the shard. Adding or losing one shard moves little more than that shard's
share of the keys.

Defined cases: a null key is placed like the empty string; equal keys share a shard whatever their type's rows repeat;
an empty table gives an empty result; columns of the input named slot or shard are replaced by `with_shard`, but for a key
of that name, beside which the result is named slot_ or shard_; all other columns, whatever their names, stay.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import free_name

TABLE_SIZE = 65537
HASH_DIGITS = 13  # hex digits of an MD5 that make the key's hash: 52 bits, exact in every SQL engine's BIGINT


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def build_table(shards: list[str], size: int = TABLE_SIZE, weights: list[int] | None = None) -> np.ndarray:
    """slot -> index into shards. Preference order of a shard: (offset + j * skip) mod size, from its name's digest.

    weights: how many claims a shard makes in each round (1 where not given).
    """
    if not shards:
        raise ValueError("at least one shard is needed")
    if len(set(shards)) != len(shards):
        raise ValueError("shard names repeat")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime, not below the number of shards")
    turns = weights or [1] * len(shards)
    if len(turns) != len(shards) or min(turns) < 1:
        raise ValueError("one positive weight for each shard is needed")
    slots = np.full(size, -1, np.int32)
    place, skip = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        place.append(int.from_bytes(digest[:8], "big") % size)
        skip.append(int.from_bytes(digest[8:16], "big") % (size - 1) + 1)
    left = size
    while left:
        for i, claims in enumerate(turns):
            for _ in range(claims):
                while slots[place[i]] >= 0:
                    place[i] = (place[i] + skip[i]) % size
                slots[place[i]] = i
                left -= 1
                if not left:
                    return slots
    return slots


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: 52 bits of the MD5 of its text, modulo the table size."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_DIGITS)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(size)).cast("int")


def _table_frame(spark, shards: list[str], size: int, weights: list[int] | None, slot: str, shard: str) -> DataFrame:
    import pyarrow as pa

    slots = build_table(shards, size, weights)
    return spark.createDataFrame(pa.table({slot: pa.array(range(size), pa.int32()), shard: pa.array(slots)}))


def result_names(key: str) -> tuple[str, str]:
    """Names of the slot's and the shard's column."""
    return free_name("slot", [key]), free_name("shard", [key])


def with_shard(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE, weights: list[int] | None = None) -> DataFrame:
    """df with columns slot and shard (the shard's index).

    The table has `size` rows of eight bytes whatever the data, so it is broadcast: placement is one hash lookup a row.
    """
    names = result_names(key)
    kept = df.drop(*names)
    slot, shard = free_name("slot", kept.columns), free_name("shard", kept.columns)
    slots = _table_frame(df.sparkSession, shards, size, weights, slot, shard)
    keyed = kept.withColumn(slot, slot_of(F.col(f"`{key}`"), size))
    told = keyed.join(F.broadcast(slots), slot, "left")
    return told.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(slot).alias(names[0]), F.col(shard).alias(names[1]))


def assign(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """key, slot, shard of every row."""
    return with_shard(df.select(F.col(f"`{key}`")), key, shards, size)


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, files: int = 4, size: int = TABLE_SIZE) -> None:
    """Write df below path, a folder for each shard. A shard's rows are dealt over `files` tasks by a salt from the key, so that no task holds a whole shard."""
    slot, shard = result_names(key)
    placed = with_shard(df, key, shards, size).drop(slot)
    salt = free_name("salt", placed.columns)
    salted = placed.withColumn(salt, F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(files)))
    salted.repartition(shard, salt).drop(salt).write.partitionBy(shard).parquet(path)
