"""Shards by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table of prime size.
Shards take turns; the shard whose turn it is claims the first slot of its
permutation that is still free. So all shards hold nearly the same number of
slots, and a shard that goes or comes moves few of the others' slots. A row's
slot is its key's hash modulo the size; one broadcast join with the table, whose
size is a parameter and not the data's, places it.

Defined cases: a null key has a slot as well (the hash of null), repeated keys
share a shard, an empty table gives an empty result. Columns other than the key
pass through; the two new ones replace any of the same name.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A prime well above 100 times the number of shards keeps their loads within one per cent.
TABLE_SIZE = 65537
SHARDS = tuple(f"shard-{i:03d}" for i in range(128))
#: The most slots a lookup table may have, so that its broadcast is bounded (12 bytes a slot).
MOST_SLOTS = 10_000_000


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preferences(shard: str, size: int) -> tuple[int, int]:
    """Offset and step of a shard's permutation; any step in 1..size-1 visits all slots of a prime size."""
    digest = hashlib.sha256(shard.encode()).digest()
    return int.from_bytes(digest[:8], "little") % size, int.from_bytes(digest[8:16], "little") % (size - 1) + 1


def lookup_table(shards: tuple[str, ...] | list[str], size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> np.ndarray:
    """The index of the owning shard of each slot. A shard of weight w takes w turns a round."""
    names = list(shards)
    if len(set(names)) != len(names) or not names:
        raise ValueError("shards need distinct names, one at least")
    if not is_prime(size) or size < len(names) or size > MOST_SLOTS:
        raise ValueError(f"size must be a prime from the number of shards to {MOST_SLOTS}")
    turns = [i for i, name in enumerate(names) for _ in range((weights or {}).get(name, 1))]
    if not turns:
        raise ValueError("one weight at least must be positive")
    order = [preferences(name, size) for name in names]
    owner, tried, free = np.full(size, -1, np.int32), [0] * len(names), size
    while free:
        for i in turns:
            offset, step = order[i]
            slot = (offset + tried[i] * step) % size
            while owner[slot] >= 0:
                tried[i] += 1
                slot = (offset + tried[i] * step) % size
            owner[slot] = i
            tried[i] += 1
            free -= 1
            if not free:
                break
    return owner


def lookup_frame(spark: SparkSession, shards, size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> DataFrame:
    owner = lookup_table(shards, size, weights)
    schema = T.StructType([T.StructField("slot", T.IntegerType(), False), T.StructField("shard", T.StringType(), False)])
    return spark.createDataFrame([(i, shards[k]) for i, k in enumerate(owner.tolist())], schema)


def assign(df: DataFrame, key: str, shards=SHARDS, size: int = TABLE_SIZE, weights: dict[str, int] | None = None) -> DataFrame:
    """df with ``slot`` and ``shard``. No shuffle: the table of ``size`` rows is broadcast."""
    placed = df.drop("slot", "shard").withColumn("slot", F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(size)).cast("int"))
    return placed.join(F.broadcast(lookup_frame(df.sparkSession, shards, size, weights)), "slot")


def write_shards(df: DataFrame, key: str, path: str, shards=SHARDS, size: int = TABLE_SIZE, files_per_shard: int = 8) -> None:
    """One folder a shard. Rows of a shard are dealt over several writers, so that no task writes a whole shard."""
    placed = assign(df, key, shards, size)
    dealt = placed.repartition(F.col("shard"), F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit(1)), F.lit(files_per_shard)))
    dealt.write.mode("overwrite").partitionBy("shard").parquet(path)
