"""Placement of keys on shards by a permutation-filled lookup table.

Each shard has an order of preference over the slots of a table of prime size (a start and a step from its name's
hash); shards take turns claiming their next free slot until the table is full, so shares differ by one slot at most,
and adding or removing a shard moves few keys. A key goes to the shard of the slot that its hash names.

Nulls: a null key is placed like the text of one character U+0000 and so has one defined shard. Repeated rows go to
the same shard. An empty table gives an empty result. Columns ``slot`` and ``shard`` of the input are replaced, but for
a key of that name, which stays: the result's own column is then called ``slot_`` or ``shard_``.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(names: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard number of each slot."""
    if not names or len(set(names)) != len(names) or not _is_prime(size) or len(names) > size:
        raise ValueError("shard names must be distinct, and the table's size a prime that is not below their number")
    digests = [hashlib.sha256(x.encode()).digest() for x in names]
    turns = np.arange(size, dtype=np.int64)
    prefer = [((int.from_bytes(d[:8], "big") % size + turns * (int.from_bytes(d[8:16], "big") % (size - 1) + 1)) % size).tolist() for d in digests]
    table, at, filled = [-1] * size, [0] * len(names), 0
    while filled < size:
        for shard, order in enumerate(prefer):
            while table[order[at[shard]]] >= 0:
                at[shard] += 1
            table[order[at[shard]]] = shard
            filled += 1
            if filled == size:
                break
    return table


def lookup_table(spark: SparkSession, names: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """slot, shard; as many rows as the table has slots, whatever the data."""
    return spark.createDataFrame([(s, x) for s, x in enumerate(fill_table(names, size))], "slot int, shard int")


def slot_of(key, size: int = TABLE_SIZE):
    """Column: the first 32 bits of the key's md5, modulo the table's size."""
    text = F.coalesce(key.cast("string"), F.lit("\0"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, names: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """df with the columns slot and shard. The table's size is a fixed number of small rows, so it is broadcast; rows
    stay where they are, and no key however common is gathered."""
    slot, shard = (f"{c}_" if c == key else c for c in ("slot", "shard"))
    table = lookup_table(df.sparkSession, names, size).toDF("_slot", shard)
    placed = df.withColumn("_slot", slot_of(F.col(key), size)).drop(slot, shard)
    return placed.join(F.broadcast(table), "_slot").withColumnRenamed("_slot", slot)


def write_shards(df: DataFrame, path: str, key: str, names: list[str], size: int = TABLE_SIZE, files: int = 4) -> None:
    """Write df with a folder per shard (``shard=N``). A shard's rows are dealt over up to ``files`` tasks by all their
    columns' hash, so that one with most rows is not written by one task."""
    placed = place(df, key, names, size)
    lot = F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith("map")]), F.lit(files))
    placed.withColumn("_lot", lot).repartition("shard", "_lot").drop("_lot").write.partitionBy("shard").parquet(path)
