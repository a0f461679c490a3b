"""Sharding by a permutation-filled lookup table.

Every shard walks its own permutation of the slots of a table of prime size;
shards take turns, each claiming the first slot of its walk that is free, until
no slot is.  Shares differ by at most one slot, and a shard that leaves or
comes moves few slots of the others.  The table has a fixed size whatever the
data, so it is broadcast, and a key is placed by one hash and one lookup.

Defined results: a null key is placed like any other value (Spark's hash of
null); equal keys go to the same shard; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots; a prime, well above 100 times the shards.
SLOTS = 65_537


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot the number of the shard that holds it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if slots < len(shards) or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime of at least the number of shards")
    walks = []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        first, skip = (int.from_bytes(digest[i : i + 8], "big") for i in (0, 8))
        walks.append([first % slots, skip % (slots - 1) + 1])
    table, free = [-1] * slots, slots
    while free:
        for number, walk in enumerate(walks):
            while table[walk[0]] >= 0:
                walk[0] = (walk[0] + walk[1]) % slots
            table[walk[0]] = number
            free -= 1
            if not free:
                break
    return table


def place(df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS, to: str = "shard") -> DataFrame:
    """``df`` with the shard's name of every row's ``key`` as column ``to`` (replaced if it is there)."""
    table = lookup_table(shards, slots)
    rows = df.sparkSession.createDataFrame([(i, shards[n]) for i, n in enumerate(table)], "__slot int, __shard string")
    placed = df.drop(to) if to in df.columns else df
    placed = placed.withColumn("__slot", F.pmod(F.xxhash64(key), F.lit(slots)).cast("int"))
    # the table has `slots` rows at every data size
    return placed.join(F.broadcast(rows), "__slot", "left").drop("__slot").withColumnRenamed("__shard", to)


#: Production layout of op2.
SHARDS = tuple(f"shard-{i:03d}" for i in range(256))


def op2(docs: DataFrame) -> DataFrame:
    """doc_id and shard of every document."""
    return place(docs.select("doc_id"), "doc_id", SHARDS)
