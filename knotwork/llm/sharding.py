"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order of the slots of a prime-sized table: a start and a step
from its name's hash, which run through all slots because the size is prime.  Shards take turns;
at its turn a shard claims the first slot of its order that is free.  A row's slot is its key's
hash modulo the table size.  The table's size is a parameter, so it may be broadcast whatever the
data; removing or adding a shard moves few keys, and a hot source spreads because the key is the row's.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import indexed

#: Slots; a prime over 100 times the shards keeps the shares within about one per cent.
SLOTS = 16_381
SHARDS = 64
#: Slots at most: one broadcast row each.
MAX_SLOTS = 1_000_003


def _preference(name: str, slots: int) -> tuple[int, int]:
    raw = hashlib.md5(name.encode()).digest()
    return int.from_bytes(raw[:8], "big") % slots, int.from_bytes(raw[8:], "big") % (slots - 1) + 1


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For every slot the index of the shard that claimed it."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not max(len(shards), 2) <= slots <= MAX_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    orders = [_preference(s, slots) for s in shards]
    at, table, free = [0] * len(shards), [-1] * slots, slots
    while True:
        for i, (start, step) in enumerate(orders):
            slot = (start + at[i] * step) % slots
            while table[slot] >= 0:
                at[i] += 1
                slot = (start + at[i] * step) % slots
            table[slot] = i
            at[i] += 1
            free -= 1
            if not free:
                return table


def slot_of(key: Column, slots: int) -> Column:
    """First 60 bits of the key's MD5, modulo the table size; a null key counts as empty."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("long")


def shard(df: DataFrame, key_col: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """The rows with the columns ``slot`` and ``shard_id`` behind their own.

    Rows with equal keys go to one shard; null keys to that of the empty key.  Nothing is shuffled.
    Columns of the input may have any names: theirs are kept as they are.
    """
    names = df.columns
    shards = shards or [f"shard-{i}" for i in range(SHARDS)]
    table = lookup_table(shards, slots)
    lookup = df.sparkSession.createDataFrame(list(enumerate(table)), "__slot long, __shard int")
    placed = indexed(df).withColumn("__slot", slot_of(F.col(f"__c{names.index(key_col)}"), slots))
    return placed.join(F.broadcast(lookup), "__slot").select(*[f"__c{i}" for i in range(len(names))], "__slot", "__shard").toDF(*names, "slot", "shard_id")


def placement_sql(table: list[int], slots: int, source: str = "documents", key: str = "doc_id") -> str:
    """The same placement as DuckDB SQL, with the table as a list."""
    return (
        f"SELECT {key}, slot, ([{','.join(map(str, table))}])[slot + 1]::INTEGER AS shard_id FROM ("
        f"SELECT {key}, ('0x' || substr(md5(coalesce({key}::VARCHAR, '')), 1, 15))::BIGINT % {slots} AS slot FROM {source})"
    )
