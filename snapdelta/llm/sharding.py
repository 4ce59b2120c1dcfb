"""Sharding by a permutation-filled lookup table, placed by a broadcast join on the slot.

Each shard has its own order of preference over the slots of a prime-sized table: a start and a step from its name. Shards
take turns; each claims its next slot that is still free, until none is. A document's slot is its id's hash modulo the prime,
so placing costs one lookup, shards differ in size by at most one slot, and a removed shard moves few other slots.

The table has ``slots`` rows whatever the data; that is the bound of what is broadcast. Defined results: null ids are
hashed as the text ``null``, repeated ids share a shard, an empty table gives an empty result, extra columns are left out.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
SLOTS = 8_191


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards=SHARDS, slots: int = SLOTS) -> list[str]:
    """The shard of every slot. ``slots`` must be a prime well above the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, at least one")
    if slots < len(shards) or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime no smaller than the number of shards")
    at = [_number(f"start:{name}") % slots for name in shards]
    step = [_number(f"step:{name}") % (slots - 1) + 1 for name in shards]
    table: list[str | None] = [None] * slots
    free = slots
    while free:
        for turn, name in enumerate(shards):
            if not free:
                break
            while table[at[turn]] is not None:
                at[turn] = (at[turn] + step[turn]) % slots
            table[at[turn]] = name
            free -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint"), F.lit(slots))


def table_frame(spark: SparkSession, shards=SHARDS, slots: int = SLOTS) -> DataFrame:
    """The table as rows made in the JVM from one text, so that no Python runs on executors."""
    text = ",".join(lookup_table(shards, slots))
    rows = spark.range(0, 1, 1, 1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "shard"))
    return rows.select(F.col("slot").cast("bigint").alias("slot"), "shard")


def placed(docs: DataFrame, id_col: str = "doc_id", shards=SHARDS, slots: int = SLOTS) -> DataFrame:
    """Every row's id, slot and shard; no shuffle of the rows."""
    table = table_frame(docs.sparkSession, shards, slots)
    rows = docs.select(F.col(id_col).alias("doc_id"), slot_of(F.col(id_col), slots).alias("slot"))
    return rows.join(F.broadcast(table), "slot").select("doc_id", "slot", "shard")
