"""Operator 4, shard placement by a permutation-filled lookup table (consistent hashing after Maglev, NSDI 2016).

Every shard has a preference order over the slots of a prime-sized table, a permutation given by an offset and a skip.
The shards take turns, each claiming its most preferred free slot, until the table is full. A document's key hashes to
a slot, so that placement is one lookup in a table of fixed size, which is why it may be broadcast.

Defined cases: a null id is placed as the empty key; equal keys share a shard, repeated rows are each placed; an empty
table gives an empty result; texts are not read. Other columns, whatever their names, are left alone, but that one named like an
added column is replaced by it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagemill.llm.common import held, unheld

#: Slots (a prime above a hundred times the shards keeps shares within about a hundredth) and shards of the registered query.
SLOTS = 4093
SHARDS = 32


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard index of each slot."""
    if not is_prime(slots) or not 0 < len(shards) <= slots:
        raise ValueError("slots must be a prime, no smaller than the number of shards (of which there must be one)")

    def numbers(name: str) -> tuple[int, int]:
        digest = hashlib.sha256(name.encode()).digest()
        return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:16], "big") % (slots - 1) + 1

    places = [numbers(name) for name in shards]
    at, skip = [p[0] for p in places], [p[1] for p in places]
    owner, free = [-1] * slots, slots
    while True:
        for shard in range(len(shards)):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + skip[shard]) % slots
            owner[at[shard]] = shard
            free -= 1
            if not free:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a string key: the first 48 bits of its MD5 digest modulo the table size."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key, F.lit(""))), 1, 12), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(docs: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """Adds `_slot` and `_shard` (index into `shards`) to every row; no shuffle."""
    table = docs.sparkSession.createDataFrame(list(enumerate(lookup_table(shards, slots))), "slot int, shard int")
    placed = held(docs, slot_of(F.col(f"`{key}`").cast("string"), slots).alias("slot")).join(F.broadcast(table), "slot")
    return unheld(placed, docs.columns, {"_slot": F.col("slot"), "_shard": F.col("shard")})


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs, shard_names()).select("doc_id", F.col("_slot").alias("slot"), F.col("_shard").alias("shard"))


def op4_sql() -> str:
    table = ",".join(map(str, lookup_table(shard_names())))
    return f"""
    WITH keyed AS (SELECT doc_id, ((('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT) % {SLOTS})::INTEGER AS slot FROM documents)
    SELECT doc_id, slot, ([{table}][slot + 1])::INTEGER AS shard FROM keyed"""
