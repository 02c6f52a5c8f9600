"""Sharding by a permutation-filled lookup table.

Shards take turns; at its turn a shard claims the next free slot of its own permutation of a prime-sized
table. Placement of a row is one array access, ``table[hash(key) mod size]``. The table has a fixed size
(about 100 slots a shard by default), so that the literal sent with each task never grows with the data.
Everything on the path of rows is a built-in expression; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


@lru_cache(maxsize=32)
def lookup_table(shards: tuple[str, ...], size: int) -> tuple[int, ...]:
    """The index of the shard that owns each slot. size: a prime of at least the number of shards.
    Slots per shard differ by one at most; without one shard, few slots of the others change hands."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not is_prime(size) or size < len(shards):
        raise ValueError("size must be a prime of at least the number of shards")
    start = [_number(f"offset:{s}") % size for s in shards]
    skip = [_number(f"skip:{s}") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    turn, owner, left = [0] * len(shards), [-1] * size, size
    while left:
        for i in range(len(shards)):
            while owner[slot := (start[i] + turn[i] * skip[i]) % size] >= 0:
                turn[i] += 1
            owner[slot], turn[i], left = i, turn[i] + 1, left - 1
            if not left:
                break
    return tuple(owner)


def key_hash(key: Column) -> Column:
    """60 bits of the key's MD5, the same in any SQL engine; a null key hashes as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def shard_of(key: Column, shards: tuple[str, ...], size: int) -> tuple[Column, Column]:
    """(slot, shard index) of a key. The table is one constant-folded array literal, which Spark broadcasts with the task."""
    slot = F.pmod(key_hash(key), F.lit(size)).cast("int")
    owners = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",").cast("array<int>")
    return slot, F.get(owners, slot)


def place(df: DataFrame, key: str, shards: tuple[str, ...], size: int = 65537) -> DataFrame:
    """df with the columns slot and shard (replaced where df has them already). Every row is placed, repeated
    rows on one shard; null keys share the slot of the empty string; an empty table stays empty."""
    slot, shard = shard_of(F.col(f"`{key}`"), shards, size)
    return df.withColumns({"slot": slot, "shard": shard})


def write_shards(df: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Writes a placed table into one folder a shard. Each shard's rows are dealt over `files_per_shard` tasks by
    slot, so that a shard larger than a task's memory is written by several."""
    dealt = df.withColumn("__part", F.pmod(F.col("slot"), F.lit(files_per_shard)))
    dealt.repartition("shard", "__part").drop("__part").write.partitionBy("shard").parquet(path)


#: Production parameters of the query.
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
SLOTS = 65537


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's slot and shard, with the bytes of text that it brings there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = place(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("text_bytes")), "doc_id", SHARDS, SLOTS)
    return placed.select("doc_id", "slot", "shard", "text_bytes")


def oracle() -> str:
    owners = ",".join(map(str, lookup_table(SHARDS, SLOTS)))
    return f"""
WITH t AS (SELECT string_split('{owners}', ',') AS owners),
k AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) AS text_bytes,
             CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {SLOTS} AS slot FROM documents)
SELECT doc_id, CAST(slot AS INTEGER) AS slot, CAST(owners[slot + 1] AS INTEGER) AS shard, CAST(text_bytes AS BIGINT) AS text_bytes FROM k, t"""
