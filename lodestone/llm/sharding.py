"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime
size: it begins at one slot and goes on by a fixed skip, both from hashes of its
name. The shards take turns; in its turn a shard claims the next slot it prefers
that is free. So shards get equal parts of the table, and when shards come or
go, most slots stay where they were. A key's slot is its hash modulo the table's
size; the table, whose size does not depend on the data, is broadcast, so a row
is placed in constant time without a shuffle.

Filling the table is a loop on the driver over ``slots`` entries. Placing rows
uses built-in functions and a broadcast join alone.

Defined results: a null key is placed like an empty one; equal keys share a
shard, whatever their type writes alike as a string; other columns, long texts
among them, are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import unused

#: Production parameters: a prime far above a hundred times the shards keeps their parts within one per cent.
SLOTS = 65_537
SHARDS = 256


def hash_of(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of its shard."""
    if not is_prime(slots):
        raise ValueError(f"the number of slots must be prime: {slots}")
    if not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("shards must have distinct names, and be no more than slots")
    at = [hash_of(s, "offset") % slots for s in shards]
    skip = [hash_of(s, "skip") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for k in range(min(len(shards), left)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            table[at[k]] = k
            left -= 1
    return table


def shard_names(n: int) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def table_frame(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """(slot, shard) for each slot."""
    listed = ",".join(map(str, lookup_table(shards, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(listed), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: the first 60 bits of its MD5, modulo the number of slots."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: Column, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with slot and shard (underscores in front where these names are taken)."""
    slot, shard = unused(df, "slot", "shard")
    table = table_frame(df.sparkSession, shards, slots).toDF(slot, shard)
    return df.withColumn(slot, slot_of(key, slots)).join(F.broadcast(table), slot).select(*df.columns, slot, shard)


def write_shards(df: DataFrame, key: Column, shards: list[str], path: str, slots: int = SLOTS, slices: int = 1) -> None:
    """Write each shard's rows below ``path`` by shard, a shard in ``slices`` tasks.

    Rows are spread by their whole content and the partition they come from, so
    that neither one key nor one row repeated very often stays in one task.
    """
    placed = place(df, key, shards, slots)
    shard = placed.columns[-1]
    spread = F.pmod(F.xxhash64(*[F.col(f"`{f.name}`").cast("string") if f.dataType.typeName() in ("map", "variant") else F.col(f"`{f.name}`") for f in df.schema], F.spark_partition_id()), F.lit(slices))
    placed.drop(placed.columns[-2]).repartition(len(shards) * slices, shard, spread).write.partitionBy(shard).parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot, shard of every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(documents, F.col("doc_id"), shard_names(SHARDS))


def op6_sql() -> str:
    """The placement; the table, which is filled by a loop, is given."""
    return f"""
WITH t AS (SELECT [{",".join(map(str, lookup_table(shard_names(SHARDS), SLOTS)))}]::INTEGER[] AS shards),
s AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {SLOTS} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, t.shards[slot + 1] AS shard FROM s, t
"""


OP6_SQL = op6_sql()
