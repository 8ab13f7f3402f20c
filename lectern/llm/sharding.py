"""Shard placement by a permutation-filled lookup table (operator 3).

Each shard has its own permutation of the slots of a prime-sized table. Shards
take turns; in its turn a shard claims the first slot of its permutation that is
still free. So slots differ by at most one between shards, and a change of the
shard set moves few slots. The table has a fixed size whatever the data, so it is
broadcast, and placing a row costs one hash and one lookup, all in the JVM.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = tuple(f"shard-{i:03d}" for i in range(32))
TABLE_SIZE = 3203  # prime, a hundred slots for each shard
MAX_TABLE_SIZE = 1 << 20  # bound of what is broadcast: 1 M slots, about 20 MB


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _digest(text: str, seed: str) -> int:
    return int(hashlib.md5(f"{seed}:{text}".encode()).hexdigest()[:15], 16)


def lookup_table(shards=SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """Shard number of each slot.

    A shard's preference order is offset, offset + skip, ... modulo the prime size.
    """
    shards = list(shards)
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if not _is_prime(size) or not len(shards) <= size <= MAX_TABLE_SIZE:
        raise ValueError("the table size must be a prime between the number of shards and MAX_TABLE_SIZE")
    at = [_digest(s, "offset") % size for s in shards]
    skip = [_digest(s, "skip") % (size - 1) + 1 for s in shards]
    slots = [-1] * size
    for turn in range(size):
        k = turn % len(shards)
        while slots[at[k]] >= 0:
            at[k] = (at[k] + skip[k]) % size
        slots[at[k]] = k
    return slots


def slot_of(key, size: int = TABLE_SIZE):
    """Slot of a key column: 60 bits of its MD5, modulo the table size. Null keys hash as the empty string."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint"), F.lit(size)).cast("int")


def table_frame(spark: SparkSession, shards=SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """The lookup table as a local relation of two INT columns."""
    import pyarrow as pa

    slots = lookup_table(shards, size)
    return spark.createDataFrame(pa.table({"_slot": pa.array(range(size), pa.int32()), "_shard": pa.array(slots, pa.int32())}))


def place(df: DataFrame, key: str = "doc_id", shards=SHARDS, size: int = TABLE_SIZE, shard_col: str = "shard", slot_col: str | None = None) -> DataFrame:
    """Every row of df with its shard's number.

    Equal keys, repeated rows and null keys (as the empty string) land together; all
    columns stay, but a column already named `shard_col` or `slot_col` is replaced.
    An empty table gives an empty result. Rows do not move: the only exchange is the
    broadcast of the fixed-size table.
    """
    spark = df.sparkSession
    keep = [c for c in df.columns if c not in {shard_col, slot_col}]
    body = df.select(F.struct(*[df[f"`{c}`"] for c in keep]).alias("_row"), slot_of(df[f"`{key}`"], size).alias("_key_slot"))
    table = F.broadcast(table_frame(spark, shards, size))
    placed = body.join(table, body["_key_slot"] == table["_slot"])
    out = [F.col("_row")[c].alias(c) for c in keep]
    if slot_col:
        out.append(F.col("_slot").alias(slot_col))
    return placed.select(*out, F.col("_shard").alias(shard_col))


def oracle_sql(shards=SHARDS, size: int = TABLE_SIZE) -> str:
    """DuckDB SQL that fills the table itself, slot by slot, and places `documents`."""
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(shards))
    return f"""
    WITH RECURSIVE shards(k, name) AS (VALUES {names}),
    prefs AS (
        SELECT list(('0x' || substr(md5('offset:' || name), 1, 15))::BIGINT % {size} ORDER BY k) AS off,
               list(('0x' || substr(md5('skip:' || name), 1, 15))::BIGINT % {size - 1} + 1 ORDER BY k) AS skip
        FROM shards),
    fill(turn, slot, owner, taken) AS (
        SELECT 0, off[1], 0, [off[1]] FROM prefs
        UNION ALL
        SELECT turn + 1, next_slot, next_owner, list_append(taken, next_slot)
        FROM (
            SELECT f.turn, f.taken, (f.turn + 1) % {len(shards)} AS next_owner,
                   list_filter(
                       list_transform(range(0, {size}), lambda j: (p.off[(f.turn + 1) % {len(shards)} + 1] + j * p.skip[(f.turn + 1) % {len(shards)} + 1]) % {size}),
                       lambda s: NOT list_contains(f.taken, s))[1] AS next_slot
            FROM fill f, prefs p WHERE f.turn + 1 < {size}))
    SELECT d.doc_id, f.slot::INT AS slot, f.owner::INT AS shard
    FROM documents d
    JOIN fill f ON f.slot = ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 15))::BIGINT % {size}
    """
