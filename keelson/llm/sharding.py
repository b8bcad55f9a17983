"""Placement on shards by a permutation-filled lookup table.

Every shard walks its own permutation of the slots of a prime-sized table; shards take turns, each claiming the
first free slot of its preference order, until the table is full. Weights give more turns. A row's slot is
its key's hash modulo the table's size. The table has `size` rows whatever the data, so it is broadcast, and a
row's placement is one hash and one lookup: no shuffle. When a shard goes, few other rows move.

Hot keys: a key with more than `hot_share` of all rows is spread: rows of it are placed by (key, spread column),
so no shard gets a whole hot key. There are at most 1 / hot_share of them.

Edge cases: null keys are placed by the spread column (or slot of the empty key if there is none); repeated
rows go to one place; shards with equal preferences take their turns in the order given; keys of any length are hashed whole; further
columns are left out; an empty table gives no rows; fewer than one shard or a size that is not prime raise.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 65_537


def _number(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=8).digest(), "big")


def lookup_table(shards: list[str], size: int = SIZE, weights: dict[str, int] | None = None) -> list[int]:
    """The shard index of every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if size < len(shards) or size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"the table's size must be a prime of at least {len(shards)}: {size}")
    turns = [int((weights or {}).get(s, 1)) for s in shards]
    if min(turns) < 1:
        raise ValueError("weights must be 1 or more")
    at = [_number("offset", s) % size for s in shards]
    skip = [_number("skip", s) % (size - 1) + 1 for s in shards]
    table, left = [-1] * size, size
    while left:
        for k in range(len(shards)):
            for _ in range(turns[k]):
                if not left:
                    break
                while table[at[k]] >= 0:
                    at[k] = (at[k] + skip[k]) % size
                table[at[k]] = k
                left -= 1
    return table


def hot_keys(df: DataFrame, key: str, hot_share: float) -> list:
    """Keys with more than that share of the rows: at most 1 / hot_share."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [r[0] for r in counts.where(F.col("n") > hot_share * total).select(key).collect()] if total else []


def place(df: DataFrame, key: str, shards: list[str], size: int = SIZE, weights: dict[str, int] | None = None, spread: str | None = None, hot_share: float = 0.02) -> DataFrame:
    """key and spread columns, slot, shard. `spread` names the column that splits hot and null keys."""
    table = lookup_table(shards, size, weights)
    keep = list(dict.fromkeys(c for c in (key, spread) if c))
    rows = df.select(*keep)
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    if spread:
        other = F.coalesce(F.col(spread).cast("string"), F.lit(""))
        hot = hot_keys(rows, key, hot_share)
        is_hot = F.col(key).isNull() | (F.col(key).isin(hot) if hot else F.lit(False))
        text = F.when(is_hot, F.concat_ws("\x1f", text, other)).otherwise(text)
    slots = df.sparkSession.createDataFrame(list(enumerate(table)), "slot int, shard int")
    placed = rows.withColumn("slot", F.pmod(F.xxhash64(text), F.lit(size)).cast("int"))
    return placed.join(F.broadcast(slots), "slot").select(*keep, "slot", "shard")  # `size` rows, by parameter
