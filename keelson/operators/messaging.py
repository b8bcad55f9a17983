"""Keyed messages between collections: push, combined push, migration, broadcast, balance and placement."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.operators.collection import Registry
from keelson.plans.lineage import discard, materialize
from keelson.plans.supersteps import fixpoint

COMBINERS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "min": F.min, "max": F.max, "hash_sum": F.sum, "keep_one": F.min}


def combine(messages: DataFrame, dst: str, combiners: dict[str, str | Callable[[Column], Column]]) -> DataFrame:
    """One row for each destination, each message column combined, first within tasks and then across them."""
    how = {c: COMBINERS[f] if isinstance(f, str) else f for c, f in combiners.items()}
    return messages.groupBy(dst).agg(*(f(F.col(c)).alias(c) for c, f in how.items()))


def dedupe(messages: DataFrame, dst: str, message: str) -> DataFrame:
    """Equal (key, message) rows once."""
    return messages.select(dst, message).distinct()


def deliver(state: DataFrame, key: str, inbox: DataFrame, dst: str, defaults: dict[str, object] | None = None, upsert: bool = True) -> DataFrame:
    """State with its inbox. Unknown destinations become rows with `defaults` (upsert); has_msgs tells who got any."""
    box = inbox.withColumnRenamed(dst, key).withColumn("has_msgs", F.lit(True))
    out = state.join(box, key, "full" if upsert else "left")
    for c, d in (defaults or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(d)))
    return out.withColumn("has_msgs", F.coalesce("has_msgs", F.lit(False)))


def push(state: DataFrame, key: str, messages: DataFrame, dst: str, message: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Each object with the bag of its messages, sorted; a bag is what the reader asked for, so use combined push where a fold will do."""
    bags = messages.groupBy(dst).agg(F.sort_array(F.collect_list(message)).alias(message))
    out = deliver(state, key, bags, dst, defaults)
    kind = out.schema[message].dataType
    return out.withColumn(message, F.coalesce(F.col(message), F.array().cast(kind)))


def push_fold(state: DataFrame, key: str, messages: DataFrame, dst: str, message: str, start: Column, merge: Callable[[Column, Column], Column], out_col: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Each object with its messages folded on arrival by `merge`, in message order."""
    got = push(state, key, messages, dst, message, defaults)
    return got.withColumn(out_col, F.aggregate(message, start, merge)).drop(message)


def push_combined(state: DataFrame, key: str, messages: DataFrame, dst: str, message: str, combiner: str | Callable[[Column], Column], zero: object = 0, defaults: dict[str, object] | None = None) -> DataFrame:
    """Each object with its combined message, `zero` where there was none."""
    out = deliver(state, key, combine(messages, dst, {message: combiner}), dst, defaults)
    return out.withColumn(message, F.coalesce(F.col(message), F.lit(zero)))


def sum_vectors(messages: DataFrame, dst: str, vector: str) -> DataFrame:
    """Element-wise sums of a destination's vectors, by position, so that nothing gathers a key's vectors."""
    parts = messages.select(dst, F.posexplode(vector).alias("pos", "x")).groupBy(dst, "pos").agg(F.sum("x").alias("x"))
    return parts.groupBy(dst).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias(vector))


def migrate(rows: DataFrame, to: Column, partitions: int) -> DataFrame:
    """Rows, with all their attributes, in the partition that `to` names."""
    return rows.withColumn("_to", to.cast("int")).repartitionById(partitions, F.col("_to")).drop("_to")


def migrate_async(rows: DataFrame, to: Callable[[Column], Column], start: Column, partitions: int) -> DataFrame:
    """Rows move on as soon as they arrive, until none wants to: the asynchronous loop, as a fixpoint of rounds.

    `start` is a row's first place, `to` maps a place to the next one; a row that it maps to its own place stays. Returns the rows in their
    last places, with `place` and the number of moves, `hops`.
    """
    state = rows.withColumn("place", start.cast("int")).withColumn("hops", F.lit(0)).withColumn("changed", F.lit(True))

    def step(now: DataFrame) -> DataFrame:
        nxt = to(F.col("place")).cast("int")
        moves = nxt != F.col("place")
        return now.withColumn("changed", moves).withColumn("hops", F.col("hops") + moves.cast("int")).withColumn("place", nxt)

    return fixpoint(state, step).drop("changed").repartitionById(partitions, F.col("place"))


# --- channels -------------------------------------------------------------------------------------


class Channel:
    """Messages of (dst, message) that wait between `send` and `flush`, and are visible from `flush` until the next one: manual stepping.

    With a combiner each destination's messages become one; without, their bag.
    """

    def __init__(self, dst: str = "dst", message: str = "m", combiner: str | Callable[[Column], Column] | None = None):
        self.dst, self.message, self.combiner = dst, message, combiner
        self.waiting: list[DataFrame] = []
        self.inbox: DataFrame | None = None

    def send(self, messages: DataFrame) -> Channel:
        self.waiting.append(messages.select(self.dst, self.message))
        return self

    def flush(self) -> Channel:
        """Delivers what waits, in place of what was delivered before; the table is written, so later rounds don't send again."""
        sent = reduce(DataFrame.union, self.waiting) if self.waiting else None
        old, self.inbox, self.waiting = self.inbox, None, []
        if sent is not None:
            how = COMBINERS[self.combiner] if isinstance(self.combiner, str) else self.combiner or (lambda c: F.sort_array(F.collect_list(c)))
            self.inbox = materialize(sent.groupBy(self.dst).agg(how(F.col(self.message)).alias(self.message)), "inbox")
        if old is not None:
            discard(old)
        return self

    def prepare(self, state: DataFrame, key: str, defaults: dict[str, object] | None = None) -> DataFrame:
        """State with the messages that the last flush delivered, and has_msgs."""
        if self.inbox is None:
            return state.withColumn(self.message, F.lit(None)).withColumn("has_msgs", F.lit(False))
        return deliver(state, key, self.inbox, self.dst, defaults)


class ChannelStore(Registry):
    """Channels by name, or by a number where no name is given. A name is taken once; getting or dropping an unknown one is an error."""

    def __init__(self):
        super().__init__("channel")

    def push(self, name: str | None = None, dst: str = "dst", message: str = "m") -> str:
        return self.create(Channel(dst, message), name)

    def push_combined(self, combiner: str | Callable[[Column], Column], name: str | None = None, dst: str = "dst", message: str = "m") -> str:
        return self.create(Channel(dst, message, combiner), name)

    def broadcast(self, name: str | None = None, clear: bool = False) -> str:
        return self.create(Dictionary(clear), name)


# --- broadcast --------------------------------------------------------------------------------------

BROADCAST_BYTES = 64 << 20


class Dictionary:
    """A key-value table that each round's entries overwrite; kept over rounds unless `clear` is set.

    Lookups broadcast it only while it has at most BROADCAST_BYTES by its plan's estimate; larger ones join by shuffle.
    """

    def __init__(self, clear: bool = False):
        self.clear, self.entries = clear, None

    def publish(self, entries: DataFrame) -> Dictionary:
        """entries: key, value; of equal keys in one round the larger value stays."""
        fresh = entries.toDF("key", "value").groupBy("key").agg(F.max("value").alias("value"))
        old = None if self.clear else self.entries
        self.entries = fresh if old is None else old.join(fresh, "key", "left_anti").unionByName(fresh)
        return self

    def _side(self) -> DataFrame:
        if self.entries is None:
            raise KeyError("nothing was published")
        size = int(str(self.entries._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return F.broadcast(self.entries) if size <= BROADCAST_BYTES else self.entries

    def find(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows whose key is known."""
        return rows.join(self._side().select(F.col("key").alias(key)), key, "left_semi")

    def lookup(self, rows: DataFrame, key: str, out: str = "value") -> DataFrame:
        """All rows, null where the key is unknown."""
        return rows.join(self._side().select(F.col("key").alias(key), F.col("value").alias(out)), key, "left")

    def get(self, rows: DataFrame, key: str, out: str = "value") -> DataFrame:
        """All rows; an unknown key is an error when the plan runs."""
        side = self._side().select(F.col("key").alias(key), F.col("value").alias(out), F.lit(True).alias("_known"))
        got = rows.join(side, key, "left")
        return got.withColumn(out, F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("unknown key "), F.col(key).cast("string")))).otherwise(F.col(out))).drop("_known")


# --- balance ----------------------------------------------------------------------------------------


def balance_plan(sizes: dict[int, int]) -> list[tuple[int, int, int]]:
    """(from, to, rows) moves that bring every partition up to the floor of the mean, largest surplus to largest need."""
    if not sizes:
        return []
    mean = sum(sizes.values()) // len(sizes)
    over = [(-(n - mean), p) for p, n in sizes.items() if n > mean]
    under = [(-(mean - n), p) for p, n in sizes.items() if n < mean]
    heapq.heapify(over)
    heapq.heapify(under)
    moves = []
    while over and under:
        a, p = heapq.heappop(over)
        b, q = heapq.heappop(under)
        n = min(-a, -b)
        moves.append((p, q, n))
        if -a > n:
            heapq.heappush(over, (a + n, p))
        if -b > n:
            heapq.heappush(under, (b + n, q))
    return moves


def balance_local_first(sizes: dict[int, int], process_of: dict[int, int]) -> list[tuple[int, int, int]]:
    """Moves within a process first, then across processes."""
    left, moves = dict(sizes), []
    for process in sorted(set(process_of.values())):
        part = {p: n for p, n in left.items() if process_of[p] == process}
        for p, q, n in balance_plan(part):
            left[p], left[q] = left[p] - n, left[q] + n
            moves.append((p, q, n))
    return moves + balance_plan(left)


def balance(rows: DataFrame, partitions: int, planner: Callable[[dict[int, int]], list[tuple[int, int, int]]] | None = None) -> DataFrame:
    """Rows evened out over partitions: round robin, or the moves of a planner."""
    if planner is None:
        return rows.repartition(partitions)
    # written, so that the rows counted and the rows moved stand in the same places
    placed = materialize(rows.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "placed")
    low = {r["_p"]: (r["n"], r["low"]) for r in placed.groupBy("_p").agg(F.count("*").alias("n"), F.min("_i").alias("low")).collect()}  # one row a partition
    sizes = {p: low.get(p, (0, 0))[0] for p in range(max(partitions, *low) if low else partitions)}
    target, taken = F.col("_p"), {p: 0 for p in sizes}
    for p, q, n in planner(sizes):
        at = F.col("_i") - F.lit(low[p][1])
        target = F.when((F.col("_p") == p) & (at >= taken[p]) & (at < taken[p] + n), F.lit(q)).otherwise(target)
        taken[p] += n
    return placed.withColumn("_to", target.cast("int")).repartitionById(partitions, F.col("_to")).drop("_p", "_i", "_to")


# --- placement --------------------------------------------------------------------------------------


def jump_hash(key: int, buckets: int) -> int:
    """Jump consistent hash of a 64-bit key (Lamping and Veach)."""
    at, nxt, key = -1, 0, key & (1 << 64) - 1
    while nxt < buckets:
        at = nxt
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        nxt = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def jump_hashes(keys: np.ndarray, buckets: int) -> np.ndarray:
    """jump_hash of many keys at once; a key leaves the loop when its bucket is found."""
    key, at, nxt = keys.astype(np.uint64).copy(), np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    live = np.flatnonzero(nxt < buckets)
    while len(live):
        at[live] = nxt[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        nxt[live] = ((at[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[nxt[live] < buckets]
    return at


class HashRing:
    """Workers by jump hash over a list in which a worker stands as often as its weight."""

    def __init__(self):
        self.entries: list[int] = []

    def insert(self, worker: int, weight: int = 1) -> HashRing:
        self.entries += [worker] * weight
        return self

    def remove(self, worker: int) -> HashRing:
        self.entries = [w for w in self.entries if w != worker]
        return self

    def lookup(self, position: int) -> int:
        if not self.entries:
            raise KeyError("the ring is empty")
        return self.entries[jump_hash(position, len(self.entries))]

    def column(self, position: Column) -> Column:
        """The worker of each position, batch by batch."""
        ring = np.array(self.entries, np.int32)

        @F.pandas_udf("int")
        def place(s: pd.Series) -> pd.Series:
            return pd.Series(ring[jump_hashes(s.to_numpy(np.int64), len(ring))])

        return place(position)


def pair_hash(a: Column, b: Column) -> Column:
    """The hash of a pair: XOR of its parts' hashes."""
    return F.xxhash64(a).bitwiseXOR(F.xxhash64(b))
