"""Graph operators over edges (src, dst)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.plans.lineage import discard, materialize
from keelson.plans.supersteps import fixpoint, supersteps

DAMPING, REST = 0.85, 0.15


SPREAD = 100_000


def _ranked(vertices: DataFrame, edges: DataFrame, iters: int, update: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """id, pr after iters - 1 rounds; `update` makes a new rank of the inbox's sum (null: no message), whether a listed vertex has out-edges, and the old rank.

    A source of more than SPREAD edges has them spread over salts, SPREAD to each, and its state is sent once to each, so that no task holds a
    hub. Edges are dealt once, as a list for each source and salt, and kept until the result has been written; rounds join lists, not edges,
    and move states and sums only. Each round's states are written, as the next reads them twice. Vertices that are not listed are there
    from their first message on, with rank 0 before it.
    """
    degree = materialize(edges.groupBy("src").agg(F.count("*").alias("deg")).withColumn("salts", F.ceil(F.col("deg") / SPREAD).cast("int")), "degrees")
    hubs = F.broadcast(degree.where("salts > 1").select("src", "salts"))  # a row for SPREAD edges at most
    salted = edges.select("src", "dst").join(hubs, "src", "left").select("src", F.coalesce(F.pmod(F.xxhash64("dst"), F.col("salts")), F.lit(0)).cast("int").alias("salt"), "dst")
    counted = salted.repartition("src", "salt").groupBy("src", "salt", "dst").agg(F.count("*").alias("n"))  # edges that stand often: one entry
    dealt = counted.groupBy("src", "salt").agg(F.collect_list(F.struct("dst", "n")).alias("to")).persist()
    listed = vertices.select("id").distinct().withColumn("listed", F.lit(True))
    start = listed.join(degree.withColumnRenamed("src", "id"), "id", "full").select("id", F.coalesce("listed", F.lit(False)).alias("listed"), "deg", "salts")
    start = start.select("id", F.when(F.col("listed"), F.lit(REST)).otherwise(F.lit(0.0)).alias("pr"), F.col("listed").alias("there"), "listed", "deg", "salts")

    def step(state: DataFrame, _: int) -> DataFrame:
        out = state.where("there and deg > 0").select(F.col("id").alias("src"), (F.col("pr") / F.col("deg")).alias("sent"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        inbox = dealt.join(out, ["src", "salt"]).select(F.explode("to").alias("e"), "sent").groupBy(F.col("e.dst").alias("id")).agg(F.sum(F.col("sent") * F.col("e.n")).alias("m"))
        got = state.join(inbox, "id", "full")
        there = F.coalesce("there", F.lit(False)) | F.col("m").isNotNull()
        sends = F.coalesce("listed", F.lit(False)) & (F.coalesce("deg", F.lit(0)) > 0)
        pr = F.when(there, update(F.col("m"), sends, F.coalesce("pr", F.lit(0.0)))).otherwise(F.lit(0.0))
        return got.select("id", pr.alias("pr"), there.alias("there"), F.coalesce("listed", F.lit(False)).alias("listed"), "deg", "salts")

    done = materialize(supersteps(materialize(start, "ranks"), step, max(0, iters - 1), cut_every=1).where("there").select("id", "pr"), "ranks")
    dealt.unpersist()
    return done


def pagerank(vertices: DataFrame, edges: DataFrame, iters: int) -> DataFrame:
    """id, pr after iters - 1 updates (the first round only sends). Not normalised, no redistribution from sinks; edges count as often as they stand.

    vertices: id, those that exist at the start; destinations that do not are made on arrival. Doubles.
    """
    return _ranked(vertices, edges, iters, lambda m, sends, pr: DAMPING * F.coalesce(m, F.lit(0.0)) + REST)


def pagerank_attribute(vertices: DataFrame, edges: DataFrame, iters: int) -> DataFrame:
    """As pagerank, but vertices without out-edges are left alone: listed ones keep 0.15, those made on arrival 0."""
    return _ranked(vertices, edges, iters, lambda m, sends, pr: F.when(sends, DAMPING * F.coalesce(m, F.lit(0.0)) + REST).otherwise(pr))


# --- components -------------------------------------------------------------------------------------


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large star: link larger neighbours of u to the least of u and its neighbours; small star: the rest, and u."""
    both = links.union(links.select(F.col("v"), F.col("u"))).toDF("u", "v") if large else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # the minima are written, so that both sides of the join are plain exchanges: Spark then splits a hub's links over tasks
    low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
    joined = both.join(low, "u")
    out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.toDF("u", "v"))
    made = materialize(out.where("u <> v").distinct(), "links")
    discard(low)
    return made


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links, any direction, to (id, component) of every linked id; component is its least id.

    Alternating large-star and small-star rounds, so rounds grow with the logarithm of a component's size and not with its longest path.
    No task holds a component, links never reach the driver, and a round's tables are deleted once the next is written.
    """
    now = materialize(links.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        half = _star(now, True)
        after = _star(half, False)
        discard(now, half)
        now = after
        # every link points from a larger id to a smaller; done when the smaller ones are roots and links no longer change
        fresh = now.select(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        if tuple(fresh) == mark:
            break
        mark = tuple(fresh)
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label: the least id of each vertex's component, edges taken in either direction; vertices without edges label themselves."""
    every = vertices.select("id").union(edges.select("src")).union(edges.select("dst")).distinct()
    found = components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return every.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("label"))


def min_labels(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label: the least label that reaches a vertex along out-edges, one hop a round; on symmetric graphs connected_components is the faster way to the same.

    Only vertices whose label has changed send, and both sides of the join are plain exchanges, so Spark splits a hub's links over tasks.
    """
    links = materialize(edges.select("src", "dst").distinct(), "edges")
    low = links.groupBy("src").agg(F.min("dst").alias("m")).withColumnRenamed("src", "id")
    every = vertices.select("id").union(links.select("dst")).distinct()
    start = every.join(low, "id", "left").select("id", F.least("id", F.coalesce("m", "id")).alias("label"), F.lit(True).alias("changed"))

    def step(state: DataFrame) -> DataFrame:
        moved = state.where("changed")
        sent = links.join(moved, links["src"] == moved["id"]).select(F.col("dst").alias("id"), "label").groupBy("id").agg(F.min("label").alias("m"))
        got = state.join(sent, "id", "left")
        return got.select("id", F.least("label", F.coalesce("m", "label")).alias("label"), F.coalesce(F.col("m") < F.col("label"), F.lit(False)).alias("changed"))

    return fixpoint(materialize(start, "labels"), step).select("id", "label")


#: Edges of a block of triangles(), and sums of a task: elements of lists that it compares or is sent.
BLOCK_EDGES, TASK_PAIRS, TASK_SENT = 2_000_000, 50_000_000, 8_000_000
_CHUNK = 1_000_000


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of an Arrow list column without nulls."""
    return np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)


def _asks(batch, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, block) once for every block that has a vertex of the row's list."""
    n, to = _flat(batch.column("near"))
    key = np.unique(np.repeat(np.arange(len(n)), n) * (len(bounds) + 1) + np.searchsorted(bounds, to))
    return key // (len(bounds) + 1), key % (len(bounds) + 1)


class _Block:
    """The outgoing lists of a block's vertices."""

    def __init__(self, us: list[np.ndarray], lengths: list[np.ndarray], values: list[np.ndarray]):
        u, n, to = np.concatenate(us), np.concatenate(lengths), np.concatenate(values)
        at = np.argsort(u)
        self.vertices, self.starts, self.lengths = u[at], (np.cumsum(n) - n)[at], n[at]
        self.ends = np.unique(to)
        self.codes = np.searchsorted(self.ends, to)

    @staticmethod
    def _find(among: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(among, what), len(among) - 1)
        return at, among[at] == what

    def common(self, n: np.ndarray, to: np.ndarray) -> int:
        """Over sorted lists, of lengths n: for each of their vertices in this block, how many vertices its own list shares with the list."""
        row, w = np.repeat(np.arange(len(n)), n), len(self.ends)
        at, there = self._find(self.ends, to)
        keys = row[there] * w + at[there]
        at, there = self._find(self.vertices, to)
        row, at = row[there], at[there]
        if not len(keys) or not len(at):
            return 0
        size = self.lengths[at]
        end, found, i = np.cumsum(size), 0, 0
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + _CHUNK, "right")))
            s = size[i:j]
            before = np.cumsum(s) - s
            pairs = np.repeat(row[i:j] * w, s) + self.codes[np.repeat(self.starts[at[i:j]] - before, s) + np.arange(s.sum())]
            found += int(self._find(keys, pairs)[1].sum())
            i = j
        return found


def triangles(edges: DataFrame) -> DataFrame:
    """One row, n_triangles, of the undirected simple graph that the edges make.

    Edges point from the end of lower (degree, id), so no vertex has more than sqrt(2 m) outgoing; a triangle is an edge (u, v) and a vertex
    that both lists hold. Wedges are never rows: vertices lie in blocks, ranges of ids with about BLOCK_EDGES outgoing edges, and a list goes
    once to each block that has some of its vertices, where it meets their lists. Where near ids are linked that is once or twice; at
    worst it is once for each vertex of the list. A block that is asked much is given to several tasks, which share the asking lists.
    """
    simple = edges.where("src <> dst").select(F.least("src", "dst").cast("long").alias("a"), F.greatest("src", "dst").cast("long").alias("b")).distinct()
    degree = simple.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("d"))
    ends = simple.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
    forward = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    directed = ends.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("v"), F.least("da", "db").alias("d"))
    lists = materialize(directed.groupBy("u").agg(F.first("d").alias("d"), F.sort_array(F.collect_list("v")).alias("near")), "lists")
    m = lists.agg(F.sum(F.size("near"))).first()[0] or 0
    blocks = -(-m // BLOCK_EDGES)
    cuts = [k / blocks for k in range(1, blocks)]
    bounds = np.array(sorted(set(lists.select("u", F.explode("near")).agg(F.percentile_approx("u", cuts, 100 * blocks)).first()[0] if cuts else [])), dtype=np.int64)

    def loads(batches):
        import pyarrow as pa

        pairs, sent = np.zeros(len(bounds) + 1), np.zeros(len(bounds) + 1)
        for batch in batches:
            n, _ = _flat(batch.column("near"))
            np.add.at(pairs, np.searchsorted(bounds, batch.column("u").to_numpy()), (batch.column("d").to_numpy() - n) * n)  # lists that ask for it, times its own
            row, block = _asks(batch, bounds)
            np.add.at(sent, block, n[row])
        yield pa.RecordBatch.from_pydict({"block": np.arange(len(pairs), dtype=np.int32), "pairs": pairs.astype(np.int64), "sent": sent.astype(np.int64)})

    load = {r["block"]: max(1, -(-r["pairs"] // TASK_PAIRS), -(-r["sent"] // TASK_SENT)) for r in lists.mapInArrow(loads, "block int, pairs long, sent long").groupBy("block").agg(F.sum("pairs").alias("pairs"), F.sum("sent").alias("sent")).collect()}
    tasks = np.array([load.get(b, 1) for b in range(len(bounds) + 1)])
    first = np.cumsum(tasks) - tasks

    def deal(batches):
        import pyarrow as pa

        def rows(batch, at, task, asks):
            for i in range(0, len(at), 4096):
                part = batch.take(pa.array(at[i : i + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(task[i : i + 4096].astype(np.int32)), pa.array(np.full(part.num_rows, asks)), part.column("u"), part.column("near")], ["task", "asks", "u", "near"])

        for batch in batches:
            u = batch.column("u").to_numpy()
            block = np.searchsorted(bounds, u)
            n = tasks[block]
            yield from rows(batch, np.repeat(np.arange(len(u)), n), np.repeat(first[block] - np.cumsum(n) + n, n) + np.arange(n.sum()), False)
            row, block = _asks(batch, bounds)
            # lists are dealt to a block's tasks by a mixed id, whatever steps ids have
            yield from rows(batch, row, first[block] + ((u[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % tasks[block], True)

    def meet(batches):
        import pyarrow as pa

        now, held, block, found = None, [], None, 0
        for batch in batches:
            task, asks = batch.column("task").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero((np.diff(task) != 0) | (asks[1:] != asks[:-1])) + 1), len(task)]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if i == j:
                    continue
                if task[i] != now:
                    now, held, block = task[i], [], None
                part = batch.slice(i, j - i)
                n, to = _flat(part.column("near"))
                if not asks[i]:  # a task's own lists come before those that ask
                    held.append((part.column("u").to_numpy().copy(), n, to.copy()))
                elif held:
                    block = block or _Block(*zip(*held, strict=True))
                    found += block.common(n, to)
        yield pa.RecordBatch.from_pydict({"n": np.array([found], dtype=np.int64)})

    dealt = lists.mapInArrow(deal, "task int, asks boolean, u long, near array<long>").repartitionById(int(tasks.sum()), "task").sortWithinPartitions("task", "asks")
    return dealt.mapInArrow(meet, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_triangles"))
