"""Shapes that the provided tables don't have: long paths, hubs, sparse and wide rows, separators, repeated keys."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.functions import vectors as V
from keelson.operators import cluster, graph, messaging, ml
from keelson.operators.collection import Collection
from keelson.plans import lineage
from keelson.sources import files


def test_components_of_a_long_path(spark):
    n = 5000
    edges = spark.range(n - 1).select(F.pmod(F.col("id") * 7919, F.lit(n)).alias("k"), "id").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = graph.connected_components(spark.range(n + 3).select("id"), edges).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {0: n, n: 1, n + 1: 1, n + 2: 1}


def test_components_and_ranks_of_a_star(spark, monkeypatch):
    monkeypatch.setattr(graph, "SPREAD", 50)  # the hub's edges are dealt to many salts
    hub = spark.range(1, 1001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    rest = spark.range(2000, 4000).select("id", (F.col("id") + 1).alias("dst")).where("id % 2 = 0").toDF("src", "dst")
    edges = hub.union(rest).union(hub.select("dst", "src"))
    label = {r["id"]: r["label"] for r in graph.connected_components(edges.select(F.col("src").alias("id")), edges).collect()}
    assert {label[i] for i in range(1001)} == {0} and all(label[i] == label[i + 1] == i for i in range(2000, 4000, 2))
    got = {r["id"]: r["pr"] for r in graph.pagerank(edges.select(F.col("src").alias("id")), edges, 3).collect()}
    pairs, pr = [(r["src"], r["dst"]) for r in edges.collect()], {}
    out = {}
    for a, _ in pairs:
        out[a] = out.get(a, 0) + 1
        pr[a] = 0.15
    for _ in range(2):
        sums = {}
        for a, b in pairs:
            if a in pr:
                sums[b] = sums.get(b, 0.0) + pr[a] / out[a]
        pr = {v: 0.85 * sums.get(v, 0.0) + 0.15 for v in pr.keys() | sums.keys()}
    assert got.keys() == pr.keys() and all(abs(got[v] - pr[v]) < 1e-9 for v in pr)


def test_ranks_of_vertices_that_are_not_listed(spark):
    # 5 is a source that nobody lists and nobody sends to: it is not there; 2 is made on arrival and sends from then on
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 3)], "src long, dst long")
    got = {r["id"]: round(r["pr"], 6) for r in graph.pagerank(spark.createDataFrame([(1,)], "id long"), edges, 3).collect()}
    assert got == {1: 0.15, 2: round(0.85 * 0.15 + 0.15, 6), 3: round(0.85 * (0.85 * 0.15 + 0.15) + 0.15, 6)}


def sparse_of(spark, x, y):
    return spark.createDataFrame([([(int(j), float(v)) for j, v in enumerate(r) if v], float(t)) for r, t in zip(x, y)], "x array<struct<fea:int,val:double>>, y double")


@pytest.mark.parametrize("width", [5, 90])
def test_sparse_and_wide_rows_learn_what_dense_ones_do(spark, width):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, width)) * (rng.random((200, width)) < 0.3)
    x[0, -1] = 1.0
    y = np.where(x @ rng.standard_normal(width) > 0, 1.0, -1.0)
    dense = spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(x, y)], "x array<double>, y double")
    for rows in (dense, sparse_of(spark, x, y)):
        w = np.zeros(width + 1)
        for _ in range(3):
            w += 0.1 / 200 * np.append(x, np.ones((200, 1)), 1).T @ (y - np.append(x, np.ones((200, 1)), 1) @ w)
        m = ml.LinearRegression(0.1).train(rows, 3)
        assert np.allclose(m.w, w)
        assert np.isclose(m.avg_error(rows), np.mean((y - np.append(x, np.ones((200, 1)), 1) @ w) ** 2))
        svm = ml.SVM(0.01).train(rows, 4)
        p, b, losses = np.zeros(width), 0.0, []
        for i in range(4):
            norm, r = p @ p, 1.0
            if norm:
                r = min(1.0, 1 / np.sqrt(norm * 0.01))
            q, norm = p * r, 100.0 if r < 1 else norm
            margin = y * (x @ q + b * r)
            near = margin < 1
            losses.append(0.005 * norm + np.maximum(0, 1 - margin).sum() / 200)
            p = q * (1 - 1 / (i + 1)) + 1 / (i + 1) / 200 / 0.01 * (x[near].T @ y[near])
            b += 1 / (i + 1) / 200 * y[near].sum()
        assert np.allclose(svm.w, p) and np.isclose(svm.b, b) and np.allclose(svm.losses, losses)
        assert np.isclose(svm.error(rows), np.mean(y * (x @ p + b) < 0))
        scaler = ml.MaxAbsScaler().fit(rows)
        assert np.allclose(scaler.x, np.abs(x).max(axis=0)) and scaler.y == 1.0
        back = scaler.inverse(scaler.transform(rows)).select("x").collect()
        assert len(back) == 200


def test_separators_at_both_ends_and_doubled(spark, tmp_path):
    for name, content in (("a", "##one##two####three##"), ("b", "four##five"), ("c", "####six")):
        (tmp_path / name).write_text(content)
    got = sorted(r["value"] for r in files.read_separated(spark, str(tmp_path), "##").collect())
    assert got == sorted(["one", "two", "", "three", "four", "five", "", "six"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # a record lies across many splits
    try:
        records = ["x" * (i % 37) for i in range(3000)]
        (tmp_path / "d").mkdir()
        (tmp_path / "d" / "long").write_text("##" + "##".join(records))
        got = files.read_separated(spark, str(tmp_path / "d"), "##")
        assert got.rdd.getNumPartitions() > 4
        assert sorted(r["value"] for r in got.collect()) == sorted(records)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_no_list_is_cut(spark):
    wide = " ".join(["1"] + [f"{i}:1" for i in range(1, 3001)])
    rows = files.parse_libsvm(spark.createDataFrame([(wide,)], "value string"))
    assert rows.select(F.size("features")).first()[0] == 3000
    near = files.parse_adjacency(spark.createDataFrame([(" ".join(map(str, range(2002))),)], "value string"))
    assert near.select(F.size("adj")).first()[0] == 2000


def test_sparse_vectors_against_numpy(spark):
    rng, rows = np.random.default_rng(2), []
    for n in (0, 1, 5, 40):
        for _ in range(6):
            pick = lambda: [(int(f), float(v)) for f, v in zip(rng.integers(0, 30, n), rng.standard_normal(n))]  # noqa: B023, E731
            rows.append((pick(), pick()))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<struct<fea:int,val:double>>, b array<struct<fea:int,val:double>>")
    got = df.select("i", V.sparse_dot(F.col("a"), F.col("b")).alias("dot"), V.to_dense(F.col("a"), 30).alias("dense"), V.sparse_subtract(F.col("a"), F.col("b"), 30).alias("gap"), V.to_dense(F.col("a"), 0).alias("none")).collect()
    for r in got:
        a, b = np.zeros(30), np.zeros(30)
        for v, pairs in ((a, rows[r["i"]][0]), (b, rows[r["i"]][1])):
            for f, x in pairs:  # repeated features are added up
                v[f] += x
        assert np.isclose(r["dot"], a @ b) and np.allclose(r["dense"], a) and np.allclose(r["gap"], a - b) and r["none"] == []


def test_jump_hashes_are_jump_hash():
    keys = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 500)
    for n in (1, 2, 7, 1000):
        assert messaging.jump_hashes(keys, n).tolist() == [messaging.jump_hash(int(k), n) for k in keys]


def test_channels_step_by_step(spark):
    state = spark.createDataFrame([(1,), (2,)], "id long")
    store = messaging.ChannelStore()
    name = store.push()
    store.push_combined("max", "top")
    with pytest.raises(ValueError):
        store.push("top")
    bag, top = store.get(name), store.get("top")
    first = spark.createDataFrame([(1, 5), (1, 3), (3, 9)], "dst long, m int")
    for c in (bag, top):
        assert not c.prepare(state, "id").where("has_msgs").count()
        c.send(first)
        assert not c.prepare(state, "id").where("has_msgs").count()  # not before the flush
        c.flush()
    assert {r["id"]: r["m"] for r in bag.prepare(state, "id").collect()} == {1: [3, 5], 2: None, 3: [9]}
    assert {r["id"]: r["m"] for r in top.prepare(state, "id", {"m": 0}).collect()} == {1: 5, 2: 0, 3: 9}
    assert top.flush().inbox is None
    store.drop("top")
    with pytest.raises(KeyError):
        store.get("top")


def test_positions_and_balance_keep_every_row(spark):
    rows = spark.range(1000).select(F.pmod(F.col("id") * 37, F.lit(500)).alias("k"), "id")
    got = Collection(rows, "k").positions().orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1000)) and [r["k"] for r in got] == sorted(r["k"] for r in got)
    lop = spark.range(90).repartition(1).union(spark.range(90, 100).repartition(1))
    even = messaging.balance(lop, 4, messaging.balance_plan)
    assert sorted(r["id"] for r in even.collect()) == list(range(100))
    assert sorted(r["count"] for r in even.groupBy(F.spark_partition_id()).count().collect()) == [25, 25, 25, 25]


def test_shared_folder(spark, monkeypatch):
    made = lineage.materialize(spark.range(5), "kept")
    assert made.count() == 5
    lineage.discard(made, spark.range(3))
    with pytest.raises(Exception):
        spark.read.parquet(made.shared_path).count()

    class Far:
        sparkContext = type("C", (), {"getCheckpointDir": staticmethod(lambda: None)})()
        conf = type("K", (), {"get": staticmethod(lambda k, d=None: {"spark.master": "spark://host:7077"}.get(k, d))})()

    with pytest.raises(ValueError):
        lineage.shared_dir(Far())


def test_power_iteration_over_any_nations(spark, tmp_path):
    # nations beyond 24, suppliers without one and of two nations; a matrix of all pairs of 30,000 suppliers would not be made in this test's time
    from keelson.catalogue import ORACLES, QUERIES
    from oracle import close, oracle_rows, spark_rows

    few = [(i, None if i == 7 else i * i % 40) for i in range(60)] + [(5, 3), (5, 11)]
    spark.createDataFrame(few, "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    names, want = oracle_rows(ORACLES["g8_power_iteration"], str(tmp_path))
    got_names, got = spark_rows(QUERIES["g8_power_iteration"](spark, str(tmp_path)))
    assert got_names == names and close(got, want) and len(got) == 60
    assert dict((r[0], r[1]) for r in got)[7] is None
    many = spark.range(30_000).select(F.col("id").alias("i"), (F.col("id") % 25).alias("k"))
    n, total = cluster.power_iteration_of_groups(many, lambda k, o: 1.0 / (1 + F.abs(k - o)), 3, 0.0).agg(F.count("*"), F.sum("v")).first()
    assert n == 30_000 and abs(total - 1) < 1e-9


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_triangles_over_blocks_and_tasks(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "BLOCK_EDGES", block)  # lists go to many blocks, and blocks to many tasks
    monkeypatch.setattr(graph, "TASK_PAIRS", 300)
    monkeypatch.setattr(graph, "_CHUNK", 50)
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-40, 60, (900, 2))] + [(-40, i) for i in range(-40, 60)] + [(1 << 40, 3), (1 << 40, 4), (3, 4)]
    ids = sorted({v for p in pairs for v in p})
    a = np.zeros((len(ids), len(ids)), dtype=int)
    for p, q in pairs:
        if p != q:
            a[ids.index(p), ids.index(q)] = a[ids.index(q), ids.index(p)] = 1
    got = graph.triangles(spark.createDataFrame(pairs, "src long, dst long"))
    assert got.first()[0] == np.trace(a @ a @ a) // 6 > 0
    assert graph.triangles(spark.createDataFrame([(1, 2), (3, 3)], "src long, dst long")).first()[0] == 0
    assert graph.triangles(spark.createDataFrame([], "src long, dst long")).first()[0] == 0


def test_triangles_make_no_row_of_a_wedge(spark):
    # a hundred hubs share 2,000 neighbours: 9.9 M wedges, of which Spark must see none
    edges = spark.range(100).crossJoin(spark.range(1000, 3000).toDF("n")).select(F.col("id").alias("src"), F.col("n").alias("dst"))
    got = graph.triangles(edges.union(spark.range(99).select("id", F.col("id") + 1)))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.first()[0] == 99 * 2000


@pytest.mark.parametrize("width", [3, 40])
def test_affinity_sends_a_point_once_to_each_block(spark, monkeypatch, width):
    monkeypatch.setattr(cluster, "BLOCK", 40)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, width)) * 0.3 + 1000.0  # far from zero, where a product of means would lose digits
    x[7], x[9] = x[8], x[10] + 1e-7
    x[:, 1] = 5.0
    points = spark.createDataFrame([(f"p{i}", v.tolist()) for i, v in enumerate(x)], "id string, x array<double>")
    got = cluster.affinity(points)
    rows = {(int(r["i"][1:]), int(r["j"][1:])): r["a"] for r in got.collect()}
    z = np.where(x.var(axis=0) > 0, (x - x.mean(axis=0)) / np.sqrt(2 * np.maximum(x.var(axis=0), 1e-300)), 0.0)
    want = np.exp(-((z[:, None, :] - z[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(want, 0.0)
    assert len(rows) == 200 * 200 and all(abs(a - want[k]) < 1e-9 for k, a in rows.items()) and rows[7, 8] == 1.0
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def jobs_of(spark, run):
    """What run() gives, and the number of Spark jobs that it took."""
    tracker = spark.sparkContext.statusTracker()
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    try:
        return run(), len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_sparse_rounds_read_rows_once(spark):
    rows = spark.createDataFrame([([(0, 1.0), (2, 2.0), (2, 1.0)], 1.0), ([], -1.0)], "x array<struct<fea:int,val:double>>, y double")
    plain = rows.select("x", F.col("y").alias("g"))
    (sums, more), jobs = jobs_of(spark, lambda: ml.by_feature(plain, 3, lambda v: F.col("g") * v, F.sum, F.col("g"), F.abs("g")))
    assert sums == [1.0, 0.0, 3.0] and more == [0.0, 2.0]
    one = jobs_of(spark, lambda: plain.groupBy("g").count().collect())[1]
    assert jobs == one  # features and the other sums in the jobs of one aggregation


def test_numbers_at_the_start_of_texts(spark):
    texts = ["12", "-3.5e2", "1.", ".5", "1e", "1.2.3", "1-2", "7x", " 8", "+4", "1e5 "]
    want = [12, -350, 1, 0.5, 1, 1.2, 1, 7, 8, 4, 1e5]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, v string")
    from keelson.functions.strings import leading_double

    assert [r[1] for r in sorted(rows.select("i", leading_double(F.col("v"))).collect())] == want
    for bad in ("", "-", "e5", "NaN", "x1"):
        with pytest.raises(Exception, match="no number"):
            spark.createDataFrame([(bad,)], "v string").select(leading_double(F.col("v"))).collect()


def test_ranks_keep_lists_and_states(spark, monkeypatch):
    made = []
    monkeypatch.setattr(graph, "materialize", lambda df, name, f=graph.materialize: made.append(name) or f(df, name))
    from keelson.plans import supersteps as loop

    monkeypatch.setattr(loop, "materialize", lambda df, name, f=loop.materialize: made.append(name) or f(df, name))
    edges = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (2, 3), (3, 1)], "src long, dst long")
    got = {r["id"]: r["pr"] for r in graph.pagerank(edges.select(F.col("src").alias("id")), edges, 4).collect()}
    pr = {1: 0.15, 2: 0.15, 3: 0.15}
    for _ in range(3):
        pr = {1: 0.85 * pr[3] + 0.15, 2: 0.85 * 2 / 3 * pr[1] + 0.15, 3: 0.85 * (pr[1] / 3 + pr[2]) + 0.15}
    assert got.keys() == pr.keys() and all(abs(got[v] - pr[v]) < 1e-12 for v in pr)
    assert made.count("superstep") == 2 and "edges" not in made  # states after all rounds but the last; edges are not written
