"""Golden values and edge cases of the library's operators."""

import pytest
from pyspark.sql import functions as F

from keelson.functions import strings as S
from keelson.functions import vectors as V
from keelson.operators import graph, messaging, ml
from keelson.operators.collection import Collection, Registry
from keelson.operators.reduce import Aggregates, RunningAggregate
from keelson.plans import supersteps
from keelson.sources import files, sinks


def bags(spark, state, sent):
    got = messaging.push(spark.createDataFrame([(i,) for i in state], "id int"), "id", spark.createDataFrame(sent, "dst int, msg int"), "dst", "msg")
    return {r["id"]: r["msg"] for r in got.collect()}


def test_push(spark):
    assert bags(spark, [], [(10, 123)]) == {10: [123]}
    many = [(10, 123), (3, 32), (10, 4), (3, 532), (10, 56)]
    assert bags(spark, [], many) == {10: [4, 56, 123], 3: [32, 532]}
    assert bags(spark, [10, 7], [(10, 456)]) == {10: [456], 7: []}
    got = messaging.push_combined(spark.createDataFrame([(7,)], "id int"), "id", spark.createDataFrame(many, "dst int, msg int"), "dst", "msg", "sum")
    assert {(r["id"], r["msg"], r["has_msgs"]) for r in got.collect()} == {(3, 564, True), (10, 183, True), (7, 0, False)}


def test_broadcast(spark):
    entries = lambda x: spark.createDataFrame(x, "key string, value string")
    d = messaging.Dictionary().publish(entries([("23", "abc"), ("45", "bbb")])).publish(entries([("a", "b")])).publish(entries([("23", "new")]))
    assert dict(d.entries.collect()) == {"23": "new", "45": "bbb", "a": "b"}
    assert dict(d.publish(entries([])).entries.collect())["45"] == "bbb"
    rows = entries([("23", ""), ("zz", "")]).select("key")
    assert d.find(rows, "key").count() == 1 and {r["v"] for r in d.lookup(rows, "key", "v").collect()} == {"new", None}
    with pytest.raises(Exception, match="unknown key"):
        d.get(rows, "key", "v").collect()
    clearing = messaging.Dictionary(clear=True).publish(entries([("23", "abc")])).publish(entries([("a", "b")]))
    assert dict(clearing.entries.collect()) == {"a": "b"}


def test_placement():
    ring = messaging.HashRing()
    for w in (0, 2, 3, 4, 5):
        ring.insert(w)
    assert [ring.lookup(i) for i in range(20)] == [0, 0, 4, 4, 2, 5, 3, 0, 5, 3, 3, 3, 2, 0, 0, 5, 3, 5, 5, 5]
    heavy = messaging.HashRing()
    for w in (0, 2, 3, 4, 5):
        heavy.insert(w, 2)
    assert [heavy.lookup(i) for i in range(20)] == [0, 4, 4, 5, 0, 3, 5, 0, 3, 4, 4, 3, 0, 0, 5, 4, 2, 5, 3, 4]
    with pytest.raises(KeyError):
        messaging.HashRing().lookup(1)


def test_balance_plans():
    sizes = {0: 10, 1: 0, 2: 1, 3: 1}
    for moves in (messaging.balance_plan(sizes), messaging.balance_local_first(sizes, {0: 0, 1: 0, 2: 1, 3: 1})):
        left = dict(sizes)
        for p, q, n in moves:
            left[p], left[q] = left[p] - n, left[q] + n
        assert min(left.values()) >= 3 and sum(left.values()) == 12
    assert messaging.balance_plan({}) == []


def test_balance_with_a_planner(spark):
    got = messaging.balance(spark.range(0, 40, 1, 4).coalesce(2), 4, messaging.balance_plan)
    assert sorted(r[0] for r in got.collect()) == list(range(40))


def test_collections(spark):
    c = Collection(spark.createDataFrame([(k,) for k in range(9, -1, -1)], "key int"), "key").create_attribute("i", 5, "int")
    assert [r["key"] for r in Collection(c.rows.coalesce(1), "key").sort().rows.collect()] == list(range(10))
    assert c.shuffle(3).rows.agg(F.count("*"), F.sum("key")).first()[:] == (10, 45)
    left = c.delete(spark.createDataFrame([(3,), (7,)], "k int"))
    assert left.size() == 8 and left.find(3) is None and left.find(5)["i"] == 5 and left.at(3)["key"] == 4
    with pytest.raises(IndexError):
        left.at(8)
    with pytest.raises(ValueError):
        c.create_attribute("i", 0, "int")
    with pytest.raises(KeyError):
        c.attribute("none")
    assert c.drop_attribute("i")[1] == 1 and c.drop_attribute("none")[1] == 0
    assert {r["i"] for r in c.add(spark.createDataFrame([(11,)], "key int")).rows.collect()} == {5}


def test_registry():
    r = Registry()
    r.create("x", "a")
    with pytest.raises(ValueError):
        r.create("y", "a")
    r.drop("a")
    with pytest.raises(KeyError):
        r.drop("a")


def test_aggregates():
    a, b = RunningAggregate(0), RunningAggregate(0, reset=True)
    both = Aggregates(a, b)
    for i in range(1, 4):
        a.update_value(1)
        b.update_value(i)
        assert a.get() == i - 1
        both.sync()
        assert (a.get(), b.get()) == (i, i)
    both.sync()
    assert (a.get(), b.get()) == (3, 0)
    a.active = False
    a.update_value(4)
    both.sync()
    assert a.get() == 3
    both.activate_all()
    both.sync()
    assert a.get() == 7


def written(tmp_path, data: bytes) -> str:
    path = tmp_path / "in.txt"
    path.write_bytes(data)
    return f"file://{path}"


def test_scans(spark, tmp_path):
    read = lambda df: [r["value"] for r in df.collect()]
    assert read(files.read_lines(spark, written(tmp_path, b"\na\r\n\nb c\nlast"))) == ["a\r", "b c", "last"]
    assert read(files.read_separated(spark, written(tmp_path, b"##a\nb##c##"), "##")) == ["a\nb", "c"]
    assert [bytes(r["value"]) for r in files.read_chunks(spark, written(tmp_path, b"abcdefg"), 3).orderBy("index").collect()] == [b"abc", b"def", b"g"]
    assert read(files.read_between(spark, written(tmp_path, b"x<t>a\nb</t>y<t></t>"), "<t>", "</t>")) == ["a\nb", ""]
    with pytest.raises(Exception, match="data format error"):
        files.read_between(spark, written(tmp_path, b"<t>a"), "<t>", "</t>").collect()
    for bad in ("ftp://x", "mongo://x"):
        with pytest.raises(ValueError):
            files.resolve(bad)
    with pytest.raises(ValueError):
        files.read_binary_files(spark, str(tmp_path), "(")
    with pytest.raises(ValueError):
        files.load_points(spark, "x", "arff")


def test_parsers(spark, tmp_path):
    rows, n = files.read_libsvm(spark, written(tmp_path, b"1 1:0.5 3:2\n-1\t2:1e1\n"))
    assert n == 3 and [(r["label"], [tuple(f) for f in r["features"]]) for r in rows.orderBy("label").collect()] == [(-1.0, [(1, 10.0)]), (1.0, [(0, 0.5), (2, 2.0)])]
    adjacent = files.parse_adjacency(spark.createDataFrame([("1 2 5 6",), ("7 0",)], "value string")).orderBy("id").collect()
    assert [(r["id"], r["adj"]) for r in adjacent] == [(1, [5, 6]), (7, [])]
    assert spark.range(1).select(S.leading_int(F.lit("12ab"))).first()[0] == 12
    w = sinks.DocumentWriter()
    assert not w.commit("") and not w.commit("{}")
    with pytest.raises(ValueError):
        w.flush_all()


def test_vectors(spark):
    one = spark.sql("select array(3.0D, 4.0D) a, array(0.0D, 0.0D) b, array(1.0D) c, array(named_struct('fea', 0, 'val', 1.0D), named_struct('fea', 0, 'val', 2.0D)) s")
    a, b, c, s = (F.col(x) for x in "abcs")
    assert one.select(V.distance(a, b), V.squared_distance(a, b), V.dense_sparse_dot(a, s), V.to_dense(s, 2), V.resize(a, 3), V.divide_by(a, b)).first()[:] == (5.0, 25.0, 9.0, [3.0, 0.0], [3.0, 4.0, 0.0], [3.0, 4.0])
    with pytest.raises(Exception, match="differ in length"):
        one.select(V.dot(a, c)).collect()


def test_graphs(spark):
    edges = lambda x: spark.createDataFrame(x, "src long, dst long")
    e = edges([(1, 2), (1, 2), (1, 3)])
    ranks = {r["id"]: r["pr"] for r in graph.pagerank(e.select(F.col("src").alias("id")), e, 2).collect()}
    assert ranks == pytest.approx({1: 0.15, 2: 0.15 + 0.85 * 0.1, 3: 0.15 + 0.85 * 0.05})
    assert graph.pagerank(e.select(F.col("src").alias("id")), e, 1).collect()[0][:] == (1, 0.15)
    both = e.union(e.select("dst", "src"))
    assert {r["label"] for r in graph.min_labels(both.select(F.col("src").alias("id")), both).collect()} == {1}
    assert graph.triangles(edges([(1, 2), (2, 3), (3, 1), (1, 1), (3, 4), (2, 1)])).first()[0] == 1
    assert graph.triangles(edges([])).first()[0] == 0


class Rounds:
    """Stands for a state that settles in round `last`."""

    def __init__(self, n: int, last: int):
        self.n, self.last = n, last
        self.where = self.limit = lambda _: self

    def count(self) -> int:
        return int(self.n < self.last)


def test_fixpoint_is_settled(spark, monkeypatch):
    monkeypatch.setattr(supersteps, "materialize", lambda state, _: state)
    step = lambda s: Rounds(s.n + 1, s.last)
    assert supersteps.fixpoint(Rounds(0, 1500), step).n == 1500
    assert supersteps.fixpoint(Rounds(0, 9), step, most=9).n == 9
    with pytest.raises(RuntimeError, match="not settled"):
        supersteps.fixpoint(Rounds(0, 9), step, most=8)
    assert supersteps.fixpoint(Rounds(0, 9), step, seconds=0.0).n < 9


def test_labels_of_a_path(spark):
    path = spark.range(40).selectExpr("id AS src", "id + 1 AS dst")
    both = path.union(path.select("dst", "src"))
    got = graph.min_labels(both.select(F.col("src").alias("id")), both).collect()
    assert len(got) == 41 and {r["label"] for r in got} == {0}


def test_learning_errors(spark):
    rows = spark.createDataFrame([([1.0], 1.0)], "x array<double>, y double")
    for wrong in (ml.Regression(rate=0.0), ml.Regression(rate=0.1)):
        with pytest.raises(ValueError):
            wrong.train(rows, 1)
    with pytest.raises(ValueError):
        ml.Regression().avg_error(rows)
    with pytest.raises(ValueError):
        ml.Regression().predict(rows)
    with pytest.raises(ValueError):
        ml.SVM().train(rows.withColumn("y", F.lit(3.0)), 1)
    line = spark.createDataFrame([([float(i) / 10], 2.0 * i / 10 + 1) for i in range(10)], "x array<double>, y double")
    m = ml.LinearRegression(0.5).train_test(line, line, 60)
    assert m.score(line) > 0.95 and m.history[-1] < m.history[0]
