import pytest
from fixtures import SCHEMA, edge_docs, no_docs, rows

from keelson.llm import sharding

SHARDS = [f"s{i}" for i in range(7)]


def brute(shards, size):
    """Every shard's whole permutation, then turns."""
    prefs = []
    for s in shards:
        offset, skip = sharding._number("offset", s) % size, sharding._number("skip", s) % (size - 1) + 1
        prefs.append([(offset + j * skip) % size for j in range(size)])
        assert sorted(prefs[-1]) == list(range(size))
    table, at = [None] * size, [0] * len(shards)
    while None in table:
        for k in range(len(shards)):
            while at[k] < size and table[prefs[k][at[k]]] is not None:
                at[k] += 1
            if at[k] < size:
                table[prefs[k][at[k]]] = k
    return table


def test_table_against_whole_permutations():
    assert sharding.lookup_table(SHARDS, 101) == brute(SHARDS, 101)


def test_even_and_stable():
    one, two = sharding.lookup_table(SHARDS, 65_537), sharding.lookup_table(SHARDS[:-1], 65_537)
    counts = [one.count(k) for k in range(7)]
    assert max(counts) - min(counts) <= 1
    stay = sum(a == b for a, b in zip(one, two) if a != 6) / sum(a != 6 for a in one)
    assert stay > 0.9


def test_weights():
    table = sharding.lookup_table(["a", "b"], 10_007, {"a": 3})
    assert abs(table.count(0) / len(table) - 0.75) < 0.01


def test_wrong_parameters():
    for shards, size in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(shards, size)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 7, {"a": 0})


def test_hot_keys_are_spread(spark):
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) as key", "id")
    got = sharding.place(docs, "key", SHARDS, 101, spread="id")
    assert got.count() == 3000
    assert got.where("key = 'hot'").select("shard").distinct().count() == len(SHARDS)
    plain = sharding.place(docs, "key", SHARDS, 101)
    assert plain.where("key = 'hot'").select("shard").distinct().count() == 1


def test_edges(spark):
    got = sharding.place(edge_docs(spark), "doc_id", SHARDS, 101).collect()
    assert len(got) == 16 and all(0 <= r["shard"] < 7 and sharding.lookup_table(SHARDS, 101)[r["slot"]] == r["shard"] for r in got)
    assert len({r["slot"] for r in got if r["doc_id"] == 5}) == 1
    assert sharding.place(no_docs(spark), "doc_id", SHARDS, 101).count() == 0


def test_the_query_places_every_row(spark):
    from oracle import SF

    from keelson.llm.queries import op4_sharding

    assert op4_sharding(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert rows(["a"])[0][0] == 0 and SCHEMA
