import random

import numpy as np
from fixtures import SCHEMA, WORDS, edge_docs, no_docs, rows, text_of

from keelson.llm import minhash


def sets_of(text, n):
    """The contract's shingles, as words."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(docs: list[tuple], n: int, percent: int = 80) -> dict:
    """doc_id to (set size, least reachable id), from all pairs."""
    ids, s = [d[0] for d in docs], [sets_of(d[1], n) for d in docs]
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = root(ids[i]), root(ids[j])
                parent[max(a, b)] = min(a, b)
    return {i: (len(x), root(i)) for i, x in zip(ids, s)}


def check(spark, texts: list, n: int) -> None:
    docs = rows(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(docs, SCHEMA), n).collect()}
    assert got == brute(docs, n)


def edited(rng, words: list[str], share: float) -> list[str]:
    return [rng.choice(WORDS) + "x" if rng.random() < share else w for w in words]


def test_groups_of_many_kinds(spark):
    rng, texts = random.Random(1), []
    first = text_of(rng, 60).split()
    texts += [" ".join(first)] * 5  # exact copies
    for share in (0.01, 0.02, 0.04, 0.06, 0.1, 0.2):
        texts += [" ".join(edited(rng, first, share)) for _ in range(25)]  # a large group, linked with its least or not
    chain = text_of(rng, 80).split()
    for _ in range(30):  # each near the one before, ends far apart
        chain = edited(rng, chain, 0.015)
        texts.append(" ".join(chain))
    texts += [text_of(rng, 3) for _ in range(40)] + [text_of(rng, 1) for _ in range(10)] + ["The River  stone\tgarden", "the river stone garden", "a b", "A B", "b a", None, "", " "]
    rng.shuffle(texts)
    check(spark, texts, 2)
    check(spark, texts, 5)


def test_rest_of_large_groups_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 7)
    monkeypatch.setattr(minhash, "SPREAD", 4)
    rng = random.Random(2)
    base = text_of(rng, 40).split()
    check(spark, [" ".join(edited(rng, base, rng.choice([0.0, 0.03, 0.08, 0.12]))) for _ in range(120)], 2)


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.8, 0.95):
        got = []
        for _ in range(30):
            common, own = rng.integers(1, 1 << 63, int(400 * share), dtype=np.uint64), rng.integers(1, 1 << 63, (2, 200 - int(200 * share)), dtype=np.uint64)
            a, b = (minhash.registers(np.concatenate([common, o])) for o in own)
            got.append(minhash.estimate((a == b).sum(), len(common) + own.shape[1], len(common) + own.shape[1]))
        want = len(common) / (len(common) + 2 * own.shape[1])
        assert abs(np.mean(got) - want) < 0.04


def test_edges(spark):
    got = minhash.near_duplicates(edge_docs(spark)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 16
    assert (by[0]["n_shingles"], by[0]["component_id"], by[0]["kept"]) == (0, 0, True) == (by[1]["n_shingles"], by[1]["component_id"] - 1, by[1]["kept"])
    assert by[4]["component_id"] == 3 and by[6]["component_id"] == 5 and not by[6]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"]
    assert minhash.near_duplicates(no_docs(spark)).count() == 0


def test_repeated_ids_link_all_their_texts(spark):
    rng = random.Random(9)
    x, y = text_of(rng, 60), text_of(rng, 60)
    made = [(1, x), (1, y), (2, x + " end"), (3, y + " end"), (4, text_of(rng, 60)), (1, ""), (5, y)]
    for order in (1, -1):
        docs = spark.createDataFrame(made[::order], "doc_id long, text string")
        got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect())
        assert got == [(1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 1, False)]


def test_very_long_texts(spark):
    rng = random.Random(4)
    long = text_of(rng, 40_000).split()
    check(spark, [" ".join(long), " ".join(edited(rng, long, 0.02)), " ".join(edited(rng, long, 0.3)), "a b c"], 2)
