import itertools
import random

import numpy as np
import pytest
from fixtures import SCHEMA, edge_docs, no_docs, rows, text_of
from pyspark.sql import functions as F

from keelson.llm import quality, toxicity


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    score, of, chain = rng.normal(size=9), np.array([0, 0, 0, 0, 1, 2, 2, 2, 2]), rng.normal(size=(2, 2))
    p, pairs = quality.marginals(score, of, chain)
    want, total = np.zeros(9), np.zeros((2, 2))
    for d in range(3):
        at = np.flatnonzero(of == d)
        paths = list(itertools.product((0, 1), repeat=len(at)))
        w = np.array([np.exp(sum(score[at[i]] * y[i] for i in range(len(at))) + sum(chain[y[i - 1], y[i]] for i in range(1, len(at)))) for y in paths])
        w /= w.sum()
        for y, x in zip(paths, w, strict=True):
            want[at] += x * np.array(y)
            for i in range(1, len(at)):
                total[y[i - 1], y[i]] += x
    assert np.allclose(p, want) and np.allclose(pairs, total)


def corpus(kind: str):
    rng, texts, labels = random.Random(8), [], []
    for i in range(400):
        lines = [text_of(rng, 12) + "." for _ in range(6)]
        bad = rng.random() < 0.3
        if bad and kind == "quality":
            lines[2:5] = ["### $$$ !! " * 6] * 3
        if bad and kind == "toxic":
            lines[3] += f" you {rng.choice(['dimwit', 'scoundrel', 'nitwit'])} {text_of(rng, 1)}"
        texts.append("\n".join(lines))
        labels.append(int(bad) if kind == "toxic" else int(not bad))
    return texts, labels


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_held_out_accuracy(spark, kind):
    texts, labels = corpus(kind)
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    told = spark.createDataFrame(list(enumerate(labels)), "doc_id long, label int")
    score = quality.score_quality if kind == "quality" else toxicity.score_toxicity
    got = score(docs, told).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 400 and 40 < len(held) < 120
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) >= 0.95
    assert all(r["predicted"] == int(r["score"] >= (0.3 if kind == "quality" else 0.5)) and 0 <= r["score"] <= 1 for r in got)
    # labels of the held-out fold aren't read
    flipped = told.withColumn("label", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    assert sorted(map(tuple, score(docs, flipped).collect())) == sorted(map(tuple, got))


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_edges(spark, score):
    docs = edge_docs(spark)
    for labels in ([], [(3, 1)], [(3, 1), (4, 0), (7, 1), (5, None), (None, 1), (9, 5), (3, 1), (0, 0), (1, 1)]):
        got = score(docs, spark.createDataFrame(labels, "doc_id long, label int")).collect()
        assert len(got) == 16 and all(0 <= r["score"] <= 1 for r in got)
        by = [r["score"] for r in got if r["doc_id"] in (0, 1, 2)]
        assert len(set(by)) == 1  # null, empty and wordless alike
        assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    assert score(no_docs(spark), spark.createDataFrame([(1, 1)], "doc_id long, label int")).count() == 0


def test_repeated_lines_don_t_add_up():
    texts, labels = corpus("toxic")
    model = toxicity.DictionaryPair().fit(texts, labels)
    calm = texts[labels.index(0)].split("\n")[0]
    assert model.score([(calm + "\n") * 400])[0] == pytest.approx(model.score([calm + "\n" + calm])[0], abs=0.3)
    assert model.score([(calm + "\n") * 400])[0] < 0.5


def test_copies_count_once():
    words = [["alpha", "bravo", "charlie", "delta"], ["alpha", "bravo", "charlie", "delta"], ["xylophone", "yesterday", "zeppelin"], [], []]
    assert toxicity.without_copies(words)[:1] == [0] and 1 not in toxicity.without_copies(words) and 2 in toxicity.without_copies(words)
