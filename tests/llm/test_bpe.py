import hashlib
import random

import pytest
from fixtures import SCHEMA, edge_docs, edge_texts, no_docs, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import bpe
from keelson.llm.queries import vocabulary


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.no_padding()
    t.no_truncation()
    return t


def same(library, text: str) -> None:
    mine = bpe.tokenizer(vocabulary())
    ids = library.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == ids
    assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_any_text(library, text):
    same(library, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aAbé'sS tl<|>endoftxsrİﬁ\n0129.,!?…́ß", max_size=80))
def test_likely_texts(library, text):
    same(library, text)


def test_samples(library):
    rng = random.Random(1)
    for text in ["", "a", "it's we'll I'D", "<|endoftext|>x<|startoftext|>", "<|endoftext|", "ＡＢＣ １２", "İstanbul", "é", "x" * 3000, "ab" * 3000, "日本語 テキスト", "😀 🇩🇪", *("".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(20))]:
        same(library, text)


def brute(symbols: list[int], merges: dict) -> list[int]:
    """Scans for the leftmost pair of lowest rank until none is left."""
    symbols = list(symbols)
    while len(symbols) > 1:
        best = min(((merges[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in merges), default=None)
        if best is None:
            break
        i = best[1]
        symbols[i : i + 2] = [merges[symbols[i], symbols[i + 1]][1]]
    return symbols


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=2, max_size=40), st.integers(0, 1000))
def test_the_tree_against_scanning(symbols, seed):
    rng = random.Random(seed)
    merges, nxt = {}, 4
    for rank in range(12):
        pair = (rng.randrange(nxt), rng.randrange(nxt))
        if pair not in merges:
            merges[pair] = (rank, nxt)
            nxt += 1
    assert bpe.PairTree(list(symbols), merges).run() == brute(symbols, merges)


def test_one_long_word_is_not_quadratic():
    import time

    began = time.time()
    bpe.tokenizer(vocabulary()).encode("abcdefghij" * 20_000)
    assert time.time() - began < 30


def test_edges(spark, library):
    got = bpe.encode_decode(edge_docs(spark), vocabulary(), with_ids=True).collect()
    texts = edge_texts()
    assert len(got) == len(texts) + 2
    for r in got:
        text = (texts[r["doc_id"]] if r["doc_id"] is not None else "two words") or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids"]) == (len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_decode(no_docs(spark), vocabulary()).count() == 0


def test_documents(spark, library):
    from oracle import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for r, d in zip(bpe.encode_decode(docs, vocabulary()).orderBy("doc_id").collect(), docs.orderBy("doc_id").collect(), strict=True):
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_ids_keep_their_rows(spark):
    got = bpe.encode_decode(spark.createDataFrame(rows(["a", "b", "a"]), SCHEMA), vocabulary()).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == [0, 1, 2] and got[0]["ids_sha256"] == got[2]["ids_sha256"] != got[1]["ids_sha256"]
