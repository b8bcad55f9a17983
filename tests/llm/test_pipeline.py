import random

from fixtures import SCHEMA, edge_docs, no_docs, rows, text_of
from oracle import oracle_rows, spark_rows, SF
from test_minhash import brute as brute_groups

import corpus_pipeline as C
from keelson.llm import bpe, decontam, pii
from keelson.llm.queries import ORACLES, QUERIES, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def made(spark, tmp_path):
    rng = random.Random(12)
    items = [(i, text_of(rng, 30)) for i in range(3)]
    texts = [text_of(rng, 60) + (" write to a.b@c.de or +1 650 555 0100" if i % 5 == 0 else "") for i in range(30)]
    texts += texts[:4] + [t + " end" for t in texts[4:8]] + [f"{text_of(rng, 50)} {items[1][1]} {text_of(rng, 50)}", items[2][1], "12345", "", None]
    docs = [(i, t, "en", "h.uk", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return texts, items


def test_run_against_brute_force(spark, tmp_path):
    texts, items = made(spark, tmp_path)
    left = [(i, t) for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")]
    groups = brute_groups(left, 5)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    index = decontam.Index(items)
    left = [(i, t) for (i, t), hit in zip(left, decontam.contaminated(index, [t for _, t in left], 0.35, 0.6, 0.6)) if not hit]
    tagger, coder, want = pii.trained(), bpe.tokenizer(vocabulary()), {}
    for i, t in left:
        base = pii.base_spans(t)
        clean = pii.redacted(t, sorted(base + pii.tag_texts(tagger, [t], [base])[0]))
        want[i] = len(coder.encode(clean))
    got = C.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want and len(got) == len(want)
    assert len(want) == 30  # copies, benchmark passages and texts without letters are gone; clean documents stay


def test_stages_return_documents(spark, tmp_path):
    made(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == COLUMNS and dict(docs.dtypes)["n_chars"] == "bigint", name
    clean = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert clean[0].endswith(" write to [EMAIL] or [PHONE]")


def test_stages_on_edges(spark, tmp_path):
    made(spark, tmp_path)
    for docs, n in ((edge_docs(spark), 16), (no_docs(spark), 0)):
        for name, stage in C.STAGES:
            got = stage(spark, docs, str(tmp_path)).collect()
            if name in ("pii", "bpe"):
                assert len(got) == n
            if name == "near_duplicates":
                ids = [r["doc_id"] for r in got]
                assert len(ids) == len(set(ids)) and None not in ids


def test_rejected_rows_don_t_return_with_another_of_their_id(spark, tmp_path):
    """A null and a letterless row share a doc_id with a good one: the good text stays, in either order."""
    made(spark, tmp_path)
    good = text_of(random.Random(3), 40)
    for order in (1, -1):
        extra = [(500, None, "en", "h.uk", 0), (500, good, "en", "h.uk", len(good)), (500, "123", "en", "h.uk", 3)][::order]
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        docs = docs.union(spark.createDataFrame(extra, docs.schema))
        docs = C.identify_language(spark, docs, str(tmp_path))
        assert [r["text"] for r in docs.where("doc_id = 500").collect()] == [good]
        assert [r["text"] for r in C.drop_near_duplicates(spark, docs, str(tmp_path)).where("doc_id = 500").collect()] == [good]


def test_queries_and_oracles(spark):
    assert {f"op{i}" for i in range(1, 11)} | {"language", "pipeline", "pii", "rules"} == {q.split("_")[0] for q in QUERIES}
    for name, sql in ORACLES.items():
        assert spark_rows(QUERIES[name](spark, SF)) == oracle_rows(sql), name
    assert SCHEMA and rows
