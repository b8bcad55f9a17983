import math

import numpy as np
from fixtures import edge_docs, no_docs
from oracle import SF

from keelson.llm import language as L
from keelson.llm.queries import language_id_pages, op1_language_id

SCHEMA = "doc_id long, text string, lang string, source string, id string, declared string, host string, suffix string, s0 double"
EN = "the river and the garden are near the old bridge where people walk in the morning"
DE = "der fluss und der garten sind nahe der alten brücke wo die leute am morgen gehen"


def corpus(spark):
    made = [(i, (EN if i % 2 else DE) + f" {'abc' if i % 2 else 'üöä'}", "en" if i % 2 else "de", ("news.de" if i % 2 == 0 else "news.uk") if i < 40 else "hot.de", "x", None, None, None, 1.0) for i in range(60)]
    made += [(100, "123 456", "en", "news.uk", None, None, None, None, None), (101, "q", None, "news.de", None, None, None, None, None), (102, "q", None, "news.uk", None, None, None, None, None), (103, EN, "de", "news.uk", None, None, None, None, None), (104, None, "de", None, None, None, None, None, None)]
    return spark.createDataFrame(made, SCHEMA)


def test_evidence_is_fused(spark):
    got = {r["doc_id"]: r for r in L.identify_documents(corpus(spark)).collect()}
    assert len(got) == 65
    assert all(got[i]["language"] == ("en" if i % 2 else "de") and got[i]["kept"] for i in range(60))
    assert (got[100]["language"], got[100]["confidence"], got[100]["kept"]) == ("und", 0.0, False) == (got[104]["language"], got[104]["confidence"], got[104]["kept"])
    # a text that says little takes its host's language; a clear text outweighs a wrong declaration
    assert got[101]["language"] == "de" and got[102]["language"] == "en" and got[103]["language"] == "en"


def test_against_plain_arithmetic(spark):
    rows = corpus(spark).collect()
    told = [r for r in rows if r["lang"] and r["text"] is not None]
    model = L.TextModel([r["text"] for r in told], [r["lang"] for r in told])
    assert model.languages == ["de", "en"]
    ll, letters = model.loglik([r["text"] for r in rows])
    post = np.exp(ll - ll.max(axis=1, keepdims=True))
    post /= post.sum(axis=1, keepdims=True)
    live = [i for i in range(len(rows)) if letters[i]]
    world = sum(post[i] for i in live) + 1.0
    world = world / world.sum()
    suffix = lambda r: r["source"].rsplit(".", 1)[1] if r["source"] else None
    told_by = np.array([[sum(post[i][k] for i in live if (rows[i]["lang"] or "") == g) + 0.05 for k in range(2)] for g in ("de", "en", "other")])
    told_by = np.log(told_by / told_by.sum(axis=0))
    got = {r["doc_id"]: r for r in L.identify_documents(corpus(spark)).collect()}
    for i in live:
        r = rows[i]
        up = (sum(post[j] for j in live if suffix(rows[j]) == suffix(r)) + 20 * world) if r["source"] else None
        prior = (sum(post[j] for j in live if rows[j]["source"] == r["source"]) + 20 * up / up.sum()) if r["source"] else world
        f = ll[i] + np.log(prior / prior.sum()) + (told_by[["de", "en"].index(r["lang"])] if r["lang"] else 0)
        p = np.exp(f - f.max())
        assert got[r["doc_id"]]["language"] == ["de", "en"][int(f.argmax())]
        assert math.isclose(got[r["doc_id"]]["confidence"], p.max() / p.sum(), abs_tol=2e-6)


def test_url_parts(spark):
    urls = ["https://u:p@A.Example.DE:80/x?y", "http://h", "no url", None, "http://1.2.3.4/"]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(u,) for u in urls], "u string").select(L.url_host(F.col("u")).alias("h"))
    got = [(r["h"], r["s"]) for r in df.select("h", L.suffix_of(F.col("h")).alias("s")).collect()]
    assert got == [("a.example.de", "de"), ("h", None), (None, None), (None, None), ("1.2.3.4", None)]


def test_accuracy_on_documents_and_pages(spark):
    got = op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("lang is not null")
    assert got.where("language = lang").count() >= 0.98 * got.count() and got.where("kept").count() >= 0.98 * got.count()
    assert language_id_pages(spark, SF).count() == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_edges(spark):
    got = L.identify_documents(edge_docs(spark)).collect()
    assert len(got) == 16 and all(not r["kept"] and r["language"] == "und" for r in got if r["doc_id"] in (0, 1, 2))
    nothing = edge_docs(spark).selectExpr("doc_id", "text", "cast(null as string) lang", "source")
    assert all(r["language"] == "und" and not r["kept"] for r in L.identify_documents(nothing).collect())
    assert L.identify_documents(no_docs(spark)).count() == 0


FOREIGN = [
    "Rzeka i ogród są blisko starego mostu gdzie ludzie spacerują rano",
    "Река и сад находятся рядом со старым мостом где люди гуляют утром",
    "川と庭は古い橋の近くにあり人々は朝に歩きます",
    "Joki ja puutarha ovat lähellä vanhaa siltaa jossa ihmiset kävelevät aamulla",
    "Il fiume e il giardino sono vicini al vecchio ponte dove la gente cammina la mattina",
]


def test_texts_in_no_modelled_language_are_refused(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    added = spark.createDataFrame([(-1 - i, t, None, "src0") for i, t in enumerate(FOREIGN)], docs.schema)
    got = L.identify_documents(docs.union(added)).where("doc_id < 0").collect()
    assert len(got) == len(FOREIGN) and all((r["language"], r["text_language"], r["kept"], r["confidence"]) == ("und", "und", False, 0.0) for r in got)


def test_rare_languages_get_a_model(spark):
    made = [(i, (EN if i % 2 else DE) + f" {i}", "en" if i % 2 else "de", "x.org") for i in range(1200)]
    made += [(2000 + i, f"{t} {i}", lang, "x.org") for lang, t in (("pl", FOREIGN[0]), ("ru", FOREIGN[1])) for i in range(1 if lang == "pl" else 3)]
    got = L.identify_documents(spark.createDataFrame(made, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(made) and all(r["language"] == r["declared"] and r["kept"] for r in got)
