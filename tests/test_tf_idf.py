"""tf_idf over repeated ids, rows without words, common and rare terms."""

import math
from collections import Counter

import pytest

from keelson.operators import text


@pytest.mark.parametrize("frequent", [200_000, 3])
def test_pairs_are_counted_in_their_rows(spark, monkeypatch, frequent):
    monkeypatch.setattr(text, "FREQUENT", frequent)
    rows = [(1, "a b A, c"), (2, ""), (3, None), (4, "b b b"), (5, "a z"), (5, "a a q"), (None, "a w"), (None, "w")]
    got = {(r["id"], r["term"]): r["tf_idf"] for r in text.tf_idf(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()}
    counts, totals = {}, {}
    for i, t in rows:
        words = (t or "").lower().replace(",", " ").split()
        for w, c in Counter(words).items():
            counts[i, w] = counts.get((i, w), 0) + c
            totals[i, w] = max(totals.get((i, w), 0), len(words))
    df = Counter(w for _, w in counts)
    assert got.keys() == counts.keys()
    assert all(abs(got[k] - c / totals[k] * math.log(5 / df[k[1]])) < 1e-12 for k, c in counts.items())


def test_pairs_of_common_terms_are_not_shuffled(spark):
    docs = spark.range(50).selectExpr("id", "'one two three' as text")
    plan = text.tf_idf(docs, "id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("frequencies") > 1
