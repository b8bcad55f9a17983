import math
import random
from collections import Counter

from fixtures import SCHEMA, edge_docs, no_docs, rows, text_of

from keelson.llm import decontam as D

ITEMS = "item_id long, text string, doc_id long, items array<long>"


def words(text):
    out, w = [], ""
    for c in (text or "") + " ":
        if c.isalnum():
            w += c.lower()
        elif w:
            out.append(w)
            w = ""
    return out


def brute(items: list[tuple], text: str, threshold=0.35, question=0.6, answer=0.6) -> dict:
    """Scores every segment in every window from word pairs, and verifies in words."""
    items = sorted(((i, words(t)) for i, t in items if len(words(t)) > 1), key=lambda x: x[0])
    segments = []
    for k, (_, w) in enumerate(items):
        n = max(1, -(-len(w) // D.SEGMENT))
        size = -(-len(w) // n)
        segments += [(k, w[s : s + size] if len(w) - s > 1 else w[-2:]) for s in range(0, len(w), size)]
    tf = [Counter(zip(w, w[1:])) for _, w in segments]
    df = Counter(p for c in tf for p in c)
    mean = max(1.0, sum(len(w) for _, w in segments) / max(1, len(segments)))
    impacts = []
    for (_, w), c in zip(segments, tf):
        raw = {p: math.log1p((len(segments) - df[p] + 0.5) / (df[p] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean)) for p, n in c.items()}
        impacts.append({p: x / sum(raw.values()) for p, x in raw.items()})
    t, found = words(text), {}
    count = max(1, -(-(len(t) - (D.WINDOW - D.STEP)) // D.STEP)) if t else 0
    for a in range(0, count * D.STEP, D.STEP):
        b = min(a + D.WINDOW, len(t))
        pairs = set(zip(t[a:b], t[a + 1 : b]))
        if b < len(t):
            pairs = set(zip(t[a : b - 1], t[a + 1 : b]))
        for (k, _), imp in zip(segments, impacts):
            score = sum(imp.get(p, 0.0) for p in pairs)
            if score < threshold:
                continue
            item, w = items[k]
            region = t[max(0, a - len(w)) : b + len(w)]
            n = min(8, max(1, len(w) // 3))
            q, s = w[:-n], w[-n:]
            m = min(3, len(q))
            sh = lambda x, m=m: [tuple(x[i : i + m]) for i in range(len(x) - m + 1)]
            if sum(x in set(sh(region)) for x in sh(q)) / len(sh(q)) >= question and sum(x in region for x in s) / len(s) >= answer:
                found[item] = max(score, found.get(item, 0.0))
    return found


def cases():
    rng = random.Random(9)
    items = [(i, text_of(rng, n)) for i, n in enumerate([12, 20, 20, 40, 70, 150, 9, 5, 3, 2, 1, 0])] + [(50, None), (60, "the of and to in river"), (61, "the of and to in river"), (62, "Éa ñb çd ff gg hh ii jj")]
    texts = []
    for i, t in items:
        if not t:
            continue
        w = t.split()
        for pad in (0, 30, 47, 95):
            texts.append(" ".join([*text_of(rng, pad).split(), t.upper() if pad == 30 else t, *text_of(rng, 200).split()]))
        texts.append(" ".join(w[: len(w) // 2]) + " " + text_of(rng, 40))  # half a question
        texts.append(" ".join(w[: int(len(w) * 0.8)]) + " " + text_of(rng, 40))  # without its answer
        texts.append(" ".join(x if rng.random() > 0.1 else "zzz" for x in w))  # a few words changed
    return items, texts + [text_of(rng, 500) for _ in range(5)] + [None, "", "one", "..."]


def test_against_all_windows_and_segments(spark):
    items, texts = cases()
    got = {r["doc_id"]: r for r in D.find_leaks(spark.createDataFrame(rows(texts), SCHEMA), spark.createDataFrame([(i, t, 1, None) for i, t in items], ITEMS)).collect()}
    for i, t in enumerate(texts):
        want = brute(items, t)
        assert got[i]["items"] == sorted(want), t
        assert abs(got[i]["best_score"] - max(want.values(), default=0.0)) < 1e-5
        assert got[i]["contaminated"] == bool(want) != got[i]["kept"] and got[i]["n_items"] == len(want)


def test_whole_items_are_always_found():
    items, texts = cases()
    index = D.Index(items)
    for i, t in items:
        if len(words(t)) > 1:
            for before in range(0, 120, 11):
                text = " ".join(["pad"] * before + [t] + ["end"] * 60)
                assert i in D.contaminated(index, [text], 0.35, 0.6, 0.6)[0]


def test_block_max_wand_against_all_scores():
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 30)))) for i in range(400)]
    index = D.Index(items)
    for _ in range(60):
        query = sorted(rng.sample(range(len(index.terms)), min(len(index.terms), rng.randrange(1, 9))))
        for threshold in (0.05, 0.2, 0.5):
            want = Counter()
            for t in query:
                for d, x in zip(*index.postings[t]):
                    want[d] += x
            got = dict(index.search(list(query), threshold))
            assert set(got) >= {d for d, x in want.items() if x > threshold + 1e-9} and set(got) <= {d for d, x in want.items() if x > threshold - 1e-9}


def test_items_in_several_blocks(spark, monkeypatch):
    items, texts = cases()
    docs, table = spark.createDataFrame(rows(texts), SCHEMA), spark.createDataFrame([(i, t, 1, None) for i, t in items], ITEMS)
    one = {r["doc_id"]: r["items"] for r in D.find_leaks(docs, table, carry=["text", "lang"]).collect()}
    monkeypatch.setattr(D, "BLOCK_BYTES", 500)
    more = D.find_leaks(docs, table, carry=["text", "lang"]).collect()
    whole = {i for i, t in items if t and len(words(t)) > 8}
    assert all(set(r["items"]) & whole == set(one[r["doc_id"]]) & whole and r["text"] == texts[r["doc_id"]] for r in more)


def test_scores_do_not_depend_on_blocks(spark, monkeypatch):
    items, texts = cases()
    items += [(100 + i, f"{'river stone garden window ' * 3}{text_of(random.Random(i), 6)}") for i in range(30)]  # terms that blocks share
    texts += [" ".join(t.split()[:9]) for _, t in items[-30:]] + [t for _, t in items[-30:]]
    docs, table = spark.createDataFrame(rows(texts), SCHEMA), spark.createDataFrame([(i, t, 1, None) for i, t in items], ITEMS)
    found = lambda: {r["doc_id"]: (r["items"], r["best_score"]) for r in D.find_leaks(docs, table).collect()}
    one = found()
    monkeypatch.setattr(D, "BLOCK_BYTES", 1500)
    assert found() == one and any(x for x, _ in one.values())


def test_edges(spark):
    items = spark.createDataFrame([(1, "two words", 0, None), (1, "two words", 0, None), (None, "word", 0, None), (3, None, 0, None)], ITEMS)
    got = D.find_leaks(edge_docs(spark), items).collect()
    assert len(got) == 16 and {r["doc_id"] for r in got if r["contaminated"]} == {5, 6, None}
    assert D.find_leaks(edge_docs(spark), items.limit(0)).where("contaminated").count() == 0
    assert D.find_leaks(no_docs(spark), items).count() == 0
