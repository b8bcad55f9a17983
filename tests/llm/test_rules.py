import random
import re

from fixtures import SCHEMA, edge_docs, edge_texts, no_docs, rows, text_of

from keelson.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    """The contract's counts."""
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)} if len(windows) < 3000 else set()
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_counts_against_the_contract(spark):
    rng = random.Random(4)
    texts = edge_texts() + ["a b c a b c", "a a a a a", "a b a b a b a", "x\ny\nx\n\n \nx ", "a b c", "😀😀 é|#", "1 2 3 1 2 3 4 1 2"]
    for _ in range(60):
        texts.append("".join(rng.choice(["a", "b", " ", " ", "\n", "\t", "#", "\r", "c\n"]) for _ in range(rng.randrange(80))))
    got = {r["doc_id"]: r for r in rules.apply_rules(spark.createDataFrame(rows(texts), SCHEMA), []).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, repeat = brute(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (n, chars, symbols, dup), repr(t)
        if n < 3000:
            assert r["n_repeat_words"] == repeat, repr(t)
        assert r["base_failed"] == (n < 50 or 100 * r["n_repeat_words"] > 50 * n)
        assert r["kept"] == (not r["base_failed"])


def test_a_list_is_learned_and_applied_in_order(spark):
    rng, texts, labels = random.Random(6), [], []
    for i in range(240):
        t = text_of(rng, 70)
        kind = i % 4
        if kind == 0:
            t = t.replace(" ", " ### ", 40)
        elif kind == 1:
            t = t.upper()
        texts.append(t)
        labels.append((i, int(kind > 1)))
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    learned = rules.learn(docs, spark.createDataFrame(labels, "doc_id long, label int"))
    assert learned and all(f in rules.FEATURES and op in (">", "<=") for r in learned for f, op, _ in r)
    got = {r["doc_id"]: r for r in rules.apply_rules(docs, learned).collect()}
    assert all(got[i]["kept"] == bool(y) for i, y in labels)
    stats = {r["doc_id"]: r.asDict() for r in rules.statistics(docs, ["doc_id"]).collect()}
    for i, r in got.items():  # the number is that of the first rule that holds
        first = next((k for k, rule in enumerate(learned, 1) if all((stats[i][f] > c) == (op == ">") for f, op, c in rule)), None)
        assert r["rule"] == first


def test_covering_by_hand():
    cuts = {f: [1.0, 2.0] for f in rules.FEATURES}
    grow = [((2, *[0] * 8), True, 10), ((0, *[0] * 8), False, 10)]
    assert rules.cover(grow, grow, cuts, 0.9, 5, 3) == [[("n_words", ">", 1.0)]] or rules.cover(grow, grow, cuts, 0.9, 5, 3) == [[("n_words", ">", 2.0)]]
    assert rules.cover([((0,) * 9, True, 5)], [], cuts, 0.9, 5, 3) == []


def test_plan_is_native(spark):
    plan = rules.apply_rules(edge_docs(spark), [[("n_words", ">", 5.0)]])._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_edges(spark):
    docs = edge_docs(spark)
    none = spark.createDataFrame([], "doc_id long, label int")
    one = spark.createDataFrame([(3, 1), (4, 1), (None, 0), (5, None)], "doc_id long, label int")
    for labels in (none, one):
        assert rules.learn(docs, labels) == []
    assert rules.learn(no_docs(spark), one) == []
    assert rules.apply_rules(docs, []).count() == 16
    assert rules.apply_rules(no_docs(spark), []).count() == 0
