"""Quality rules as learned decision lists, in DataFrame functions only.

Statistics of every whole text are column expressions. Sequential covering then learns an ordered list of
threshold conjunctions from labelled rows: a rule for the bad class grows condition by condition (FOIL
gain on the growing part), is pruned from its end (precision on the pruning part), and its rows are taken
away before the next rule grows. The list is emitted as one CASE expression, first match wins.

Learning sees counts alone: Spark bins each statistic at quantiles of the labelled sample and groups
equal bin vectors, so the driver gets at most `sample_rows` groups. `sample_rows` labelled rows bound the
fit (the smallest hashes of doc_id, whatever the table's size); rules then apply to all rows.

Edge cases: null text has no words; a text without words fails the base rule; repeated rows are judged
each; null labels are not learned from; without labels, or with one class only, the list is empty and
keeps what passes the base rule; very long texts are counted whole; of conditions with equal gain the first by statistic and bin is
taken. Columns other than id, text and labels are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.sampling import hashed_sample

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ["n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "mark_rate", "digit_rate", "distinct_rate"]


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, even where lambdas inside refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def removed(text: Column, chars: str) -> Column:
    """How many characters of `chars` the text has."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeated(hashes: Column) -> Column:
    """Words that lie in a window of three words found twice or more; hashes: one number for each word."""

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)

    def found(s: Column) -> Column:
        same = F.filter(s, lambda x, j: (x["k"] == F.get(s, j + 1)["k"]) | (x["k"] == F.get(s, j - 1)["k"]))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    def windows(h: Column) -> Column:
        at = F.transform(F.slice(h, 1, F.size(h) - 2), lambda x, i: F.struct(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("k"), i.alias("i")))
        return let(F.sort_array(at), found)

    return F.when(F.size(hashes) >= 4, let(hashes, windows)).otherwise(F.lit(0)).cast("long")


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, the contract's counts and FEATURES of every row's text."""
    t = F.col("text")
    base = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hashes = F.transform(F.filter(F.split(t, "[ \\t-\\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    one = base.select(
        *keep, hashes.alias("h"), (F.length(t) - removed(t, SPACE)).cast("long").alias("word_chars"), removed(t, SYMBOLS).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        removed(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÉÈÊËÎÏÔÙÛÑÁÍÓÚ").alias("upper"), removed(t, "!?").alias("marks"), removed(t, "0123456789").alias("digits"),
    )
    two = one.select(
        *keep, F.size("h").cast("long").alias("n_words"), "word_chars", "n_symbols", F.col("lines.dup").cast("long").alias("n_dup_lines"), repeated(F.col("h")).alias("n_repeat_words"),
        F.size(F.array_distinct("h")).alias("distinct"), F.col("lines.n").alias("n_lines"), "upper", "marks", "digits",
    )
    per = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)).cast("double")
    rates = {"mean_word": per("word_chars", "n_words"), "symbol_rate": per("n_symbols", "n_words"), "dup_line_rate": per("n_dup_lines", "n_lines"), "repeat_rate": per("n_repeat_words", "n_words"), "upper_rate": per("upper", "word_chars"), "mark_rate": per("marks", "n_words"), "digit_rate": per("digits", "word_chars"), "distinct_rate": per("distinct", "n_words")}
    return two.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(c.alias(k) for k, c in rates.items()))


Rule = list[tuple[str, str, float]]


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, bins: int = 32, precision: float = 0.9, max_rules: int = 12, max_terms: int = 3) -> list[Rule]:
    """Rules for label 0, best first. docs: doc_id, text; labels: doc_id, label (0 bad, 1 good), one row a document."""
    sample = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = hashed_sample(sample, "doc_id", sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most sample_rows rows
    stats = statistics(rows, ["doc_id", "label"]).select("label", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("prune"), *(F.col(f).cast("double").alias(f) for f in FEATURES))
    stats = stats.persist()
    try:
        cuts_row = stats.select(*(F.percentile_approx(f, [i / bins for i in range(1, bins)] + [0.99, 0.995], 10_000).alias(f) for f in FEATURES)).first()
        cuts = {f: sorted(set(cuts_row[f] or [])) for f in FEATURES}
        if not any(cuts.values()):
            return []
        binned = [(reduce(lambda a, b: a + b, [(F.col(f) > c).cast("int") for c in cuts[f]]) if cuts[f] else F.lit(0)).alias(f) for f in FEATURES]
        counted = [tuple(r) for r in stats.select("label", "prune", *binned).groupBy("label", "prune", *FEATURES).count().collect()]
    finally:
        stats.unpersist()
    grow = [(r[2:-1], r[0] == 0, r[-1]) for r in counted if not r[1]]
    prune = [(r[2:-1], r[0] == 0, r[-1]) for r in counted if r[1]]
    return cover(grow, prune, cuts, precision, max_rules, max_terms)


def cover(grow: list, prune: list, cuts: dict[str, list[float]], precision: float, max_rules: int, max_terms: int) -> list[Rule]:
    """Sequential covering over (bin vector, is bad, count) rows."""

    def holds(v, term) -> bool:
        k, op, b = term
        return v[k] > b if op == ">" else v[k] <= b

    def tally(rows) -> tuple[int, int]:
        return sum(n for _, bad, n in rows if bad), sum(n for _, bad, n in rows if not bad)

    def best_term(rows, p0: int, n0: int, among):
        before, best = math.log2(p0 / (p0 + n0)), (1e-9, None)
        for k in among:
            f = FEATURES[k]
            size = len(cuts[f]) + 1
            bad, good = [0] * size, [0] * size
            for v, is_bad, n in rows:
                (bad if is_bad else good)[v[k]] += n
            p = q = 0
            for b in range(size - 1):
                p, q = p + bad[b], q + good[b]
                for op, x, y in (("<=", p, q), (">", p0 - p, n0 - q)):
                    if x and (gain := x * (math.log2(x / (x + y)) - before)) > best[0]:
                        best = (gain, (k, op, b))
        return best[1]

    def value(ts) -> float:
        p, n = tally([r for r in grow + prune if all(holds(r[0], t) for t in ts)])
        q, m = tally([r for r in prune if all(holds(r[0], t) for t in ts)])
        return min((p + 1) / (p + n + 2), (q + 0.5) / (q + m + 0.5)) if p >= 3 else 0.0

    def grown(first: int) -> list:
        """A rule whose first condition is on FEATURES[first]."""
        rows, terms = grow, []
        while len(terms) < max_terms:
            p, n = tally(rows)
            if not p or not n or not (t := best_term(rows, p, n, range(len(FEATURES)) if terms else [first])):
                break
            terms.append(t)
            rows = [r for r in rows if holds(r[0], t)]
        while len(terms) > 1 and value(terms[:-1]) >= value(terms):
            terms.pop()
        return terms

    rules: list[Rule] = []
    while len(rules) < max_rules:
        # of the precise rules, one from each first feature, the one that covers most
        able = [ts for k in range(len(FEATURES)) if (ts := grown(k)) and value(ts) >= precision]
        if not able:
            break
        terms = max(able, key=lambda ts: (tally([r for r in grow + prune if all(holds(r[0], t) for t in ts)])[0], -len(ts)))
        rules.append([(FEATURES[k], op, cuts[FEATURES[k]][b]) for k, op, b in terms])
        grow = [r for r in grow if not all(holds(r[0], t) for t in terms)]
        prune = [r for r in prune if not all(holds(r[0], t) for t in terms)]
    return rules


def verdict(rules: list[Rule]) -> tuple[Column, Column]:
    """The ordered list as (number of the rule that rejects or null, whether the row is kept)."""
    expr = None
    for k, rule in enumerate(rules, 1):
        cond = reduce(lambda a, b: a & b, [F.col(f) > c if op == ">" else F.col(f) <= c for f, op, c in rule])
        expr = F.when(cond, F.lit(k)) if expr is None else expr.when(cond, F.lit(k))
    expr = F.lit(None).cast("int") if expr is None else expr
    return expr, expr.isNull()


def apply_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id") -> DataFrame:
    """Per row the counts, base_failed, the rule that rejects it and kept."""
    stats = statistics(docs, [id_col])
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    number, keep = verdict(rules)
    return stats.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & keep).alias("kept"), number.alias("rule"))
