"""Text statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.strings import lower_ascii, tokens
from keelson.operators.collection import arg_max
from keelson.plans.lineage import materialize

TFIDF_SEPARATORS = " \t\n.,()'\":;!?<>"


def word_count(docs: DataFrame, text: str = "text", separators: str = " \t") -> DataFrame:
    """word, cnt."""
    return docs.select(F.explode(tokens(F.col(text), separators)).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))


def word_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: distinct words, all words, mean count, and the most frequent word (of ties the larger)."""
    counts = word_count(docs, text)
    best = F.max(F.struct("cnt", "word")).alias("b")
    return counts.agg(F.count("*").alias("n_words"), F.sum("cnt").alias("total"), F.avg("cnt").alias("mean"), best).select("n_words", "total", "mean", F.col("b.word").alias("top_word"), F.col("b.cnt").alias("top_count"))


#: So many terms at most have their frequencies broadcast: those that make a FREQUENT-th or more of all pairs of document and term.
FREQUENT = 200_000


def _bag(words: Column) -> Column:
    """Each word once, with its count: runs of the sorted words, so that no row leaves its task. There is a word at least."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, F.greatest(i - 1, F.lit(0)))))
    runs = lambda s: let(starts(s), lambda at: F.transform(at, lambda p, k: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - p).cast("long").alias("cnt"))))
    return let(F.sort_array(words), runs)


def tf_idf(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, term, tf_idf with tf = count / total of the document and idf = ln(documents / documents with the term). Rows of one id are one document.

    Texts are split and counted row by row and written as bags; only rows whose id stands twice are brought together. Frequencies of common
    terms are broadcast, a bounded number; only pairs with rarer terms are shuffled to theirs.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.transform(tokens(F.col(text), TFIDF_SEPARATORS), lower_ascii).alias("w"))
    n = docs.agg(F.count_distinct("id").alias("n"))
    twice = materialize(docs.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("id").alias("again")), "repeated")
    some = bool(twice.limit(1).count())
    full = docs.where(F.size("w") > 0)
    once = full.join(twice, F.col("id").eqNullSafe(F.col("again")), "left_anti") if some else full
    bags = once.select("id", F.size("w").cast("long").alias("total"), _bag(F.col("w")).alias("bag"))
    if some:
        more = full.join(twice, F.col("id").eqNullSafe(F.col("again")), "left_semi").select("id", F.size("w").cast("long").alias("total"), F.explode("w").alias("term"))
        more = more.groupBy("id", "term").agg(F.max("total").alias("total"), F.count("*").alias("cnt"))
        bags = bags.union(more.select("id", "total", F.array(F.struct("term", "cnt")).alias("bag")))
    pairs = materialize(bags, "bags").select("id", "total", F.explode("bag").alias("e")).select("id", F.col("e.term").alias("term"), (F.col("e.cnt") / F.col("total")).alias("tf"))
    df = materialize(pairs.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    least = (df.agg(F.sum("df")).first()[0] or 0) / FREQUENT
    common, rare = F.broadcast(df.where(F.col("df") >= least)), df.where(F.col("df") < least)
    both = pairs.join(common, "term").union(pairs.join(common, "term", "left_anti").join(rare, "term").select("term", "id", "tf", "df"))
    return both.join(F.broadcast(n)).select("id", "term", (F.col("tf") * F.ln(F.col("n") / F.col("df"))).alias("tf_idf"))  # n is one row


def most_frequent(docs: DataFrame, text: str = "text") -> DataFrame:
    return arg_max(word_count(docs, text), "word", "cnt")
