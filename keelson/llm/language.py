"""Language identification by Bayesian fusion of text, declared markup, address suffix and host priors.

1. Text: hashed character n-grams (1 to 3, lower-cased) under multinomial models, one for every declared language,
   however rare, each fitted on at most max(LEAST_EACH, sample_docs / number of languages) of its rows with a letter (smallest
   hashes of the id). Evidence is the likelihood over that of a background model: the sample's texts with their
   characters shuffled, half mixed with the uniform distribution; language models are smoothed towards it, so grams a language
   never showed count against it. A long text's evidence is tempered to that of TEMPER n-grams, as neighbouring n-grams are
   not independent. A text that the background explains better than every language, by more than ERRORS standard errors
   (of a letter's evidence in the sample), is in none of them. Texts of a few letters are thus seldom refused.
2. Declared language: P(declared | language) from sums of text posteriors over all rows.
3. Host priors: posteriors summed by host, by address suffix and overall; the host's prior shrinks towards
   its suffix's, and that towards the global one, by pseudo-counts. Sums are grouped aggregations
   with map-side combining; priors are written, so that both sides of the join back are plain exchanges: Spark broadcasts
   priors that turn out small, and otherwise splits a host with a third of all rows over tasks.
The posterior is their normalised product. A row is rejected when its text has no letter or is in no modelled language,
its language is not accepted, or its posterior is below `least`.

Edge cases: null or letterless texts and those in no modelled language get language "und", confidence 0 and kept false; a null declared language or
host adds no evidence; repeated rows are judged each, by their own text; very long texts are read whole and their evidence tempered
like any other's; of languages equally likely the first by name is taken; further columns are not read; an empty table gives no rows;
without any declared language in the sample every row is "und".
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.llm.common import codes_of, map_chunks, materialize, slices

BUCKETS = 1 << 15
TEMPER = 40.0
SMOOTH = 0.2 * BUCKETS
ERRORS = 2.0
LEAST_EACH = 100
TOP = 0x3000


@lru_cache(maxsize=1)
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case (one character for one) and whether it is a letter, below TOP."""
    low = np.arange(TOP, dtype=np.uint32)
    letter = np.zeros(TOP, bool)
    for c in range(TOP):
        s = chr(c)
        letter[c] = s.isalpha()
        if len(s.lower()) == 1:
            low[c] = ord(s.lower())
    return low, letter


def gram_slots(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (3 for each letter) of n-grams that end in a letter, and the letter count of each text."""
    codes, offsets = codes_of(texts)
    low, letter = letter_tables()
    small = np.minimum(codes, TOP - 1)
    is_letter = letter[small] | (codes >= TOP)
    c = np.where(is_letter, np.where(codes < TOP, low[small], codes), 32).astype(np.uint64)
    prev = np.full(len(c) + 2, 32, np.uint64)
    prev[2:] = c
    starts = offsets[:-1][np.diff(offsets) > 0]
    a, b = prev[1:-1].copy(), prev[:-2].copy()
    a[starts] = 32
    b[starts] = 32
    nxt = starts[starts + 1 < len(c)] + 1
    b[nxt] = 32
    keep = np.flatnonzero(is_letter)
    x, y, z = c[keep], a[keep], b[keep]
    h = lambda v, k: ((v * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(49)).astype(np.int64)
    slots = np.stack([h(x, 1), h(x * np.uint64(1 << 21) + y, 2), h((x * np.uint64(1 << 21) + y) * np.uint64(1 << 21) + z, 3)], axis=1)
    return slots, np.searchsorted(keep, offsets)


def gram_counts(texts: list[str]) -> np.ndarray:
    counts = np.zeros(BUCKETS)
    for part in slices(texts):
        counts += np.bincount(gram_slots(texts[part])[0].ravel(), minlength=BUCKETS)
    return counts


def shuffled(texts: list[str]) -> list[str]:
    """Each text with its characters in another order, the same one at each call."""
    rng = np.random.default_rng(1)
    return [rng.permutation(codes_of([t])[0]).tobytes().decode("utf-32-le", "surrogatepass") for t in texts]


class TextModel:
    """Multinomial n-gram models of the languages found in the sample, over a background model."""

    def __init__(self, texts: list[str], languages: list[str]):
        self.languages = sorted(set(languages))
        mixed = gram_counts(shuffled(texts))
        ground = 0.5 * (mixed + 0.2) / (mixed.sum() + 0.2 * BUCKETS) + 0.5 / BUCKETS
        self.logp = np.zeros((BUCKETS, max(1, len(self.languages))), np.float32)
        self.deviation = np.zeros(self.logp.shape[1])
        for k, lang in enumerate(self.languages):
            own = [t for t, x in zip(texts, languages, strict=True) if x == lang]
            counts = gram_counts(own)
            self.logp[:, k] = np.log((counts + SMOOTH * ground) / (counts.sum() + SMOOTH) / ground)
            n = total = squares = 0.0
            for part in slices(own):
                letter = self.logp[gram_slots(own[part])[0], k].sum(axis=1, dtype=np.float64)
                n, total, squares = n + len(letter), total + letter.sum(), squares + (letter * letter).sum()
            self.deviation[k] = max(0.0, squares / max(1.0, n) - (total / max(1.0, n)) ** 2) ** 0.5

    def loglik(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log-likelihoods over the background's (texts, languages) and letter counts."""
        slots, at = gram_slots(texts)
        n = np.diff(at)
        out = np.empty((len(texts), self.logp.shape[1]))
        for k in range(out.shape[1]):
            per = np.zeros(len(slots) + 1)
            np.cumsum(self.logp[slots, k].sum(axis=1), out=per[1:])
            out[:, k] = per[at[1:]] - per[at[:-1]]
        return out * (np.minimum(n, TEMPER) / np.maximum(n, 1))[:, None], n

    def modelled(self, ll: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether a text has letters and the background does not explain it better than every language."""
        letter = ll / np.maximum(1, np.minimum(n, TEMPER))[:, None]
        return (n > 0) & (letter + ERRORS * self.deviation / np.sqrt(np.maximum(n, 1))[:, None] >= 0).any(axis=1)


HTML_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def markup_language(html: Column) -> Column:
    """The language that <html lang=...> declares, lower case, or null."""
    found = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    return F.when(found != "", F.lower(found))


def visible_text(html: Column) -> Column:
    """What is left of a page without scripts, styles and tags."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>|&#?\w+;", " ")


def url_host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def suffix_of(host: Column) -> Column:
    """The part of a host name after its last dot, or null."""
    found = F.regexp_extract(F.coalesce(host, F.lit("")), r"\.([A-Za-z]+)$", 1)
    return F.when(found != "", F.lower(found))


def identify(rows: DataFrame, accepted: list[str] | None = None, least: float = 0.5, sample_docs: int = 2000, smooth: float = 20.0, carry: list[str] | None = None) -> DataFrame:
    """rows: id, text, declared, host (any but id and text may be null). Returns id, language, confidence, text_language, declared, kept.

    `carry` passes string columns on, row by row, so that nothing has to be joined back by an id that may be repeated.
    """
    passed = {f"c_{c}": c for c in carry or []}
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.lower(F.col("declared").cast("string")).alias("declared"), F.col("host").cast("string").alias("host"), *(F.col(c).cast("string").alias(k) for k, c in passed.items() if c != "text"))
    lettered = rows.where("id is not null and declared <> ''").where(F.col("text").rlike(r"\p{L}"))
    ids = lettered.select("id", "declared").distinct()
    often = ids.groupBy("declared").agg(F.count("*").alias("n"))
    each, h = max(LEAST_EACH, sample_docs // max(1, often.count())), F.xxhash64("id")
    # a first cut by the hash leaves about four times as many of each language, so no sort sees a whole one
    cut = F.when(F.col("n") > 4 * each, -(1 << 63) + F.lit(float(1 << 64)) * 4 * each / F.col("n")).otherwise(F.lit(float(1 << 63)))
    near = ids.join(F.broadcast(often), "declared").where(h <= cut)  # often: one row a language
    some = near.withColumn("r", F.row_number().over(Window.partitionBy("declared").orderBy(h, "id"))).where(F.col("r") <= each).select("id", "declared")
    told = lettered.join(F.broadcast(some), ["id", "declared"]).groupBy("id", "declared").agg(F.min("text").alias("text")).collect()  # at most `each` rows a language
    told.sort(key=lambda r: (r["id"], r["declared"]))
    model = TextModel([r["text"] for r in told], [r["declared"] for r in told])
    langs = model.languages

    def run(batch: dict[str, list]) -> dict:
        ll, n = model.loglik(batch["text"])
        n = np.where(model.modelled(ll, n), n, 0)  # what is in no modelled language counts as letterless from here on
        return {"id": batch["id"], "declared": batch["declared"], "host": batch["host"], "letters": n, "ll": ll.tolist()} | {k: batch[k] if c != "text" else batch[c] for k, c in passed.items()}

    handed = [F.col(k).alias(c) for k, c in passed.items()]
    if not langs:
        return rows.select("id", F.lit("und").alias("language"), F.lit(0.0).alias("confidence"), F.lit("und").alias("text_language"), "declared", F.lit(False).alias("kept"), *handed)
    slim = materialize(map_chunks(rows, run, "id long, declared string, host string, letters long, ll array<double>" + "".join(f", {k} string" for k in passed)), "language")
    top = F.array_max("ll")
    soft = F.transform("ll", lambda x: F.exp(x - top))
    total = F.aggregate(soft, F.lit(0.0), lambda a, x: a + x)
    named = slim.withColumn("text_post", F.transform(soft, lambda x: x / total)).withColumn("suffix", suffix_of(F.col("host"))).withColumn("known", F.when(F.col("declared").isin(langs), F.col("declared")).when(F.col("declared").isNotNull() & (F.col("declared") != ""), F.lit("other")))
    lettered = named.where("letters > 0")
    sums = [F.sum(F.get("text_post", F.lit(k))).alias(f"s{k}") for k in range(len(langs))]

    # at most len(langs) + 1 rows reach the driver
    by_declared = {r["known"]: r for r in lettered.where("known is not null").groupBy("known").agg(*sums).collect()}
    overall = lettered.agg(*sums).first()
    world = np.array([(overall[f"s{k}"] or 0.0) + 1.0 for k in range(len(langs))])
    world_prior = world / world.sum()
    groups = [*langs, "other"]
    told_given = np.array([[(by_declared[g][f"s{k}"] if g in by_declared else 0.0) + 0.05 for k in range(len(langs))] for g in groups])
    told_given = np.log(told_given / told_given.sum(axis=0, keepdims=True))

    # host within suffix within all
    hosts = lettered.where("host is not null").groupBy("host", "suffix").agg(*sums)
    suffixes = lettered.where("suffix is not null").groupBy(F.col("suffix").alias("sx")).agg(*[F.sum(F.get("text_post", F.lit(k))).alias(f"u{k}") for k in range(len(langs))])
    add = lambda p: sum((F.coalesce(F.col(f"{p}{k}"), F.lit(0.0)) for k in range(len(langs))), F.lit(0.0))
    priors = hosts.join(suffixes, hosts["suffix"] == suffixes["sx"], "left")
    priors = priors.withColumn("us", add("u")).withColumn("ss", add("s"))
    up = [(F.coalesce(F.col(f"u{k}"), F.lit(0.0)) + smooth * float(world_prior[k])) / (F.col("us") + smooth) for k in range(len(langs))]
    priors = priors.select(F.col("host").alias("h"), F.array(*[F.ln((F.col(f"s{k}") + smooth * u) / (F.col("ss") + smooth)) for k, u in enumerate(up)]).alias("prior"))
    joined = named.join(materialize(priors, "priors"), F.col("host") == F.col("h"), "left")

    world_log = F.array(*[F.lit(float(x)) for x in np.log(world_prior)])
    told_rows = rows.sparkSession.createDataFrame([(g, row.tolist()) for g, row in zip(groups, told_given, strict=True)], "g string, told array<double>")
    joined = joined.join(F.broadcast(told_rows), F.col("known") == F.col("g"), "left")  # one row a language
    told_log = F.coalesce("told", F.array(*[F.lit(0.0)] * len(langs)))
    fused = joined.withColumn("f", F.zip_with(F.zip_with("ll", F.coalesce("prior", world_log), lambda a, b: a + b), told_log, lambda a, b: a + b))
    best = F.array_max("f")
    fused = fused.withColumn("confidence", F.when(F.col("letters") > 0, 1.0 / F.aggregate(F.transform("f", lambda x: F.exp(x - best)), F.lit(0.0), lambda a, x: a + x)).otherwise(F.lit(0.0)))
    names = F.array(*[F.lit(x) for x in langs])
    label = lambda c: F.when(F.col("letters") > 0, F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))).otherwise(F.lit("und"))
    out = fused.select("id", label("f").alias("language"), F.round("confidence", 6).alias("confidence"), label("ll").alias("text_language"), "declared", *passed)
    kept = (F.col("language") != "und") & F.col("language").isin(accepted or langs) & (F.col("confidence") >= least)
    return out.select(*[c for c in out.columns if c not in passed], kept.alias("kept"), *handed)


def identify_documents(docs: DataFrame, **options) -> DataFrame:
    """documents: the declared language is `lang`, the host `source`."""
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), *(c for c in options.get("carry", []) if c != "text"))
    return identify(rows, **options).withColumnRenamed("id", "doc_id")


def identify_pages(pages: DataFrame, **options) -> DataFrame:
    """pages: the declared language is that of the markup, host and suffix come from the url."""
    rows = pages.select(F.col("page_id").alias("id"), visible_text(F.col("html")).alias("text"), markup_language(F.col("html")).alias("declared"), url_host(F.col("url")).alias("host"))
    return identify(rows, **options).withColumnRenamed("id", "page_id")
