"""The corpus pipeline: language ID, near-duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that
is written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

Edge cases: rows without a doc_id go with language ID, as nothing could refer to them; null and letterless texts are
rejected there too, each row by itself, so a rejected row doesn't return with another of its doc_id; rows that share a doc_id are
one document, of which near-duplicate removal keeps the row with the least text (of equal texts the least lang, source and n_chars); ties
are decided by the least doc_id; very long texts pass every stage whole; null source and n_chars pass through; empty tables give no rows;
further columns of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import bpe, decontam, language, minhash, pii
from keelson.llm.common import fresh_path, table
from keelson.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, with the language found."""
    found = language.identify_documents(docs, carry=["text", "source", "n_chars"]).where("kept and doc_id is not null")
    return found.select("doc_id", "text", F.col("language").alias("lang"), "source", F.col("n_chars").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link."""
    kept = minhash.near_duplicates(docs, shingle_words=5).where("kept and doc_id is not null").select("doc_id").distinct()
    rest = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi")
    one = rest.groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("d"))
    return one.select("doc_id", "d.*").select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified benchmark item."""
    read = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"), carry=COLUMNS[1:])
    return read.where("kept").select(*COLUMNS).withColumn("n_chars", F.col("n_chars").cast("long"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    clean = pii.find_pii(docs, carry=["lang", "source"], redact=True)
    return clean.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.length("clean").cast("long").alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.encode_decode(docs, vocabulary())


STAGES = [("language_id", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark), ("pii", redact_pii), ("bpe", encode)]

#: Trained taggers and verified retrieval have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
