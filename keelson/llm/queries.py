"""The registered queries of this subpackage, each over its whole table, and what SQL can say of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import bpe, decontam, language, minhash, pii, quality, rules, sharding, toxicity, warc
from keelson.llm.common import table

VOCABULARY = "word_bpe_49k.json"
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_documents(table(spark, sf_dir, "documents"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_pages(table(spark, sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2 that SQL can express: what the patterns alone find."""
    return pii.find_base(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.score_quality(table(spark, sf_dir, "documents"), labels)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), "doc_id", SHARDS)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    train = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id", F.col("quality").alias("label"))
    return rules.apply_rules(docs, rules.learn(docs, train))


def rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL can express: the counts and the base rule."""
    return rules.apply_rules(table(spark, sf_dir, "documents"), []).drop("kept", "rule")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), labels)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_pii, op3_quality, op4_sharding, op5_decontamination, op6_near_duplicates, op7_warc, op8_rules, op9_toxicity, op10_bpe, language_id_pages, pii_base, rules_base, pipeline)}

ORACLES = {
    "op6_near_duplicates": r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
    FROM documents),
s AS (
    SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || chr(31) || ws[i + 1]) WHEN len(ws) = 1 THEN ws ELSE [] END) AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
p AS (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
    SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r(doc_id, reach) AS (
    SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, b.v FROM r JOIN both_ways b ON b.u = r.reach)
SELECT n.doc_id, n.n AS n_shingles, min(r.reach) AS component_id, n.doc_id = min(r.reach) AS kept
FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n""",
    "op7_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS x FROM p),
m AS (SELECT x, max(page_id) AS top FROM d GROUP BY x)
SELECT page_id, payload_bytes,
    list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
        (((strpos('0123456789abcdef', substr(d.x, 1 + (5 * i) // 4, 1)) - 1) * 16 + CASE WHEN (5 * i) // 4 + 2 <= 40 THEN strpos('0123456789abcdef', substr(d.x, 2 + (5 * i) // 4, 1)) - 1 ELSE 0 END)
        >> (3 - (5 * i) % 4)) & 31)::BIGINT), 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d JOIN m USING (x)""",
    "pii_base": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (
    SELECT doc_id, 0 AS o, 'email' AS kind, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS m, string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS g FROM d
    UNION ALL SELECT doc_id, 1, 'ip', regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), string_split_regex(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') FROM d
    UNION ALL SELECT doc_id, 2, 'card', regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), string_split_regex(t, '[0-9]([\x20-]?[0-9])+') FROM d
    UNION ALL SELECT doc_id, 3, 'phone', regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(t, '\+[0-9][\x20().0-9-]+[0-9]') FROM d),
s AS (SELECT doc_id, o, kind, m, g, unnest(range(1, len(m) + 1)) AS i FROM k WHERE len(m) > 0),
x AS (
    SELECT doc_id, o, kind, m[i] AS v, regexp_replace(m[i], '[^0-9]', '', 'g') AS digits,
        (list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0))::BIGINT AS a FROM s),
good AS (
    SELECT doc_id, o, kind, a, a + length(v) AS b FROM x WHERE CASE kind WHEN 'email' THEN true
        WHEN 'ip' THEN list_bool_and(list_transform(string_split(v, '.'), lambda y: length(ltrim(y, '0')) <= 3 AND coalesce(try_cast(ltrim(y, '0') AS INTEGER), 0) <= 255))
        WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(0, length(digits)), lambda j: CASE WHEN j % 2 = 0 THEN substr(digits, length(digits) - j, 1)::INTEGER ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][1 + substr(digits, length(digits) - j, 1)::INTEGER] END)) % 10 = 0
        ELSE length(digits) BETWEEN 9 AND 15 END)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
    sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o), '')) AS base_sha256
FROM d LEFT JOIN good USING (doc_id) GROUP BY d.doc_id""",
    "rules_base": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
n AS (
    SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: {'i': i, 'k': ws[i] || chr(31) || ws[i + 1] || chr(31) || ws[i + 2]})) AS e FROM w WHERE len(ws) >= 3),
h AS (SELECT doc_id, e.i AS i, count(*) OVER (PARTITION BY doc_id, e.k) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY doc_id)
SELECT n.doc_id, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(r.n, 0) > 50 * n_words AS base_failed
FROM n LEFT JOIN r ON r.doc_id = n.doc_id""",
}
