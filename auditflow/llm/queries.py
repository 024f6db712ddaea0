"""The operators' queries over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditflow.functions import lineage
from auditflow.llm import bpe, compression, decontam, divergence, exact, html_text, langid, licenses, packing, quality, simhash, token_count, whitening
from auditflow.llm import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(T.crc32_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.train(docs.where(~held_out & F.col("doc_id").isNotNull()))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    both = bpe.round_trip(table(spark, sf_dir, "documents"), path)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{lineage.shared(spark)}/tokens-{uuid.uuid4().hex}"
    packing.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end=2)
    return packing.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


@query
def op6_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(T.crc32_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    model = compression.train(docs, labels.where(~held_out))
    found = compression.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= compression.PREDICT_FROM).cast("int").alias("predicted"), "difference")


@query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(table(spark, sf_dir, "documents"))


ORACLE["op11_exact_dedup"] = """
WITH norm AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
groups AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM norm GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM norm n JOIN groups g USING (t)"""


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLE["op12_source_divergence"] = r"""
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS (SELECT doc, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
bags AS (SELECT DISTINCT lang, source FROM docs),
found AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY w.lang, w.source, w.term),
totals AS (SELECT b.lang, b.source, coalesce(sum(f.n), 0) AS total FROM bags b LEFT JOIN found f ON f.lang = b.lang AND f.source = b.source GROUP BY b.lang, b.source),
cells AS (SELECT t.lang, t.source, k.term, coalesce(f.n, 0) AS n, CAST(1 + (1000000000 * (CAST(coalesce(f.n, 0) AS HUGEINT) + 1)) // (t.total + s.v) AS HUGEINT) AS p
    FROM totals t JOIN kept k ON k.lang = t.lang JOIN sizes s ON s.lang = t.lang LEFT JOIN found f ON f.lang = t.lang AND f.source = t.source AND f.term = k.term),
usual AS (SELECT c.lang, c.term, CAST(1 + (1000000000 * (CAST(sum(c.n) AS HUGEINT) + 1)) // (max(a.total) + max(s.v)) AS HUGEINT) AS q
    FROM cells c JOIN (SELECT lang, sum(total) AS total FROM totals GROUP BY lang) a ON a.lang = c.lang JOIN sizes s ON s.lang = c.lang GROUP BY c.lang, c.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term WHERE a.source <> b.source GROUP BY a.lang, a.source, b.source
    UNION ALL SELECT a.lang, a.source, b.source, 0 FROM bags a JOIN bags b ON a.lang = b.lang WHERE a.source <> b.source AND a.lang NOT IN (SELECT lang FROM sizes)),
more AS (SELECT c.lang, c.source, c.term AS item, (c.p - u.q) * (c.p - u.q) // u.q AS value FROM cells c JOIN usual u ON u.lang = c.lang AND u.term = c.term WHERE c.n > 0 AND c.p > u.q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM more)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""
