"""Registered queries of this folder, with production parameters, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, kd_shard, license_scan, packing, ppm, simhash, toxicity, url_rules, warc
from .common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), window=1024)


def op2_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, seed=42, most=4)


def op4_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    return ppm.score(_table(spark, sf_dir, "documents"), held_out, order=5)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


#: The rule list of op3: (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages"), url_rules.rule_table(spark, URL_RULES))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), similarity=0.8)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "warc").path("archive")
    warc.write_archive(_table(spark, sf_dir, "pages"), path, min_bytes=0)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    rest = lambda c: F.crc32(F.col(c).cast("string")) % 4
    scorer = toxicity.fit(docs, labels.where(rest("doc_id") != 2))
    out = toxicity.score(docs.select("doc_id", "text"), scorer)
    return out.select("doc_id", (rest("doc_id") == 2).alias("held_out"), "score", F.when(F.col("score") >= toxicity.TOXIC, 1).otherwise(0).alias("predicted"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.dedup(_table(spark, sf_dir, "documents"), keep="largest")
    return out.withColumnRenamed("digest", "text_sha256")


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_shard.shard(_table(spark, sf_dir, "documents"), n_shards=16)
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


QUERIES = {
    "op1_nnls_packing": op1_nnls_packing,
    "op2_golay_simhash": op2_golay_simhash,
    "op3_url_rules": op3_url_rules,
    "op4_ppm_score": op4_ppm_score,
    "op5_license_scan": op5_license_scan,
    "op6_decontaminate": op6_decontaminate,
    "op7_warc": op7_warc,
    "op8_toxicity": op8_toxicity,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_kd_shards": op10_kd_shards,
}

ORACLE = {
    "op3_url_rules": r"""
        WITH r(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                                               ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
        p AS (SELECT row_number() OVER () AS k, page_id,
                     coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                     coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u)
        SELECT p.page_id, p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
               coalesce(arg_max(r.verdict, length(r.host || r.path)), 'allow') AS verdict
        FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
        GROUP BY p.k, p.page_id, p.host, p.path
    """,
    "op7_warc": """
        WITH d AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        h AS (SELECT page_id, body, sha1(body) AS x, min(page_id) OVER (PARTITION BY body) AS low FROM d),
        b AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((CAST('0x' || substr(x, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT) + 1, 1), '' ORDER BY i) AS code
              FROM h, range(32) AS t(i) GROUP BY page_id)
        SELECT h.page_id, strlen(body) AS payload_bytes, code AS payload_digest,
               CASE WHEN h.page_id = low THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN h.page_id <> low THEN low END AS refers_to
        FROM h JOIN b USING (page_id)
    """,
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(body) AS text_sha256
        FROM d WINDOW g AS (PARTITION BY body)
    """,
}
