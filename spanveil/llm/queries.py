"""The registered query of each operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import contamination
from .exact import exact_dedup
from .fixity import audit, damaged
from .lines import line_dedup
from .ngram_join import ngram_jaccard_join
from .packing import default_vocabulary, pack_documents


from .passages import repeated_passages
from .secrets import secret_scan
from .toxicity import toxicity
from .word_score import word_cross_entropy_difference


def op1_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_vocabulary())


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


#: The fixity drill damages one page in so many.
DRILL_EVERY = 97


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return audit(pages, damaged(pages, DRILL_EVERY))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op10_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what is labelled as of high quality."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return word_cross_entropy_difference(table(spark, sf_dir, "documents"), good)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_counterfactual_toxicity": op1_counterfactual_toxicity,
    "op2_nnls_packing": op2_nnls_packing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_warc_fixity": op6_warc_fixity,
    "op7_secret_scan": op7_secret_scan,
    "op8_line_dedup": op8_line_dedup,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_cross_entropy_difference": op10_cross_entropy_difference,
}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op6_warc_fixity": f"""
        WITH replica AS (
            SELECT page_id, url, CASE WHEN page_id % {DRILL_EVERY} = {DRILL_EVERY // 2} AND length(html) > 0
                THEN '#' || substr(html, 2) ELSE html END AS html FROM pages),
        copies AS (SELECT 'a' AS side, page_id, url, html FROM pages UNION ALL SELECT 'b', page_id, url, html FROM replica),
        records AS (
            SELECT side, page_id, page_id // 256 AS shard,
                'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
                || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
                || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)
                || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record
            FROM copies),
        placed AS (
            SELECT side, page_id, shard, strlen(record) AS length, sha256(record) AS hash,
                CAST(sum(strlen(record)) OVER (PARTITION BY side, shard ORDER BY page_id) - strlen(record) AS BIGINT) AS at
            FROM records)
        SELECT a.page_id, a.shard, a.at AS record_offset, a.length AS record_length, a.hash AS record_sha256,
            CASE WHEN a.hash <> b.hash THEN 'changed' WHEN a.at <> b.at OR a.length <> b.length THEN 'moved' ELSE 'ok' END AS status
        FROM placed a JOIN placed b ON a.page_id = b.page_id AND a.side = 'a' AND b.side = 'b'""",
    "op8_line_dedup": """
        WITH split AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM split),
        hot AS (
            SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40
            GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        marked AS (
            SELECT keyed.*, hot.key IS NOT NULL AND doc_id <> top AS gone
            FROM keyed LEFT JOIN hot ON keyed.key = hot.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
}
