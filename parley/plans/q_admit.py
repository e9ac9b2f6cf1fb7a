"""Queries of admission, hashes and column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as fx
from parley.operators import admit
from parley.plans import frames as fr
from parley.plans.registry import query
from parley.plans.templates import templates

_NAME = "CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN '../' || name WHEN 2 THEN replace(name, '.mp3', '.TXT') WHEN 3 THEN 'a\\' || name ELSE name END"


@query(f"""WITH {fr.CATALOG}, c AS (SELECT doc_id, {_NAME} AS name, bytes FROM catalog)
SELECT *, CASE WHEN trim(name) = '' THEN 'empty name' WHEN contains(name, '..') OR contains(name, '/') OR contains(name, '\\') THEN 'unsafe name' WHEN lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) NOT IN ('mp3', 'wav', 'm4a', 'mp4', 'flac', 'ogg', 'aac', 'wma') THEN 'type not supported' WHEN bytes > 3000 THEN 'too large' END AS reason FROM c""")
def p1_admit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % 9
    name = F.when(n == 0, "").when(n == 1, F.concat(F.lit("../"), "name")).when(n == 2, F.replace("name", F.lit(".mp3"), F.lit(".TXT"))).when(n == 3, F.concat(F.lit("a\\"), "name")).otherwise(F.col("name"))
    return admit.admit_files(fr.catalog(spark, sf_dir).select("doc_id", name.alias("name"), "bytes"), max_bytes=3000)


_TASKS = "t AS (SELECT event_id, ['local', 'cloud', 'hybrid'][event_id % 3 + 1] AS mode, ['general', 'procurement_evaluation', 'section_meeting', 'isms_monthly', 'other'][event_id % 5 + 1] AS template_id FROM events)"


@query(f"WITH {_TASKS} SELECT *, CASE WHEN mode = 'hybrid' THEN 'unknown mode' WHEN template_id = 'other' THEN 'unknown template' WHEN template_id = 'procurement_evaluation' AND mode = 'cloud' THEN 'template is local only' END AS reason FROM t")
def p2_enforce_mode_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("event_id") % len(names) + 1).cast("int"))
    tasks = fr.table(spark, sf_dir, "events").select("event_id", pick(["local", "cloud", "hybrid"]).alias("mode"), pick(["general", "procurement_evaluation", "section_meeting", "isms_monthly", "other"]).alias("template_id"))
    return admit.enforce_mode_policy(tasks, templates(spark))


@query("SELECT doc_id, sha256(text) AS hash, sha256(text || '|' || n_chars) AS legacy_hash FROM documents")
def p11_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fr.documents(spark, sf_dir)
    return docs.select("doc_id", F.sha2("text", 256).alias("hash"), F.sha2(F.concat("text", F.lit("|"), F.col("n_chars").cast("string")), 256).alias("legacy_hash"))


@query(f"""SELECT doc_id, CAST({fx.estimate_tokens_sql('text')} AS BIGINT) AS tokens, CAST(least(2000, greatest(250, {fx.estimate_tokens_sql('text')} // 15)) AS BIGINT) AS min_chars FROM documents""")
def m1_estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fr.documents(spark, sf_dir).withColumn("tokens", fx.estimate_tokens(F.col("text")))
    return docs.select("doc_id", "tokens", fx.dynamic_min_chars(F.col("tokens")).alias("min_chars"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^.*[/\\\\]', ''), '\\.[^.]*$', ''), '[^A-Za-z0-9_\\- .]', '', 'g') AS base_name FROM pages")
def p9_safe_base_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.table(spark, sf_dir, "pages").select("page_id", fx.safe_base_name(F.col("url")).alias("base_name"))


_OPTIONS = {"backend": "CASE doc_id % 11 WHEN 0 THEN NULL ELSE source END", "model": "lang", "revision": "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'r' || doc_id % 5 END", "language": "CASE doc_id % 3 WHEN 0 THEN '' ELSE lang END", "beam_size": "CASE doc_id % 2 WHEN 0 THEN doc_id % 7 END", "vad_enabled": "CASE doc_id % 5 WHEN 0 THEN 'True' WHEN 1 THEN '' END", "diarization": "CASE doc_id % 6 WHEN 0 THEN 'k=2' WHEN 1 THEN '' END"}


@query("WITH o AS (SELECT doc_id, " + ", ".join(f"CAST({v} AS VARCHAR) AS {k}" for k, v in _OPTIONS.items()) + """ FROM documents)
SELECT doc_id, left(sha256(coalesce(backend, 'unset') || '::' || coalesce(model, 'unset') || '::' || coalesce(nullif(revision, ''), 'unpinned') || '::' || coalesce(nullif(language, ''), 'auto') || '::' || '::' || coalesce(beam_size, 'default') || '::' || coalesce(vad_enabled, 'default') || '::' || coalesce(nullif(diarization, ''), 'diarization:off')), 16) AS signature FROM o""")
def p10_cache_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fr.documents(spark, sf_dir).selectExpr("doc_id", *(f"CAST({v} AS STRING) AS {k}" for k, v in _OPTIONS.items()))
    return rows.select("doc_id", fx.cache_signature(**{k: F.col(k) for k in _OPTIONS}).alias("signature"))


@query("SELECT doc_id, left(text, 2000) AS preview FROM documents")
def p12_result_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.documents(spark, sf_dir).select("doc_id", fx.preview(F.col("text")).alias("preview"))


@query("SELECT doc_id AS task_id, n_chars AS file_size, lang AS message FROM documents")
def p13_redact_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an upload's columns those that shared evidence may have; the text and what else is there stay out."""
    uploads = fr.documents(spark, sf_dir).withColumnsRenamed({"doc_id": "task_id", "n_chars": "file_size", "lang": "message"})
    return admit.redact_columns(uploads)


@query(f"SELECT doc_id, CAST(least(2000, greatest(250, {fx.estimate_tokens_sql('text')} // 15)) AS BIGINT) AS min_chars FROM documents")
def m14_dynamic_min_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.documents(spark, sf_dir).select("doc_id", fx.dynamic_min_chars(fx.estimate_tokens(F.col("text"))).alias("min_chars"))
