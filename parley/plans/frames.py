"""Frames that the queries derive from the given tables, in Spark and as DuckDB common table expressions.

Times are whole milliseconds. Names of the SQL forms: seg, trn, seg_bad, trn_gap, manifest, lines, task_events, catalog.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators import align


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as clips: 60 ms a character."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting_id"), F.col("turn").cast("int").alias("seg_no"), "role", "text", (F.greatest(F.lit(1), F.length("text")) * 60).cast("long").alias("len_ms"))


def seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = align.build_timeline(clips(spark, sf_dir), key="meeting_id", order="seg_no", length="len_ms", silence_ms=350)
    return laid.select("meeting_id", "seg_no", "start_ms", "end_ms", "text", "role")


def _turns(segments: DataFrame) -> DataFrame:
    n = F.col("seg_no")
    speaker = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    return segments.select("meeting_id", n.alias("turn_no"), F.greatest(F.lit(0), F.col("start_ms") - (n * 37 % 5) * 3000).cast("long").alias("start_ms"), (F.col("end_ms") + (n * 53 % 7) * 5000).cast("long").alias("end_ms"), speaker.alias("speaker"))


def trn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(seg(spark, sf_dir))


def trn_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trn(spark, sf_dir).where((F.col("meeting_id") + F.col("turn_no")) % 3 != 0)


def seg_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("meeting_id") + F.col("seg_no")
    return seg(spark, sf_dir).withColumn("end_ms", F.when(n % 7 == 0, F.lit(None)).when(n % 11 == 0, F.col("start_ms") - 1).otherwise(F.col("end_ms")))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("meeting_id"), F.col("lang").alias("language"), "source")
    return seg(spark, sf_dir).join(langs, "meeting_id").select("meeting_id", F.col("seg_no").alias("item_no"), "start_ms", "end_ms", "language", "text", "source")


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a line; line_no from 0."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def status_of(event_type: Column) -> Column:
    kinds = {"signup": "queued", "view": "transcribing", "click": "summarizing", "purchase": "completed", "error": "failed"}
    return F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[event_type]


def task_events_of(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), status_of(F.col("event_type")).alias("status"), F.col("value").alias("progress"))


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return task_events_of(table(spark, sf_dir, "events"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return docs.select(F.col("source").alias("area"), F.concat("lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".mp3")).alias("name"), F.col("n_chars").alias("bytes"), F.date_sub(F.lit("2024-01-31").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("mtime"), "doc_id")


#: The sequential block of the fixtures, for DuckDB.
SEG = """seg0 AS (SELECT conv_id AS meeting_id, CAST(turn AS INT) AS seg_no, role, text, CAST(greatest(1, length(text)) * 60 AS BIGINT) AS len_ms FROM conversations),
seg1 AS (SELECT *, CAST(coalesce(sum(len_ms + 350) OVER (PARTITION BY meeting_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM seg0),
seg AS (SELECT meeting_id, seg_no, start_ms, start_ms + len_ms AS end_ms, text, role FROM seg1)"""
TRN = SEG + """,
trn AS (SELECT meeting_id, seg_no AS turn_no, CAST(greatest(0, start_ms - ((seg_no * 37) % 5) * 3000) AS BIGINT) AS start_ms, CAST(end_ms + ((seg_no * 53) % 7) * 5000 AS BIGINT) AS end_ms,
  CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS speaker FROM seg)"""
TRN_GAP = TRN + """,
trn_gap AS (SELECT * FROM trn WHERE (meeting_id + turn_no) % 3 <> 0)"""
SEG_BAD = SEG + """,
seg_bad AS (SELECT meeting_id, seg_no, start_ms, CASE WHEN (meeting_id + seg_no) % 7 = 0 THEN NULL WHEN (meeting_id + seg_no) % 11 = 0 THEN start_ms - 1 ELSE end_ms END AS end_ms, text, role FROM seg)"""
MANIFEST = SEG + """,
manifest AS (SELECT s.meeting_id, s.seg_no AS item_no, s.start_ms, s.end_ms, d.lang AS language, s.text, d.source FROM seg s JOIN documents d ON d.doc_id = s.meeting_id)"""
LINES = "lines AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"
TASKS = """task_events AS (SELECT user_id AS task_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'transcribing' WHEN 'click' THEN 'summarizing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status, value AS progress FROM events)"""
CATALOG = "catalog AS (SELECT source AS area, lang || '_' || doc_id || '.mp3' AS name, n_chars AS bytes, DATE '2024-01-31' - CAST(doc_id % 60 AS INT) AS mtime, doc_id FROM documents)"
