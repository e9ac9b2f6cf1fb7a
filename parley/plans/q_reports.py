"""Queries of evaluation and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import clock_sql
from parley.operators import reports
from parley.plans import frames as fr
from parley.plans.registry import query


def recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as recognised chunks: shifted by some seconds, every fifth one missing, some characters wrong."""
    s = fr.seg(spark, sf_dir).where("(meeting_id + seg_no) % 5 <> 0")
    shift = F.col("seg_no") % 3 * 1000
    return s.select("meeting_id", "seg_no", (F.col("start_ms") + shift).alias("start_ms"), (F.col("end_ms") + shift).alias("end_ms"), F.translate("text", "th", "dh").alias("text"))


_A1 = f"""WITH {fr.MANIFEST}, rec AS (SELECT meeting_id, seg_no, start_ms + seg_no % 3 * 1000 AS start_ms, end_ms + seg_no % 3 * 1000 AS end_ms, translate(text, 'th', 'dh') AS text FROM seg WHERE (meeting_id + seg_no) % 5 <> 0),
p AS (SELECT m.meeting_id, m.item_no, string_agg(regexp_replace(r.text, '^\\s+|\\s+$', '', 'g'), ' ' ORDER BY r.seg_no) AS predicted FROM manifest m JOIN rec r ON m.meeting_id = r.meeting_id AND m.start_ms < r.end_ms AND r.start_ms < m.end_ms WHERE regexp_matches(r.text, '\\S') GROUP BY 1, 2),
a1 AS (SELECT m.*, p.predicted FROM manifest m LEFT JOIN p USING (meeting_id, item_no)),
n AS (SELECT *, regexp_replace(regexp_replace(text, '（(?s:.*)$', ''), '[\\s，。,.!?！？:：;；、]+|[^\\x00-\\x7F]', '', 'g') AS a, regexp_replace(regexp_replace(coalesce(predicted, ''), '（(?s:.*)$', ''), '[\\s，。,.!?！？:：;；、]+|[^\\x00-\\x7F]', '', 'g') AS b FROM a1),
a2 AS (SELECT *, round(CASE WHEN coalesce(predicted, '') = '' THEN 0.0 WHEN greatest(length(a), length(b)) = 0 THEN 1.0 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END, 3) AS similarity FROM n)"""


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.align_for_eval(fr.manifest(spark, sf_dir), recognised(spark, sf_dir))


@query(f"{_A1} SELECT meeting_id, item_no, predicted FROM a1")
def a1_align_for_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(spark, sf_dir).select("meeting_id", "item_no", "predicted")


def ascii_only(rows: DataFrame) -> DataFrame:
    """DuckDB's edit distance counts bytes; on ASCII texts the two engines agree."""
    return rows.withColumns({c: F.regexp_replace(c, r"[^\x00-\x7F]", "") for c in ("text", "predicted")})


@query(f"{_A1} SELECT meeting_id, item_no, similarity FROM a2")
def a2_score_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.score_alignment(ascii_only(aligned(spark, sf_dir))).select("meeting_id", "item_no", "similarity")


@query()
def a2_score_alignment_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.score_alignment(aligned(spark, sf_dir), "ratio").select("meeting_id", "item_no", "similarity")


@query(f"{_A1} SELECT language, count(*) AS items, round(avg(similarity), 6) AS mean_similarity, CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms FROM a2 GROUP BY ROLLUP (language)")
def a3_eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.eval_report(reports.score_alignment(ascii_only(aligned(spark, sf_dir))))


@query(f"""{_A1}, st AS (SELECT *, {clock_sql('start_ms')} || '-' || {clock_sql('end_ms')} AS stamp FROM a1), s AS (SELECT meeting_id, stamp, arg_min(predicted, item_no) AS said FROM st WHERE language = 'en' AND predicted IS NOT NULL GROUP BY 1, 2)
SELECT st.meeting_id, string_agg('[' || st.stamp || '] ' || CASE WHEN language = 'en' THEN coalesce(said, text) ELSE text END, chr(10) ORDER BY item_no) AS transcript FROM st LEFT JOIN s USING (meeting_id, stamp) GROUP BY 1""")
def a4_expand_eval_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.expand_eval_transcript(fr.manifest(spark, sf_dir), aligned(spark, sf_dir).where("predicted is not null"), "en")


@query(f"WITH {fr.CATALOG} SELECT area, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(bytes) / 1048576, 2) AS mb FROM catalog WHERE doc_id % 8 <> 0 GROUP BY ROLLUP (area)")
def a5_storage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = F.when(F.col("doc_id") % 8 == 0, F.concat(F.lit("."), "name")).otherwise(F.col("name"))
    return reports.storage_stats(fr.catalog(spark, sf_dir).withColumn("name", hidden))


@query(f"""WITH {fr.CATALOG}, p AS (SELECT area, [1, 7, 30][CAST(substr(area, 4) AS INT) % 3 + 1] AS days FROM (SELECT DISTINCT area FROM catalog))
SELECT area, days, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM catalog JOIN p USING (area) WHERE mtime < DATE '2024-01-31' - days GROUP BY 1, 2""")
def a5_retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = fr.catalog(spark, sf_dir)
    days = F.element_at(F.array(F.lit(1), F.lit(7), F.lit(30)), F.substring("area", 4, 9).cast("int") % 3 + 1)
    policy = catalog.select("area").distinct().withColumn("days", days)
    return reports.retention_plan(catalog, policy, F.lit("2024-01-31").cast("date"))


@query("""WITH q AS (SELECT event_type AS queue, event_id AS task_id, ts AS created_at FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY created_at, task_id) AS p, count(*) OVER (PARTITION BY queue) AS n FROM q)
SELECT queue, task_id, created_at, CAST(p AS INT) AS position, CAST(greatest(0, p - 3) * 300 AS BIGINT) AS wait_seconds, n >= 50 AS queue_full FROM n""")
def a6_queue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = fr.table(spark, sf_dir, "events").select(F.col("event_type").alias("queue"), F.col("event_id").alias("task_id"), F.col("ts").alias("created_at"))
    return reports.queue_report(tasks, concurrency=3, shards="queue")


@query("""WITH r AS (SELECT o_orderpriority AS run, o_orderstatus <> 'F' AS ok, round(o_totalprice, 0) AS seconds, round(o_totalprice, 0) * 3 AS audio_seconds, o_orderkey % 100 AS chars_out, 500 AS chars_in FROM orders)
SELECT run, count(*) FILTER (WHERE ok AND chars_out > 0) AS succeeded, count(*) FILTER (WHERE NOT (ok AND chars_out > 0)) AS failed, count(*) FILTER (WHERE ok AND chars_out = 0) AS empty, round(sum(seconds), 3) AS seconds, round(sum(audio_seconds) / sum(seconds), 6) AS speed,
  round(CAST(sum(chars_out) FILTER (WHERE ok AND chars_out > 0) AS DOUBLE) / sum(chars_in) FILTER (WHERE ok AND chars_out > 0), 6) AS compression FROM r GROUP BY 1""")
def a7_batch_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.round("o_totalprice", 0)
    runs = fr.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run"), (F.col("o_orderstatus") != "F").alias("ok"), seconds.alias("seconds"), (seconds * 3).alias("audio_seconds"), (F.col("o_orderkey") % 100).alias("chars_out"), F.lit(500).alias("chars_in"))
    return reports.batch_run_report(runs)


@query("""WITH c AS (SELECT l_returnflag AS provider, l_quantity AS eval_count, round(l_extendedprice, 0) * 1000000 AS eval_ns, round(l_discount * 100, 0) * 10000000 AS load_ns FROM lineitem)
SELECT provider, count(*) AS calls, round(sum(eval_count) / (sum(eval_ns) / 1e9), 6) AS tokens_per_second, count(*) FILTER (WHERE eval_count / (eval_ns / 1e9) < 1.0) AS slow_calls, round(max(load_ns) / 1e9, 4) AS max_load_seconds FROM c GROUP BY 1""")
def a8_throughput_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = fr.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("provider"), F.col("l_quantity").alias("eval_count"), (F.round("l_extendedprice", 0) * 1_000_000).alias("eval_ns"), (F.round(F.col("l_discount") * 100, 0) * 10_000_000).alias("load_ns"))
    return reports.throughput_report(calls, alarm=1.0)


#: Times as of which the queue is looked at.
TIMES = ["2024-01-05 00:00:00", "2024-01-12 06:30:00", "2024-01-20 12:00:00"]
_STATES = f"""{fr.TASKS}, t(as_of) AS (VALUES {", ".join(f"(TIMESTAMP '{t}')" for t in TIMES)}),
states AS (SELECT as_of, task_id, arg_max(status, (ts, seq)) AS status, max(ts) AS since FROM task_events JOIN t ON ts < as_of GROUP BY 1, 2)"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.queue_states(fr.task_events(spark, sf_dir), TIMES)


def without_zone(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query(f"WITH {_STATES} SELECT as_of, status, count(*) AS tasks FROM states GROUP BY GROUPING SETS ((as_of, status), (as_of))")
def a6_queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_zone(reports.queue_counts(states(spark, sf_dir)), "as_of")


@query(f"WITH {_STATES}, n AS (SELECT as_of, count(*) FILTER (WHERE status = 'queued') AS q, count(*) FILTER (WHERE status IN ('transcribing', 'summarizing')) AS w FROM states GROUP BY 1) SELECT as_of, q AS total_queued, w AS processing_count, CAST(greatest(0, q + 1 - 3) * 300 AS BIGINT) AS estimated_wait_seconds, q >= 50 AS queue_full FROM n")
def a6_queue_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_zone(reports.queue_status(states(spark, sf_dir), concurrency=3), "as_of")


@query(f"""WITH {_STATES}, n AS (SELECT as_of, task_id, since AS created_at, row_number() OVER (PARTITION BY as_of ORDER BY since, task_id) AS p, count(*) OVER (PARTITION BY as_of) AS n FROM states WHERE status = 'queued')
SELECT as_of, task_id, created_at, CAST(p AS INT) AS position, CAST(greatest(0, p - 3) * 300 AS BIGINT) AS wait_seconds, n >= 50 AS queue_full FROM n""")
def a6_queue_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_zone(reports.queue_places(states(spark, sf_dir), concurrency=3), "as_of", "created_at")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as calls: a minute of audio a unit, some without any."""
    audio = F.when(F.col("l_linenumber") == 7, 0).otherwise(F.col("l_quantity") * 60_000).cast("long")
    return fr.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("provider"), F.col("l_shipdate").alias("day"), F.round("l_extendedprice", 0).cast("long").alias("elapsed_ms"), audio.alias("duration_ms"))


_CALLS = "c AS (SELECT l_returnflag AS provider, CAST(round(l_extendedprice, 0) AS BIGINT) AS e, CAST(l_quantity * 60000 AS BIGINT) AS d FROM lineitem WHERE l_linenumber <> 7)"


@query(f"""WITH {_CALLS} SELECT provider, grouping(provider) = 1 AS all_providers, count(*) AS calls, round(sum(d) / 3600000.0, 4) AS audio_hours, round(CAST(sum(e) AS DOUBLE) / sum(d), 4) AS real_time_factor, max(round(CAST(e AS DOUBLE) / d, 4)) AS worst_factor FROM c GROUP BY ROLLUP (provider)""")
def a8_real_time_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.real_time_report(calls(spark, sf_dir))


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches per provider and day, merged."""
    return reports.sketch_percentiles(reports.call_sketches(calls(spark, sf_dir), F.try_divide(F.col("elapsed_ms"), F.col("duration_ms")), "provider", "day"))


@query(f"WITH {_CALLS} SELECT provider, grouping(provider) = 1 AS all_providers, count(*) AS calls, true AS median_within, true AS p95_within FROM c GROUP BY ROLLUP (provider)")
def a8_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the merged sketches' values have ranks within 0.02 of those asked for, counted over all calls."""
    found = percentiles(spark, sf_dir)
    factor = F.col("elapsed_ms") / F.col("duration_ms")
    rated = calls(spark, sf_dir).where("duration_ms > 0").select(F.explode(F.array(F.struct("provider", F.lit(False).alias("all_providers")), F.struct(F.lit(None).cast("string").alias("provider"), F.lit(True).alias("all_providers")))).alias("k"), factor.alias("f"))
    own = (F.col("k.all_providers") == F.col("all_providers")) & F.col("k.provider").eqNullSafe(F.col("provider"))
    near = lambda i, r: (F.avg((F.col("f") < F.get("percentiles", F.lit(i))).cast("double")) <= r + 0.02) & (F.avg((F.col("f") <= F.get("percentiles", F.lit(i))).cast("double")) >= r - 0.02)
    return rated.join(found, own).groupBy("provider", "all_providers", "calls").agg(near(0, 0.5).alias("median_within"), near(1, 0.95).alias("p95_within"))
