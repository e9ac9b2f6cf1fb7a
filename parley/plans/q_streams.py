"""Queries of progress events: each reads the events table as a stream, runs over what is there, and returns its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.plans import frames as fr
from parley.plans.registry import query
from parley.sources.store import shared_path
from parley.streaming import progress


#: Milliseconds; tasks are remembered beyond the closing row.
HOUR, YEARS = 3_600_000, 10 * 365 * 86_400_000


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its file or files."""
    kinds = fr.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(kinds).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "false").parquet(f"{sf_dir}/events.parquet*")


def run(stream: DataFrame, mode: str = "append", keys: list[str] = ()) -> DataFrame:
    spark = stream.sparkSession
    return progress.run_to_end(stream, shared_path(spark, "stream"), shared_path(spark, "stream-state"), mode, keys)


def closed(events: DataFrame, rows: DataFrame) -> DataFrame:
    """The stream of events and one row far behind the last of ``rows``, the same as a table: the watermark then passes all
    sessions, so that in append mode they come out and leave the state. The row has null keys."""
    spark, path = events.sparkSession, shared_path(events.sparkSession, "stream-end")
    last = rows.agg((F.max("ts") + F.expr("INTERVAL 1000 DAYS")).alias("ts"))
    last.select(*(F.col("ts") if c == "ts" else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns)).write.parquet(path)
    return events.unionByName(spark.readStream.schema(events.schema).parquet(path))


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Times without a zone, as the events table has them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def task_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.task_events_of(event_stream(spark, sf_dir))


def _lines(events: DataFrame) -> DataFrame:
    n, text = F.col("event_id"), lambda x: x.cast("string")
    part = n % 150
    line = (
        F.when(n % 6 == 0, F.concat(F.lit('{"percent": '), text(part), F.lit("}")))
        .when(n % 6 == 1, F.concat(F.lit("noise "), text(part)))
        .when(n % 6 == 2, F.concat(F.lit('{"fraction": "x", "progress": 0.'), text(part % 10), F.lit("}")))
        .when(n % 6 == 3, F.concat(F.lit('{"value": '), text(part), F.lit("}")))
        .when(n % 6 == 4, F.concat(F.lit('{"fraction": -'), text(part), F.lit("}")))
        .otherwise(F.lit('{"other": 1}'))
    )
    return events.select("event_id", line.alias("line"))


@query("""SELECT event_id, round(CASE event_id % 6 WHEN 0 THEN least(1.0, event_id % 150 / 100) WHEN 2 THEN event_id % 150 % 10 / 10 WHEN 3 THEN CASE WHEN event_id % 150 > 1 THEN least(1.0, event_id % 150 / 100) ELSE event_id % 150 END ELSE 0.0 END, 6) AS fraction FROM events WHERE event_id % 6 NOT IN (1, 5)""")
def x1_progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(progress.progress_stream(_lines(event_stream(spark, sf_dir)))).select("event_id", F.round("fraction", 6).alias("fraction"))


@query(f"""WITH {fr.TASKS}, e AS (SELECT task_id, min(seq) FILTER (WHERE status IN ('completed', 'failed', 'cancelled')) AS a, max(seq) AS b FROM task_events GROUP BY 1)
SELECT t.task_id, t.seq, t.ts, t.status, t.progress FROM task_events t JOIN e ON t.task_id = e.task_id AND t.seq = coalesce(e.a, e.b)""")
def x2_latest_task_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(run(progress.latest_task_state(task_stream(spark, sf_dir)), "update", ["task_id"]), "ts")


@query("SELECT DISTINCT event_id AS seq FROM events")
def x3_dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = task_stream(spark, sf_dir).select("seq", "ts")
    return run(progress.dedup_events(events.unionByName(events.where("seq % 3 = 0")), "40 days")).select("seq")


@query(f"""WITH {fr.TASKS}, l AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY task_id ORDER BY ts, seq) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM task_events), i AS (SELECT *, sum(new) OVER (PARTITION BY task_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS n FROM l)
SELECT task_id, min(ts) AS first_ts, max(ts) + INTERVAL 6 HOUR AS idle_at, count(*) AS events FROM i GROUP BY task_id, n""")
def x4_idle_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = closed(task_stream(spark, sf_dir).select("task_id", "ts"), fr.task_events(spark, sf_dir))
    return plain(run(progress.activity_sessions(events, "6 hours", "40 days")).where("task_id IS NOT NULL"), "first_ts", "idle_at")


#: A task's events in runs without a gap of six hours, these cut after eight.
_LIMITS = f"""WITH RECURSIVE {fr.TASKS}, l AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY task_id ORDER BY ts, seq) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM task_events),
i AS (SELECT task_id, seq, ts, sum(new) OVER (PARTITION BY task_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS n FROM l),
s AS (SELECT task_id, n, min(ts) AS first_ts FROM i GROUP BY 1, 2 UNION ALL SELECT s.task_id, s.n, min(i.ts) FROM s JOIN i ON i.task_id = s.task_id AND i.n = s.n AND i.ts >= s.first_ts + INTERVAL 8 HOUR GROUP BY 1, 2),
r AS (SELECT i.task_id, i.n, i.ts, max(s.first_ts) AS first_ts FROM i JOIN s ON s.task_id = i.task_id AND s.n = i.n AND s.first_ts <= i.ts GROUP BY i.task_id, i.n, i.ts, i.seq)
SELECT task_id, first_ts, least(max(ts) + INTERVAL 6 HOUR, first_ts + INTERVAL 8 HOUR) AS ended_at, CASE WHEN first_ts + INTERVAL 8 HOUR < max(ts) + INTERVAL 6 HOUR THEN 'total' ELSE 'idle' END AS reason, count(*) AS events FROM r GROUP BY task_id, n, first_ts"""


@query(_LIMITS)
def x4_task_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(progress.task_limits(fr.task_events(spark, sf_dir), 6 * HOUR, 8 * HOUR), "first_ts", "ended_at")


@query(_LIMITS)
def x4_task_limits_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = closed(task_stream(spark, sf_dir).select("task_id", "seq", "ts"), fr.task_events(spark, sf_dir))
    return plain(run(progress.task_limits_stream(events, 6 * HOUR, 8 * HOUR, "40 days")), "first_ts", "ended_at")


@query(f"WITH {fr.TASKS} SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, status, count(*) AS events, round(avg(progress), 6) AS mean_progress FROM task_events GROUP BY 1, 2")
def x5_status_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(run(progress.status_throughput(task_stream(spark, sf_dir).select("ts", "status", "progress"), delay="40 days"), "update", ["window_start", "status"]), "window_start")


@query(f"""WITH {fr.TASKS}, w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS window_start, status, progress FROM task_events, range(4) r(k))
SELECT window_start, status, count(*) AS events, round(avg(progress), 6) AS mean_progress FROM w GROUP BY 1, 2""")
def x5_status_throughput_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(run(progress.status_throughput(task_stream(spark, sf_dir).select("ts", "status", "progress"), "1 hour", "15 minutes", "40 days"), "update", ["window_start", "status"]), "window_start")


@query(f"""WITH {fr.SEG}, p AS (SELECT meeting_id, role AS speaker, start_ms, end_ms FROM seg),
l AS (SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY meeting_id, speaker ORDER BY start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 9000 THEN 0 ELSE 1 END AS new FROM p),
i AS (SELECT *, sum(new) OVER (PARTITION BY meeting_id, speaker ORDER BY start_ms ROWS UNBOUNDED PRECEDING) AS n FROM l)
SELECT meeting_id, speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS pieces FROM i GROUP BY meeting_id, speaker, n""")
def x6_live_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "pieces")
    fr.seg(spark, sf_dir).select("meeting_id", F.col("role").alias("speaker"), F.timestamp_millis("start_ms").alias("ts"), F.timestamp_millis("end_ms").alias("end_ts")).write.parquet(path)
    pieces = spark.read.parquet(path)
    stream = closed(spark.readStream.schema(pieces.schema).parquet(path), pieces)
    out = run(progress.live_utterances(stream, "9000 milliseconds")).where("meeting_id IS NOT NULL")
    return out.select("meeting_id", "speaker", F.unix_millis("start_ts").alias("start_ms"), F.unix_millis("end_ts").alias("end_ms"), "pieces")


@query(f"WITH {fr.TASKS} SELECT task_id, seq, status, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1000000.0 AS seconds FROM task_events WINDOW w AS (PARTITION BY task_id ORDER BY ts, seq)")
def x7_stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.stage_durations(fr.task_events(spark, sf_dir))


@query(f"WITH {fr.TASKS}, d AS (SELECT task_id, seq, status, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1000000.0 AS seconds FROM task_events WINDOW w AS (PARTITION BY task_id ORDER BY ts, seq)) SELECT * FROM d WHERE seconds IS NOT NULL")
def x7_stage_durations_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = closed(task_stream(spark, sf_dir).select("task_id", "seq", "ts", "status"), fr.task_events(spark, sf_dir))
    return run(progress.stage_durations_stream(events, keep_ms=YEARS, delay="40 days"))


@query(f"WITH {fr.TASKS} SELECT task_id, seq, progress, max(progress) OVER (PARTITION BY task_id ORDER BY ts, seq) AS shown FROM task_events")
def x8_monotone_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = closed(task_stream(spark, sf_dir).select("task_id", "seq", "ts", "progress"), fr.task_events(spark, sf_dir))
    return run(progress.monotone_progress_stream(events, keep_ms=YEARS, delay="40 days"))
