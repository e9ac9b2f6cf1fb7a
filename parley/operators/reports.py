"""Evaluation against reference timelines, and reports on storage, queues, batch runs and model calls."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions.folds import numbered
from pyspark.sql import types as T

from parley.functions.text import clock, in_order
from parley.operators.align import BUCKET_MS, as_right, overlapping
from parley.operators.clean import stripped


def align_for_eval(manifest: DataFrame, chunks: DataFrame, bucket_ms: int | None = BUCKET_MS) -> DataFrame:
    """A1: manifest items with the texts of all chunks that overlap them, in order, joined by a blank; null without any."""
    right = as_right(chunks.select("meeting_id", F.col("seg_no"), "start_ms", "end_ms", F.col("text").alias("said")))
    pairs = overlapping(manifest.select("meeting_id", "item_no", "start_ms", "end_ms"), right, bucket_ms=bucket_ms).where(stripped(F.col("said")) != "")
    joined = pairs.groupBy("meeting_id", "item_no").agg(in_order("seg_no", stripped(F.col("said")), " ").alias("predicted"))
    return manifest.join(joined, ["meeting_id", "item_no"], "left")


def comparable(text: Column) -> Column:
    """Up to the first full-width bracket, without marks and blanks."""
    return F.regexp_replace(F.regexp_replace(text, "（[\\s\\S]*$", ""), r"(?U)[\s，。,.!?！？:：;；、]+", "")


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def score_alignment(aligned: DataFrame, metric: str = "levenshtein") -> DataFrame:
    """A2: adds ``similarity`` (0 without a prediction), rounded to 3 digits; metric levenshtein or ratio."""
    truth, said = comparable(F.col("text")), comparable(F.coalesce("predicted", F.lit("")))
    longest = F.greatest(F.length(truth), F.length(said))
    value = matching_ratio(truth, said) if metric == "ratio" else F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(truth, said) / longest)
    return aligned.withColumn("similarity", F.round(F.when(F.coalesce("predicted", F.lit("")) == "", 0.0).otherwise(value), 3))


def eval_report(scored: DataFrame) -> DataFrame:
    """A3: items, mean similarity and seconds by language, and over all (language null)."""
    seconds = F.sum(F.col("end_ms") - F.col("start_ms"))
    return scored.rollup("language").agg(F.count("*").alias("items"), F.round(F.avg("similarity"), 6).alias("mean_similarity"), seconds.alias("total_ms"))


def expand_eval_transcript(manifest: DataFrame, scored: DataFrame, language: str) -> DataFrame:
    """A4: per meeting the stamped lines, those of the language with what was recognised."""
    stamp = lambda: F.concat(clock(F.col("start_ms")), F.lit("-"), clock(F.col("end_ms")))
    said = scored.where(F.col("language") == language).groupBy("meeting_id", stamp().alias("stamp")).agg(F.min_by("predicted", "item_no").alias("said"))
    rows = manifest.withColumn("stamp", stamp()).join(said, ["meeting_id", "stamp"], "left")
    text = F.when(F.col("language") == language, F.coalesce("said", "text")).otherwise(F.col("text"))
    return rows.groupBy("meeting_id").agg(in_order("item_no", F.concat(F.lit("["), "stamp", F.lit("] "), text), "\n").alias("transcript"))


def storage_stats(catalog: DataFrame) -> DataFrame:
    """A5: files and MB per area and in all (area null); hidden names don't count."""
    seen = catalog.where(~F.col("name").startswith("."))
    return seen.rollup("area").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.round(F.sum("bytes") / (1024 * 1024), 2).alias("mb"))


def retention_plan(catalog: DataFrame, policy: DataFrame, today: Column) -> DataFrame:
    """A5: what is older than its area's days: files and bytes. A plan; nothing is deleted. policy (area, days)."""
    old = catalog.where(~F.col("name").startswith(".")).join(policy, "area").where(F.col("mtime") < F.date_sub(today, F.col("days")))
    return old.groupBy("area", "days").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def queue_report(tasks: DataFrame, concurrency: int = 1, minutes: int = 5, full_at: int = 50, shards: str | None = None) -> DataFrame:
    """Waiting tasks (task_id, created_at; of one queue, or of each ``shards`` value) with place and expected wait."""
    keys = [shards] if shards else []
    placed = numbered(tasks.select(*keys, "task_id", "created_at"), keys, ["created_at", "task_id"], "position")
    wait = F.greatest(F.lit(0), F.col("position") - concurrency) * minutes * 60
    return placed.select(*keys, "task_id", "created_at", "position", wait.cast("long").alias("wait_seconds"), (F.col("of") >= full_at).alias("queue_full"))


#: Statuses of tasks at work.
AT_WORK = ("transcribing", "summarizing", "processing")


def queue_states(events: DataFrame, times: list[str]) -> DataFrame:
    """A6, as of: (as_of, task_id, status, since): each task's last status before each of a few times. events (task_id, seq, ts,
    status). One shuffle by task, whatever the number of times; a task without an event before a time has no row."""
    last = [F.max_by(F.when(F.col("ts") < F.lit(t).cast("timestamp"), F.struct("status", "ts")), F.when(F.col("ts") < F.lit(t).cast("timestamp"), F.struct("ts", "seq"))) for t in times]
    each = events.groupBy("task_id").agg(F.array(*[F.struct(F.lit(t).cast("timestamp").alias("as_of"), x.alias("last")) for t, x in zip(times, last, strict=True)]).alias("states"))
    found = each.select("task_id", F.explode("states").alias("s")).where("s.last is not null")
    return found.select("s.as_of", "task_id", "s.last.status", F.col("s.last.ts").alias("since"))


def queue_counts(states: DataFrame) -> DataFrame:
    """(as_of, status, tasks), and all tasks of a time under a null status."""
    counts = states.groupBy("as_of", "status").agg(F.count("*").alias("tasks"))
    return counts.unionByName(counts.groupBy("as_of").agg(F.lit(None).cast("string").alias("status"), F.sum("tasks").alias("tasks")))


def queue_status(states: DataFrame, concurrency: int = 1, minutes: int = 5, full_at: int = 50, queued: str = "queued", at_work: tuple[str, ...] = AT_WORK) -> DataFrame:
    """Per time how many tasks wait and are at work, what the next one would wait, and whether the queue is full."""
    n = F.count_if(F.col("status") == queued)
    wait = F.greatest(F.lit(0), n + 1 - concurrency) * minutes * 60
    return states.groupBy("as_of").agg(n.alias("total_queued"), F.count_if(F.col("status").isin(*at_work)).alias("processing_count"), wait.cast("long").alias("estimated_wait_seconds"), (n >= full_at).alias("queue_full"))


def queue_places(states: DataFrame, concurrency: int = 1, minutes: int = 5, full_at: int = 50, queued: str = "queued") -> DataFrame:
    """Of each time's waiting tasks the place and the expected wait, first come first."""
    waiting = states.where(F.col("status") == queued).select("as_of", "task_id", F.col("since").alias("created_at"))
    return queue_report(waiting, concurrency, minutes, full_at, "as_of")


def batch_run_report(results: DataFrame) -> DataFrame:
    """Results (run, ok, seconds, audio_seconds, chars_in, chars_out): per run counts, total time, speed, compression.
    A result without output counts as failed."""
    good = F.col("ok") & (F.col("chars_out") > 0)
    return results.groupBy("run").agg(
        F.count_if(good).alias("succeeded"),
        F.count_if(~good).alias("failed"),
        F.count_if(F.col("ok") & (F.col("chars_out") == 0)).alias("empty"),
        F.round(F.sum("seconds"), 3).alias("seconds"),
        F.round(F.try_divide(F.sum("audio_seconds"), F.sum("seconds")), 6).alias("speed"),
        F.round(F.try_divide(F.sum(F.when(good, F.col("chars_out"))).cast("double"), F.sum(F.when(good, F.col("chars_in"))).cast("double")), 6).alias("compression"),
    )


def throughput_report(calls: DataFrame, alarm: float = 5.0) -> DataFrame:
    """Calls (provider, eval_count, eval_ns, load_ns): tokens a second over all calls, slow calls, load seconds."""
    rate = F.try_divide(F.col("eval_count"), F.col("eval_ns") / 1e9)
    return calls.groupBy("provider").agg(
        F.count("*").alias("calls"),
        F.round(F.sum("eval_count") / (F.sum("eval_ns") / 1e9), 6).alias("tokens_per_second"),
        F.count_if(rate < alarm).alias("slow_calls"),
        F.round(F.max("load_ns") / 1e9, 4).alias("max_load_seconds"),
    )


def real_time_factors(calls: DataFrame) -> DataFrame:
    """Adds ``real_time_factor``: elapsed_ms by duration_ms; null without a duration above 0."""
    return calls.withColumn("real_time_factor", F.when(F.col("duration_ms") > 0, F.round(F.col("elapsed_ms") / F.col("duration_ms"), 4)))


def real_time_report(calls: DataFrame) -> DataFrame:
    """Per provider and in all (null): calls with a duration, hours of audio, and the factor over all their time."""
    timed = real_time_factors(calls).where("real_time_factor is not null")
    totals = timed.groupBy("provider").agg(F.count("*").alias("calls"), F.sum("elapsed_ms").alias("elapsed"), F.sum("duration_ms").alias("duration"), F.max("real_time_factor").alias("worst"))
    # The few providers' sums are rolled up, not the calls.
    rolled = totals.rollup("provider").agg(*(F.sum(c).alias(c) for c in ("calls", "elapsed", "duration")), F.max("worst").alias("worst_factor"), F.grouping("provider").alias("all"))
    return rolled.select(F.col("provider"), (F.col("all") == 1).alias("all_providers"), "calls", F.round(F.col("duration") / 3_600_000, 4).alias("audio_hours"), F.round(F.col("elapsed") / F.col("duration"), 4).alias("real_time_factor"), "worst_factor")


#: Size of a quantile sketch: its ranks are right within 0.7 % (99 of 100 times, at 400).
SKETCH_SIZE = 400


def call_sketches(calls: DataFrame, value: Column, *keys: str) -> DataFrame:
    """(keys, calls, sketch): a mergeable sketch of a value, of bounded size, per group; to be kept and merged later."""
    return calls.select(*keys, value.cast("double").alias("value")).where("value is not null").groupBy(*keys).agg(F.count("*").alias("calls"), F.kll_sketch_agg_double("value", F.lit(SKETCH_SIZE)).alias("sketch"))


def sketch_percentiles(sketches: DataFrame, ranks: tuple[float, ...] = (0.5, 0.95), by: str = "provider") -> DataFrame:
    """Sketches merged per ``by`` and over all (null, all_<by>): calls, and an array of the values at ``ranks``."""
    each = sketches.groupBy(by).agg(F.sum("calls").alias("calls"), F.kll_merge_agg_double("sketch").alias("sketch"))
    rolled = each.rollup(by).agg(F.sum("calls").alias("calls"), F.kll_merge_agg_double("sketch").alias("sketch"), F.grouping(by).alias("all"))
    return rolled.select(by, (F.col("all") == 1).alias(f"all_{by}s"), "calls", F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(r)) for r in ranks]).alias("percentiles"))
