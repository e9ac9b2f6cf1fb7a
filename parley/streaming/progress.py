"""Progress events of tasks: parsing, latest state, duplicates, idle tasks, rates, live utterances, durations.

Each function takes a batch or a streaming DataFrame where its plan allows both; the stateful ones for streams use built-in
stateful operators or applyInPandasWithState, and equal their batch forms on the same rows, in whatever batches they come
within the watermark. State doesn't only grow: windows and sessions go once the watermark has passed them, a task's own state
once it has been silent for ``keep_ms``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parley.functions.folds import fold_rows

# Keys that may hold a fraction, in order; statuses that end a task.
FRACTION_KEYS = ("fraction", "progress", "percent", "percentage", "completed", "value", "ratio")
TERMINAL = ("completed", "failed", "cancelled")


def progress_fraction(line: Column) -> Column:
    """Of a JSON line the first valid fraction of the known keys; above 1, or a percentage, is divided by 100; 0 to 1.
    Null for noise."""
    object_ = F.try_parse_json(line).isNotNull() & F.ltrim(line).startswith("{")
    read = []
    for k in FRACTION_KEYS:
        x = F.get_json_object(line, f"$.{k}").try_cast("double")
        share = x / 100 if k.startswith("percent") else F.when(x > 1, x / 100).otherwise(x)
        read.append(F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e300), share))
    found = F.coalesce(*read)
    return F.when(object_ & found.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), found)))


def progress_stream(lines: DataFrame) -> DataFrame:
    """Adds ``fraction`` and leaves out lines without one."""
    return lines.withColumn("fraction", progress_fraction(F.col("line"))).where("fraction is not null")


def latest_task_state(events: DataFrame) -> DataFrame:
    """Per task the newest event; once a task has ended, its first terminal event stays. events (task_id, seq, ts,
    status, progress). On a stream in update mode: a row of state a task, which is what it is for."""
    ended = F.col("status").isin(*TERMINAL)
    pick = F.struct("seq", "ts", "status", "progress")
    found = events.groupBy("task_id").agg(F.min_by(F.when(ended, pick), F.when(ended, F.col("seq"))).alias("end"), F.max_by(pick, "seq").alias("last"))
    return found.select("task_id", F.coalesce("end", "last").alias("e")).select("task_id", "e.*")


def dedup_events(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each seq once; on a stream within the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["seq"])
    return events.dropDuplicates(["seq"])


def activity_sessions(events: DataFrame, timeout: str = "120 seconds", delay: str = "10 minutes") -> DataFrame:
    """(task_id, first_ts, idle_at, events): runs of events without a gap of the timeout; idle_at is when it is up."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy("task_id", F.session_window("ts", timeout).alias("w")).agg(F.count("*").alias("events")).select("task_id", F.col("w.start").alias("first_ts"), F.col("w.end").alias("idle_at"), "events")


def status_throughput(events: DataFrame, size: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Events and mean progress per status and window, tumbling or sliding."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(w.alias("w"), "status").agg(F.count("*").alias("events"), F.round(F.avg("progress"), 6).alias("mean_progress")).select(F.col("w.start").alias("window_start"), "status", "events", "mean_progress")


def live_utterances(pieces: DataFrame, gap: str = "1500 milliseconds", delay: str = "10 minutes") -> DataFrame:
    """(meeting_id, speaker, start_ts, end_ts, pieces) of pieces (ts begins, end_ts ends) that follow within the gap.

    Unlike merging in a finished meeting, another speaker in between doesn't end the run, as the key is the speaker. A
    session lasts from a piece's start to its own end and the gap.
    """
    rows = pieces.withWatermark("ts", delay) if pieces.isStreaming else pieces
    milliseconds = F.lit(int(gap.split()[0])) + (F.unix_millis("end_ts") - F.unix_millis("ts"))
    session = F.session_window("ts", F.concat(milliseconds.cast("string"), F.lit(" milliseconds")))
    return rows.groupBy("meeting_id", "speaker", session.alias("w")).agg(F.max("end_ts").alias("end_ts"), F.count("*").alias("pieces")).select("meeting_id", "speaker", F.col("w.start").alias("start_ts"), "end_ts", "pieces")


NO_SEQ = -(1 << 63)
#: What a task remembers, as a tuple; None before its first event.
Memory = tuple | None
Rows = list[tuple]


def in_event_order(events: DataFrame, value: str, memory: str, advance: Callable[[Memory, int, int, object], tuple[Memory, Rows]], close: Callable[[Memory, int], tuple[Memory, Rows, int]], out: str, delay: str) -> DataFrame:
    """A stream of (task_id, seq, ts, ``value``), each task's events in the order of ts and seq whatever batches they come in.

    Events wait in the task's state until the watermark has passed them, as only then none can come before them; a timer
    on the first of them lets them go without a new event. ``advance(memory, at, seq, value)`` takes one event in its turn,
    ``close(memory, watermark)`` says what time alone does and when it is to be asked again; both give rows of ``out``
    (without task_id) and the memory, of the fields ``memory``; a task that remembers nothing and has no event waiting
    leaves the state. Times are microseconds. An event without a time is left out, one behind the watermark is late.
    """
    kind = events.schema[value].dataType.simpleString()
    fields = T.StructType.fromDDL(memory)
    names = ["task_id", *T.StructType.fromDDL(out).names]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            at, seq, values, known, *told = state.get
            waiting, held = list(zip(at, seq, values, strict=True)), tuple(told) if known else None
        else:
            waiting, held = [], None
        if not state.hasTimedOut:
            for df in batches:
                plain = [None if pd.isna(v) else v for v in df[value]]
                waiting += zip((int(t.value // 1000) for t in df["ts"]), (None if n == NO_SEQ else int(n) for n in df["seq"]), plain, strict=True)
        now = state.getCurrentWatermarkMs()
        passed = [w for w in waiting if w[0] <= now * 1000]
        waiting = [w for w in waiting if w[0] > now * 1000]
        made: Rows = []
        for w in sorted(passed, key=lambda w: (w[0], NO_SEQ if w[1] is None else w[1])):
            held, rows = advance(held, *w)
            made += rows
        again = None
        if held is not None:
            held, rows, again = close(held, now * 1000)
            made += rows
        if held is None and not waiting:
            if state.exists:
                state.remove()
        else:
            at, seq, values = (list(x) for x in zip(*waiting, strict=True)) if waiting else ([], [], [])
            state.update((at, seq, values, held is not None, *(held or [None] * len(fields))))
            due = min([w[0] for w in waiting] + ([again] if held is not None else []))
            state.setTimeoutTimestamp(max(due // 1000, now + 1))
        yield pd.DataFrame([(key[0], *r) for r in made], columns=names)

    # A missing number goes as the least one, as pandas would make all of a batch fractions.
    numbered = events.withColumn("seq", F.coalesce(F.col("seq").cast("long"), F.lit(NO_SEQ)))
    rows = numbered.select(*dict.fromkeys(["task_id", "seq", "ts", value])).where("ts is not null").withWatermark("ts", delay)
    kept = f"at array<long>, seq array<long>, waiting array<{kind}>, known boolean, {memory}"
    return rows.groupBy("task_id").applyInPandasWithState(step, f"task_id long, {out}", kept, "append", GroupStateTimeout.EventTimeTimeout)


def stage_durations(events: DataFrame) -> DataFrame:
    """X7, batch: (task_id, seq, status, seconds) from an event to the next of its task; the last has null."""
    w = W.partitionBy("task_id").orderBy("ts", "seq")
    gap = (F.unix_micros(F.lead("ts").over(w)) - F.unix_micros("ts")) / 1_000_000
    return events.select("task_id", "seq", "status", gap.alias("seconds"))


def stage_durations_stream(events: DataFrame, keep_ms: int = 86_400_000, delay: str = "10 minutes") -> DataFrame:
    """X7, stream: an event's row comes once the watermark has passed the next; a task is forgotten after ``keep_ms``."""

    def advance(held: Memory, at: int, seq: int, status: object) -> tuple[Memory, Rows]:
        return (at, seq, status), [] if held is None else [(held[1], held[2], (at - held[0]) / 1_000_000)]

    def close(held: Memory, now: int) -> tuple[Memory, Rows, int]:
        until = held[0] + keep_ms * 1000
        return (None if until < now else held), [], until

    return in_event_order(events, "status", "past_at long, past_seq long, past_status string", advance, close, "seq long, status string, seconds double", delay)


def monotone_progress(events: DataFrame) -> DataFrame:
    """X8, batch: adds ``shown``, the most progress so far."""
    return events.withColumn("shown", F.max("progress").over(W.partitionBy("task_id").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)))


def monotone_progress_stream(events: DataFrame, keep_ms: int = 86_400_000, delay: str = "10 minutes") -> DataFrame:
    """X8, stream: the running maximum is the task's memory, which goes after ``keep_ms``."""

    def advance(held: Memory, at: int, seq: int, progress: object) -> tuple[Memory, Rows]:
        known = [x for x in (held[0] if held else None, progress) if x is not None]
        top = float(max(known)) if known else None
        return (top, at), [(seq, progress, top)]

    def close(held: Memory, now: int) -> tuple[Memory, Rows, int]:
        until = held[1] + keep_ms * 1000
        return (None if until < now else held), [], until

    return in_event_order(events, "progress", "top double, past_at long", advance, close, "seq long, progress double, shown double", delay)


def task_limits(events: DataFrame, idle_ms: int, total_ms: int) -> DataFrame:
    """X4, batch, two limits: (task_id, first_ts, ended_at, reason, events) for each run of a task's events. A run ends ``idle_ms``
    after its last event ('idle') or ``total_ms`` after its first ('total'), whichever is earlier; an event at that time or
    later begins the next run. One pass over a task's sorted events."""

    def start() -> Callable[[tuple], tuple]:
        run, first, last = -1, 0, 0

        def step(values: tuple) -> tuple:
            nonlocal run, first, last
            at = values[0]
            if run < 0 or at >= min(last + idle_ms * 1000, first + total_ms * 1000):
                run, first = run + 1, at
            last = at
            return (run,)

        return step

    timed = events.where("ts is not null").select("task_id", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    runs = fold_rows(timed, "task_id", ["at", "seq"], ["at"], start, "run int").groupBy("task_id", "run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("events"))
    idle, total = F.col("last") + idle_ms * 1000, F.col("first") + total_ms * 1000
    return runs.select("task_id", F.timestamp_micros("first").alias("first_ts"), F.timestamp_micros(F.least(idle, total)).alias("ended_at"), F.when(total < idle, "total").otherwise("idle").alias("reason"), "events")


def task_limits_stream(events: DataFrame, idle_ms: int, total_ms: int, delay: str = "10 minutes") -> DataFrame:
    """X4, stream, two limits: as ``task_limits``; a run's row comes when the watermark has passed the limit that ran out."""

    def ended(held: Memory) -> tuple[int, str]:
        idle, total = held[1] + idle_ms * 1000, held[0] + total_ms * 1000
        return (total, "total") if total < idle else (idle, "idle")

    def row(held: Memory) -> tuple:
        at, reason = ended(held)
        return (held[0], at, reason, held[2])

    def advance(held: Memory, at: int, seq: int, value: object) -> tuple[Memory, Rows]:
        if held is not None and at < ended(held)[0]:
            return (held[0], at, held[2] + 1), []
        return (at, at, 1), [] if held is None else [row(held)]

    def close(held: Memory, now: int) -> tuple[Memory, Rows, int]:
        at = ended(held)[0]
        return (None, [row(held)], at) if at <= now else (held, [], at)

    found = in_event_order(events, "seq", "first_at long, last_at long, n long", advance, close, "first long, ended long, reason string, events long", delay)
    return found.select("task_id", F.timestamp_micros("first").alias("first_ts"), F.timestamp_micros("ended").alias("ended_at"), "reason", "events")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", keys: list[str] = ()) -> DataFrame:
    """Runs a streaming frame over what is there now and returns its rows, by way of Parquet files. In update mode, the
    last version of each of ``keys``."""
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", path).outputMode("append")
    else:
        # A batch that is run again after a failure writes its own folder again.
        def put(df: DataFrame, batch: int) -> None:
            df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

        writer = stream.writeStream.foreachBatch(put).outputMode(mode)
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark = stream.sparkSession
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(path)
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    last = F.max_by(F.struct(*stream.columns), "batch").alias("row")
    return rows.groupBy(*(F.col(k).alias(f"of_{k}") for k in keys)).agg(last).select("row.*")
