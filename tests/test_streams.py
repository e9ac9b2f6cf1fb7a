"""Streams whose events come shuffled over batches, against the batch forms and plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parley.plans import q_streams
from parley.streaming import progress

KINDS = "task_id long, seq long, ts timestamp, status string, progress double"
NOON = datetime(2024, 1, 1, 12)


def some_events(seed=4, n=300):
    r = random.Random(seed)
    rows = []
    for seq in range(n):
        at = NOON + timedelta(seconds=r.choice([r.randrange(0, 4000), r.randrange(0, 40) * 60]), microseconds=r.choice([0, 1, 999_999]))
        rows.append((r.randrange(12), seq, at, r.choice(["queued", "transcribing", "completed"]), r.choice([None, round(r.random(), 2)])))
    return rows


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """A stream whose batches are random parts of the events; a last one, far behind, closes."""
    rows = some_events()
    random.Random(9).shuffle(rows)
    path = str(tmp_path_factory.mktemp("events"))
    parts = [rows[i::5] for i in range(5)] + [[(None, None, NOON + timedelta(days=4000), None, None)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, KINDS).coalesce(1).withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{path}/part={i}")
    stream = lambda: spark.readStream.schema(f"{KINDS}, batch int").option("maxFilesPerTrigger", 1).parquet(path + "/part=*").drop("batch")
    return spark.createDataFrame(some_events(), KINDS), stream


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_durations(shuffled):
    events, stream = shuffled
    found = q_streams.run(progress.stage_durations_stream(stream(), keep_ms=q_streams.YEARS, delay="1000 days"))
    expected = progress.stage_durations(events).where("seconds is not null")
    assert rows_of(found) == rows_of(expected)
    assert found.where("seconds < 0").isEmpty()


def test_progress(shuffled):
    events, stream = shuffled
    found = q_streams.run(progress.monotone_progress_stream(stream(), keep_ms=q_streams.YEARS, delay="1000 days"))
    expected = progress.monotone_progress(events).select("task_id", "seq", "progress", "shown")
    assert rows_of(found) == rows_of(expected)


def runs_by_hand(events, idle, total):
    found = []
    for task in {e[0] for e in events}:
        run = None
        for at in sorted(e[2] for e in events if e[0] == task):
            if run and at < min(run[1] + idle, run[0] + total):
                run[1:] = at, run[2] + 1
                continue
            if run:
                found.append((task, *run))
            run = [at, at, 1]
        found.append((task, *run))
    return [(task, a, min(b + idle, a + total), "total" if a + total < b + idle else "idle", n) for task, a, b, n in found]


@pytest.mark.parametrize(("idle", "total"), [(120, 600), (60, 10_000), (900, 900)])
def test_limits(shuffled, idle, total):
    events, stream = shuffled
    expected = sorted(runs_by_hand(some_events(), timedelta(seconds=idle), timedelta(seconds=total)), key=str)
    assert rows_of(progress.task_limits(events, idle * 1000, total * 1000)) == expected
    assert rows_of(q_streams.run(progress.task_limits_stream(stream(), idle * 1000, total * 1000, "1000 days"))) == expected
    assert (total == 10_000) != any(r[3] == "total" for r in expected)


def test_a_silent_task_leaves_the_state(spark, tmp_path):
    parts = [[(1, 0, NOON, "queued", 0.5)], [(2, 1, NOON + timedelta(hours=3), "queued", 0.1)], [(1, 2, NOON + timedelta(hours=6), "queued", 0.2)], [(3, 3, NOON + timedelta(hours=20), "queued", 0.3)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, KINDS).coalesce(1).write.parquet(f"{tmp_path}/part={i}")
    stream = spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/part=*")
    found = q_streams.run(progress.monotone_progress_stream(stream, keep_ms=3_600_000, delay="1 minute"))
    assert rows_of(found) == [(1, 0, 0.5, 0.5), (1, 2, 0.2, 0.2), (2, 1, 0.1, 0.1)]
