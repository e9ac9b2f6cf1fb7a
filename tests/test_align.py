"""Alignment of segments with turns: ties, splits, merges, and the two forms of the interval join."""

import random

import pytest

from parley.operators import align

SEG = "meeting_id string, seg_no int, start_ms long, end_ms long, text string"
TRN = "meeting_id string, turn_no int, start_ms long, end_ms long, speaker int"


def pieces_of(spark, segments, turns, **options):
    s, t = spark.createDataFrame(segments, SEG), spark.createDataFrame(turns, TRN)
    rows = align.split_segments(s, t, **options).orderBy("seg_no", "piece_no").collect()
    return [(r["seg_no"], r["start_ms"], r["end_ms"], r["speaker"], r["text"]) for r in rows]


def test_dominant_speaker_tie_goes_to_the_smaller_id(spark):
    turns = [("m", 0, 0, 500, 2), ("m", 1, 500, 1000, 1)]
    found = align.dominant_speaker(align.overlap_by_speaker(spark.createDataFrame([("m", 0, 0, 1000, "x")], SEG), spark.createDataFrame(turns, TRN))).first()
    assert (found["speaker"], found["overlap"], found["total"], found["share"]) == (1, 500, 1000, 0.5)


def test_split_is_proportional_and_lossless(spark):
    turns = [("m", 0, 0, 5000, 0), ("m", 1, 5000, 10000, 1)]
    assert pieces_of(spark, [("m", 0, 0, 10000, "一二三四五六七八九十")], turns) == [(0, 0, 5000, 0, "一二三四五"), (0, 5000, 10000, 1, "六七八九十")]


def test_clear_majority_short_texts_and_short_times_stay_whole(spark):
    turns = [("m", 0, 0, 7000, 0), ("m", 1, 7000, 10000, 1)]
    assert [p[3] for p in pieces_of(spark, [("m", 0, 0, 10000, "一二三四五六七八九十")], turns)] == [0]
    even = [("m", 0, 0, 500, 0), ("m", 1, 500, 1000, 1)]
    assert len(pieces_of(spark, [("m", 0, 0, 999, "一二三四五六")], even)) == 1
    assert len(pieces_of(spark, [("m", 0, 0, 1000, "一二三")], even)) == 1
    assert len(pieces_of(spark, [("m", 0, 0, 1000, "一二三四")], even)) == 2


def test_no_overlap_takes_the_nearest_turn_the_first_on_ties(spark):
    turns = [("m", 0, 0, 1000, 3), ("m", 1, 5000, 6000, 4)]
    assert pieces_of(spark, [("m", 0, 2500, 3500, "abc")], turns)[0][3] == 3
    assert pieces_of(spark, [("m", 0, 3500, 4500, "abc")], turns)[0][3] == 4
    assert pieces_of(spark, [("x", 0, 0, 1000, "abc")], turns) == []


def brute_allocation(text, weights):
    total, n = sum(weights), len(text)
    counts = [max(1, n * w // total) for w in weights]
    order = sorted(range(len(weights)), key=lambda i: (-weights[i], i))
    while sum(counts) > n and any(c > 1 for c in counts):
        for i in order:
            if sum(counts) > n and counts[i] > 1:
                counts[i] -= 1
    k = 0
    while sum(counts) < n:
        counts[order[k % len(order)]] += 1
        k += 1
    return counts


def test_allocation_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randrange(4, 40), [rng.choice([1, 300, 301, 5000, 90000]) for _ in range(rng.randrange(2, 9))]) for i in range(300)]
    rows = [(i, t, w) for i, t, w in rows if len(w) <= len(t)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "i int, t string, w array<long>").select("i", align._allocation(F.col("w"), F.length("t").cast("long")).alias("c"))
    found = {r["i"]: r["c"] for r in df.collect()}
    assert all(found[i] == brute_allocation(t, w) for i, t, w in rows)


def test_more_speakers_than_characters_loses_nothing(spark):
    turns = [("m", k, k * 1000, k * 1000 + 1000, k) for k in range(6)]
    rows = pieces_of(spark, [("m", 0, 0, 6000, "一二三四")], turns)
    assert "".join(r[4] for r in rows) == "一二三四"


def utterances_of(spark, pieces):
    rows = [("m", i, 0, a, b, s, t, a, b) for i, (a, b, s, t) in enumerate(pieces)]
    df = spark.createDataFrame(rows, "meeting_id string, seg_no int, piece_no int, start_ms long, end_ms long, speaker int, text string, seg_start long, seg_end long")
    return [tuple(r)[2:] for r in align.merge_utterances(df).orderBy("utt_no").collect()]


def test_merge_by_speaker_and_gap_with_spacing(spark):
    assert utterances_of(spark, [(0, 1000, 1, "大家好"), (2500, 3000, 1, "ok"), (4501, 5000, 1, "go"), (5000, 6000, 2, "是"), (6000, 6500, 1, "x")]) == [(0, 3000, 1, "大家好 ok"), (4501, 5000, 1, "go"), (5000, 6000, 2, "是"), (6000, 6500, 1, "x")]
    assert utterances_of(spark, [(0, 9000, 1, "ab"), (1000, 2000, 1, "cd"), (10000, 11000, 1, "會")]) == [(0, 11000, 1, "ab cd 會")]


def test_labels_rank_by_time_then_id(spark):
    u = spark.createDataFrame([("m", 1, 0, 1000, 5, "甲" * 50), ("m", 2, 1000, 2000, 3, "b"), ("m", 3, 2000, 5000, 9, "c")], "meeting_id string, utt_no int, start_ms long, end_ms long, speaker int, text string")
    rows = align.label_speakers(u).orderBy("rank").collect()
    assert [(r["speaker"], r["label"]) for r in rows] == [(9, "發言者1"), (3, "發言者2"), (5, "發言者3")]
    assert rows[2]["first_text"] == "甲" * 40 and rows[0]["share"] == 0.6
    text = align.render_transcript(u, align.label_speakers(u)).first()["text"]
    assert "[00:00:02-00:00:05] 發言者1：c" in text and "（60%，1 段，首次發言 00:00:02）" in text


@pytest.mark.parametrize("bucket", [1, 700, 60_000])
def test_bucketed_join_equals_the_plain_one(spark, bucket):
    rng = random.Random(bucket)
    span = lambda: (a := rng.randrange(20000), a + rng.choice([0, 1, 699, 700, 5000]))
    segments = spark.createDataFrame([(f"m{i % 3}", i, *span(), "x") for i in range(60)], SEG)
    turns = spark.createDataFrame([(f"m{i % 3}", i, *span(), i % 4) for i in range(60)], TRN)
    plain = sorted(map(tuple, align.overlap_by_speaker(segments, turns, None).collect()))
    assert sorted(map(tuple, align.overlap_by_speaker(segments, turns, max(bucket, 500) if bucket == 1 else bucket).collect())) == plain
