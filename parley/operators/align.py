"""Transcript building: interval joins of segments with speaker turns, splitting, merging, labels, timelines.

Tables: segments (meeting_id, seg_no, start_ms, end_ms, text), turns (meeting_id, turn_no, start_ms, end_ms, speaker).
All work is keyed by meeting_id; a meeting's rows are few, and no step holds more than one key's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions.text import clock, gap_between, in_order

BUCKET_MS = 60_000


def overlap_ms(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start)).cast("long")


def overlapping(left: DataFrame, right: DataFrame, key: str = "meeting_id", bucket_ms: int | None = BUCKET_MS) -> DataFrame:
    """Pairs of rows of a key whose half-open intervals share time, with ``overlap``.

    Columns of the right side other than the key must have names of their own, its times r_start and r_end. With a bucket
    width, intervals meet by (key, bucket), so a long meeting costs its overlaps and not its square; a pair is kept only
    in the bucket where it begins. Without, the join is on the key with the times as a further condition.
    """
    meet = (F.col("start_ms") < F.col("r_end")) & (F.col("r_start") < F.col("end_ms"))
    took = overlap_ms(F.col("start_ms"), F.col("end_ms"), F.col("r_start"), F.col("r_end")).alias("overlap")
    if bucket_ms is None:
        pairs = left.join(right, key).where(meet)
        return pairs.select("*", took).where("overlap > 0")
    buckets = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket_ms), F.floor(F.col(b) / bucket_ms))).alias("bucket")
    l_rows = left.where(F.col("end_ms") > F.col("start_ms")).select("*", buckets("start_ms", "end_ms"))
    r_rows = right.where(F.col("r_end") > F.col("r_start")).select("*", buckets("r_start", "r_end"))
    first = F.floor(F.greatest("start_ms", "r_start") / bucket_ms) == F.col("bucket")
    return l_rows.join(r_rows, [key, "bucket"]).where(meet & first).drop("bucket").select("*", took)


def as_right(turns: DataFrame) -> DataFrame:
    return turns.withColumnsRenamed({"start_ms": "r_start", "end_ms": "r_end"})


def overlap_by_speaker(segments: DataFrame, turns: DataFrame, bucket_ms: int | None = BUCKET_MS) -> DataFrame:
    """(meeting_id, seg_no, speaker, overlap), overlap above 0."""
    pairs = overlapping(segments.select("meeting_id", "seg_no", "start_ms", "end_ms"), as_right(turns.select("meeting_id", "start_ms", "end_ms", "speaker")), bucket_ms=bucket_ms)
    return pairs.groupBy("meeting_id", "seg_no", "speaker").agg(F.sum("overlap").alias("overlap"))


def dominant_speaker(overlaps: DataFrame) -> DataFrame:
    """Per segment the speaker of most overlap (smaller id on ties), its overlap, the total and its share."""
    best = F.max_by("speaker", F.struct("overlap", -F.col("speaker")))
    found = overlaps.groupBy("meeting_id", "seg_no").agg(best.alias("speaker"), F.max("overlap").alias("overlap"), F.sum("overlap").alias("total"))
    return found.withColumn("share", F.round(F.col("overlap") / F.col("total"), 6))


def nearest_turn(segments: DataFrame, turns: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Segments without any overlap get the speaker of the turn nearest to their middle; first turn on ties."""
    lone = segments.join(overlaps.select("meeting_id", "seg_no").distinct(), ["meeting_id", "seg_no"], "left_anti")
    # Twice the times, so that middles are whole. The nearest end or start is the last before the middle or the first after.
    ends = turns.select("meeting_id", F.explode(F.array(2 * F.col("start_ms"), 2 * F.col("end_ms"))).alias("at"), F.struct("turn_no", "speaker").alias("turn"))
    points = ends.groupBy("meeting_id", "at").agg(F.min("turn").alias("turn")).withColumn("seg_no", F.lit(None).cast(segments.schema["seg_no"].dataType))
    middles = lone.select("meeting_id", (F.col("start_ms") + F.col("end_ms")).alias("at"), F.lit(None).cast(points.schema["turn"].dataType).alias("turn"), "seg_no")
    by = W.partitionBy("meeting_id").rowsBetween(W.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("turn").isNotNull(), F.struct("at", "turn")), ignorenulls=True)
    laid = points.unionByName(middles).withColumn("before", seen.over(by.orderBy("at", F.asc_nulls_first("seg_no")))).withColumn("after", seen.over(by.orderBy(F.desc("at"), F.desc_nulls_last("seg_no")))).where("seg_no IS NOT NULL")
    near = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("at") - F.col(f"{c}.at")).alias("d"), F.col(f"{c}.turn").alias("turn")))
    found = laid.withColumn("m", F.least(near("before"), F.coalesce(near("after"), near("before")))).withColumn("m", F.coalesce("m", near("after"))).where("m IS NOT NULL")
    return found.select("meeting_id", "seg_no", "m.turn.turn_no", "m.turn.speaker", (F.col("m.d") / 2).alias("distance_ms"))


def _allocation(weights: Column, length: Column) -> Column:
    """Characters of each part: floor of its share, at least one; an excess is taken from the heaviest parts in turn, a
    rest is given to them in turn. weights: array of long."""
    total = F.aggregate(weights, F.lit(0).cast("long"), lambda a, w: a + w)
    base = F.transform(weights, lambda w: F.greatest(F.lit(1).cast("long"), F.floor(length * w / total).cast("long")))
    order = F.transform(F.array_sort(F.transform(weights, lambda w, i: F.struct((-w).alias("w"), i.alias("i")))), lambda x: x["i"])
    rest = lambda counts: length - F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)

    def settle(args: Column) -> Column:
        n = F.size(args["counts"])
        change = rest(args["counts"])

        def step(state: Column, t: Column) -> Column:
            at = F.get(args["order"], (t % n).cast("int"))
            room = F.get(state["counts"], at)
            d = F.when(state["left"] > 0, 1).when((state["left"] < 0) & (room > 1), -1).otherwise(0).cast("long")
            return F.struct(F.transform(state["counts"], lambda c, i: F.when(i == at, c + d).otherwise(c)).alias("counts"), (state["left"] - d).alias("left"))

        turns = F.sequence(F.lit(0), (n * F.greatest(F.lit(1), F.abs(change)) - 1).cast("int"))
        done = F.aggregate(turns, F.struct(args["counts"].alias("counts"), change.alias("left")), step, lambda s: s["counts"])
        return F.when(change == 0, args["counts"]).otherwise(done)

    return F.get(F.transform(F.array(F.struct(base.alias("counts"), order.alias("order"))), settle), F.lit(0))


def split_segments(segments: DataFrame, turns: DataFrame, min_share: float = 0.6, min_chars: int = 4, min_ms: int = 1000, min_overlap_ms: int = 300, bucket_ms: int | None = BUCKET_MS) -> DataFrame:
    """T4: pieces (meeting_id, seg_no, piece_no, start_ms, end_ms, speaker, text, seg_start, seg_end).

    A segment whose dominant share is small, and that is long enough with two speakers or more, is cut in proportion, in
    order of speaker ids; characters are not lost. Others go to the dominant speaker, or without overlap to the nearest.
    """
    usable = segments.where(F.trim("text") != "")
    overlaps = overlap_by_speaker(usable, turns, bucket_ms)
    per = overlaps.groupBy("meeting_id", "seg_no").agg(F.sum("overlap").alias("total"), F.max_by("speaker", F.struct("overlap", -F.col("speaker"))).alias("dominant"), F.max("overlap").alias("top"), F.array_sort(F.collect_list(F.struct("speaker", "overlap"))).alias("all"))
    near = nearest_turn(usable, turns, overlaps).select("meeting_id", "seg_no", F.col("speaker").alias("near"))
    rows = usable.join(per, ["meeting_id", "seg_no"], "left").join(near, ["meeting_id", "seg_no"], "left").where(F.coalesce("dominant", "near").isNotNull())
    parts = F.filter(F.coalesce("all", F.array()), lambda x: x["overlap"] >= min_overlap_ms)
    duration = F.col("end_ms") - F.col("start_ms")
    cut = (F.col("top") < min_share * F.col("total")) & (F.length("text") >= min_chars) & (duration >= min_ms) & (F.size(parts) >= 2)
    rows = rows.withColumn("parts", F.when(cut, parts)).withColumn("counts", F.when(cut, _allocation(F.transform(parts, lambda x: x["overlap"]), F.length("text").cast("long"))))
    before = lambda values, i: F.aggregate(F.slice(values, 1, i), F.lit(0).cast("long"), lambda a, x: a + x)
    at = lambda i: F.col("start_ms") + F.floor(duration * before(F.transform("parts", lambda x: x["overlap"]), i) / F.col("total")).cast("long")
    made = lambda p, i: F.struct(i.alias("piece_no"), at(i).alias("start_ms"), F.when(i == F.size("parts") - 1, F.col("end_ms")).otherwise(at(i + 1)).alias("end_ms"), p["speaker"].alias("speaker"), F.substring(F.col("text"), (before(F.col("counts"), i) + 1).cast("int"), F.get("counts", i).cast("int")).alias("text"))
    whole = F.array(F.struct(F.lit(0).alias("piece_no"), "start_ms", "end_ms", F.coalesce("dominant", "near").alias("speaker"), "text"))
    pieces = rows.select("meeting_id", "seg_no", F.col("start_ms").alias("seg_start"), F.col("end_ms").alias("seg_end"), F.explode(F.coalesce(F.transform("parts", made), whole)).alias("p"))
    return pieces.select("meeting_id", "seg_no", "p.*", "seg_start", "seg_end").where(F.trim("text") != "")


def merge_utterances(pieces: DataFrame, gap_ms: int = 1500) -> DataFrame:
    """T5: consecutive pieces of a speaker that follow within the gap become one utterance.

    Inside a run of one speaker, a break comes where the start is beyond the running end by more than the gap; as ends
    never fall below starts, the running maximum over the whole run breaks at the same places as one restarted at breaks.
    """
    order = [F.col(c) for c in ("seg_start", "seg_end", "seg_no", "piece_no")]
    w = W.partitionBy("meeting_id").orderBy(*order)
    changed = (~F.lag("speaker").over(w).eqNullSafe(F.col("speaker"))).cast("int")
    rows = pieces.withColumn("n", F.row_number().over(w)).withColumn("changed", changed)
    rows = rows.withColumn("run", F.sum("changed").over(W.partitionBy("meeting_id").orderBy("n")))
    in_run = W.partitionBy("meeting_id", "run").orderBy("n")
    reached = F.max("end_ms").over(in_run.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("broken", F.coalesce((F.col("start_ms") > reached + gap_ms).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("broken").over(W.partitionBy("meeting_id").orderBy("n")))
    in_island = W.partitionBy("meeting_id", "island").orderBy("n")
    rows = rows.withColumn("joined", F.concat(F.coalesce(gap_between(F.right(F.lag("text").over(in_island), F.lit(1)), F.left("text", F.lit(1))), F.lit("")), "text"))
    found = rows.groupBy("meeting_id", F.col("island").cast("int").alias("utt_no")).agg(F.min_by("start_ms", "n").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.first("speaker").alias("speaker"), in_order("n", "joined").alias("text"))
    return found.select("meeting_id", "utt_no", "start_ms", "end_ms", "speaker", "text")


def label_speakers(utterances: DataFrame, prefix: str = "發言者") -> DataFrame:
    """Per meeting and speaker: rank by total time, label, seconds, share, utterances, first start and text."""
    first = F.min_by(F.struct("start_ms", F.left("text", F.lit(40)).alias("text")), F.col("utt_no"))
    stats = utterances.groupBy("meeting_id", "speaker").agg(F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).cast("long").alias("total_ms"), F.count("*").alias("utterance_count"), first.alias("first"))
    rank = F.row_number().over(W.partitionBy("meeting_id").orderBy(F.desc("total_ms"), "speaker"))
    whole = F.sum("total_ms").over(W.partitionBy("meeting_id"))
    share = F.round(F.col("total_ms") / F.when(whole == 0, F.lit(1)).otherwise(whole), 6)
    return stats.select("meeting_id", "speaker", rank.alias("rank"), F.concat(F.lit(prefix), rank.cast("string")).alias("label"), "total_ms", share.alias("share"), "utterance_count", F.col("first.start_ms").alias("first_seen"), F.col("first.text").alias("first_text"))


#: The note at the head of a labelled transcript (a parameter; any text will do).
NOTE = "【發言者標註說明】「發言者N」為分群編號，不是姓名；編號依發言時間由多到少排序。"


def render_transcript(utterances: DataFrame, stats: DataFrame, note: str = NOTE) -> DataFrame:
    """(meeting_id, text): the note, a block of statistics, a blank line, and a stamped line per utterance."""
    percent = F.concat(F.round(F.col("share") * 100).cast("int").cast("string"), F.lit("%"))
    head = F.concat(F.lit("- "), "label", F.lit("："), clock(F.col("total_ms")), F.lit("（"), percent, F.lit("，"), F.col("utterance_count").cast("string"), F.lit(" 段，首次發言 "), clock(F.col("first_seen")), F.lit("） 首句節錄："), "first_text")
    heads = stats.groupBy("meeting_id").agg(in_order("rank", head, "\n").alias("heads"))
    line = F.concat(F.lit("["), clock(F.col("start_ms")), F.lit("-"), clock(F.col("end_ms")), F.lit("] "), "label", F.lit("："), "text")
    body = utterances.join(stats.select("meeting_id", "speaker", "label"), ["meeting_id", "speaker"]).groupBy("meeting_id").agg(in_order("utt_no", line, "\n").alias("body"))
    return heads.join(body, "meeting_id").select("meeting_id", F.concat_ws("\n", F.lit(note), F.lit("【發言者統計】"), "heads", F.lit(""), "body").alias("text"))


def stitch_windows(windows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of windows decoded apart, at absolute times; a window without usable times becomes one chunk.

    windows (meeting_id, win_no, offset_ms, length_ms, text), chunks (meeting_id, win_no, chunk_no, start_ms, end_ms, text).
    """
    good = chunks.where(F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull() & (F.col("end_ms") > F.col("start_ms")) & (F.trim("text") != ""))
    moved = good.join(windows.select("meeting_id", "win_no", "offset_ms"), ["meeting_id", "win_no"]).select("meeting_id", "win_no", "chunk_no", (F.col("start_ms") + F.col("offset_ms")).alias("start_ms"), (F.col("end_ms") + F.col("offset_ms")).alias("end_ms"), "text")
    bare = windows.join(good.select("meeting_id", "win_no").distinct(), ["meeting_id", "win_no"], "left_anti").where(F.trim("text") != "")
    whole = bare.select("meeting_id", "win_no", F.lit(0).alias("chunk_no"), F.col("offset_ms").alias("start_ms"), (F.col("offset_ms") + F.col("length_ms")).alias("end_ms"), "text")
    return moved.unionByName(whole)


def build_timeline(items: DataFrame, key: str = "meeting_id", order: str = "item_no", length: str = "len_ms", silence_ms: int = 350) -> DataFrame:
    """Clips end to end with silence between; adds start_ms and end_ms."""
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col(length) + silence_ms).over(before), F.lit(0)).cast("long")
    return items.withColumn("start_ms", start).withColumn("end_ms", F.col("start_ms") + F.col(length))


def pattern_interleave(sources: DataFrame, pattern: list[str], n_slots: int, key: str = "meeting_id") -> DataFrame:
    """Slot i takes category pattern[i mod len]; each category's sources come round in order of item_no.

    sources (key, category, item_no, ...). A category without sources leaves its slots empty.
    """
    numbered = sources.withColumn("at", (F.row_number().over(W.partitionBy(key, "category").orderBy("item_no")) - 1).cast("long"))
    cycle = F.array(*[F.lit(x) for x in pattern])
    slots = sources.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(n_slots - 1))).alias("slot"))
    category = F.get(cycle, F.col("slot") % len(pattern))
    # How often the category had a slot before: whole rounds, and in this round.
    before = [pattern[:i].count(c) for i, c in enumerate(pattern)]
    per_round = F.create_map(*[F.lit(x) for c in dict.fromkeys(pattern) for x in (c, pattern.count(c))])
    turn = F.floor(F.col("slot") / len(pattern)) * per_round[category] + F.get(F.array(*[F.lit(b) for b in before]), F.col("slot") % len(pattern))
    slots = slots.select(key, "slot", category.alias("category"), turn.cast("long").alias("turn"))
    sizes = sources.groupBy(key, "category").agg(F.count("*").alias("of"))
    slots = slots.join(sizes, [key, "category"]).withColumn("at", F.col("turn") % F.col("of")).drop("turn", "of")
    return slots.join(numbered, [key, "category", "at"]).drop("at")


def classify_by_overlap(chunks: DataFrame, manifest: DataFrame, bucket_ms: int | None = BUCKET_MS) -> DataFrame:
    """Per chunk (meeting_id, seg_no) the language of the item with most overlap, the first on ties; else unknown."""
    right = as_right(manifest.select("meeting_id", "item_no", "start_ms", "end_ms", "language"))
    pairs = overlapping(chunks.select("meeting_id", "seg_no", "start_ms", "end_ms"), right, bucket_ms=bucket_ms)
    best = pairs.groupBy("meeting_id", "seg_no").agg(F.max_by("language", F.struct("overlap", -F.col("item_no"))).alias("language"), F.max("overlap").alias("overlap"))
    return chunks.select("meeting_id", "seg_no").join(best, ["meeting_id", "seg_no"], "left").select("meeting_id", "seg_no", F.coalesce("language", F.lit("unknown")).alias("language"), F.coalesce("overlap", F.lit(0)).cast("long").alias("overlap"))


def union_of_intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, island, start_ms, end_ms): intervals that touch or overlap become one."""
    w = W.partitionBy(*keys).orderBy("start_ms", "end_ms")
    reached = F.max("end_ms").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.where(F.col("end_ms") > F.col("start_ms")).withColumn("new", F.coalesce((F.col("start_ms") > reached).cast("int"), F.lit(1)))
    return marked.withColumn("island", F.sum("new").over(w)).groupBy(*keys, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


def diarization_coverage(segments: DataFrame, turns: DataFrame, short_ms: int = 5000) -> DataFrame:
    """Per meeting the length, the share that turns cover, speakers, the largest's share, speakers under 5 s."""
    length = segments.groupBy("meeting_id").agg(F.max("end_ms").alias("length_ms"))
    covered = union_of_intervals(turns.select("meeting_id", "start_ms", "end_ms"), ["meeting_id"]).join(length, "meeting_id").groupBy("meeting_id").agg(F.sum(F.greatest(F.lit(0), F.least("end_ms", "length_ms") - F.col("start_ms"))).alias("covered_ms"))
    by = turns.where("end_ms > start_ms").groupBy("meeting_id", "speaker").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    speakers = by.groupBy("meeting_id").agg(F.count("*").alias("speakers"), F.max("ms").alias("top_ms"), F.sum("ms").alias("all_ms"), F.count_if(F.col("ms") < short_ms).alias("short_speakers"))
    joined = length.join(covered, "meeting_id", "left").join(speakers, "meeting_id", "left")
    return joined.select("meeting_id", "length_ms", F.coalesce("covered_ms", F.lit(0)).cast("long").alias("covered_ms"), F.round(F.coalesce(F.col("covered_ms"), F.lit(0)) / F.col("length_ms"), 6).alias("coverage"), F.coalesce("speakers", F.lit(0)).alias("speakers"), F.round(F.col("top_ms") / F.col("all_ms"), 6).alias("largest_share"), F.coalesce("short_speakers", F.lit(0)).alias("short_speakers"))


def usable_segments(segments: DataFrame) -> DataFrame:
    """Segments with an end after the start; a meeting with fewer than max(1, n div 2) of them is left out."""
    w = W.partitionBy("meeting_id")
    good = (F.col("end_ms") > F.col("start_ms")) & F.col("end_ms").isNotNull()
    counted = segments.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("n_good", F.count_if("good").over(w)).withColumn("n_all", F.count("*").over(w))
    return counted.where(F.col("good") & (F.col("n_good") >= F.greatest(F.lit(1), F.floor(F.col("n_all") / 2)))).drop("good", "n_good", "n_all")


def degrade_segment_times(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments with an end before the start set to null and blank texts dropped; counters per meeting)."""
    wrong = F.coalesce(F.col("end_ms") < F.col("start_ms"), F.lit(False))
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    kept = segments.where(~blank).withColumn("end_ms", F.when(~wrong, F.col("end_ms")))
    counts = segments.groupBy("meeting_id").agg(F.count_if(wrong & ~blank).alias("time_degraded"), F.count_if(blank).alias("dropped"), F.count_if(~blank).alias("kept"))
    return kept, counts


def drop_empty_turns(turns: DataFrame) -> DataFrame:
    """P5: turns with an end after the start, numbered anew in order of time."""
    kept = turns.where(F.col("end_ms") > F.col("start_ms"))
    return kept.withColumn("turn_no", F.row_number().over(W.partitionBy("meeting_id").orderBy("start_ms", "end_ms", "speaker", "turn_no")))
