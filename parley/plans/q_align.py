"""Queries of transcript building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import clock_sql
from parley.operators import align
from parley.plans import frames as fr
from parley.plans.registry import query

_T1 = """t1 AS (SELECT s.meeting_id, s.seg_no, t.speaker, CAST(sum(least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms)) AS BIGINT) AS overlap
  FROM seg s JOIN {turns} t ON s.meeting_id = t.meeting_id AND s.start_ms < t.end_ms AND t.start_ms < s.end_ms GROUP BY 1, 2, 3)"""
T1 = f"{fr.TRN},\n{_T1.format(turns='trn')}"
T1_GAP = f"{fr.TRN_GAP},\n{_T1.format(turns='trn_gap')}"
_T3 = """t3 AS (SELECT * FROM (SELECT s.meeting_id, s.seg_no, t.turn_no, t.speaker, least(abs(s.start_ms + s.end_ms - 2 * t.start_ms), abs(s.start_ms + s.end_ms - 2 * t.end_ms)) / 2.0 AS distance_ms,
  row_number() OVER (PARTITION BY s.meeting_id, s.seg_no ORDER BY least(abs(s.start_ms + s.end_ms - 2 * t.start_ms), abs(s.start_ms + s.end_ms - 2 * t.end_ms)), t.turn_no) AS rn
  FROM (SELECT * FROM seg ANTI JOIN t1 USING (meeting_id, seg_no)) s JOIN trn_gap t USING (meeting_id)) WHERE rn = 1)"""
T3 = f"{T1_GAP},\n{_T3}"
#: Pieces: with three speakers at most, an excess of the allocation is one character and the heaviest part gives it.
PIECES = T3 + """,
per AS (SELECT meeting_id, seg_no, sum(overlap) AS total, max(overlap) AS top, arg_max(speaker, (overlap, -speaker)) AS dominant, count(*) FILTER (WHERE overlap >= 300) AS n_parts FROM t1 GROUP BY 1, 2),
base AS (SELECT s.*, p.total, p.top, coalesce(p.dominant, t3.speaker) AS main, coalesce(p.top < 0.6 * p.total AND length(s.text) >= 4 AND s.end_ms - s.start_ms >= 1000 AND p.n_parts >= 2, false) AS cut
  FROM seg s LEFT JOIN per p USING (meeting_id, seg_no) LEFT JOIN t3 USING (meeting_id, seg_no) WHERE trim(s.text) <> '' AND coalesce(p.dominant, t3.speaker) IS NOT NULL),
part AS (SELECT b.*, t1.speaker, t1.overlap, sum(t1.overlap) OVER w AS part_total, row_number() OVER (PARTITION BY b.meeting_id, b.seg_no ORDER BY t1.overlap DESC, t1.speaker) AS heavy,
  row_number() OVER (PARTITION BY b.meeting_id, b.seg_no ORDER BY t1.speaker) - 1 AS piece_no FROM base b JOIN t1 USING (meeting_id, seg_no) WHERE b.cut AND t1.overlap >= 300 WINDOW w AS (PARTITION BY b.meeting_id, b.seg_no)),
alloc AS (SELECT *, greatest(1, CAST(floor(length(text) * overlap / part_total) AS BIGINT)) AS c0 FROM part),
alloc2 AS (SELECT *, length(text) - sum(c0) OVER (PARTITION BY meeting_id, seg_no) AS rest FROM alloc),
alloc3 AS (SELECT *, CAST(c0 + CASE WHEN rest < 0 AND heavy = 1 THEN rest WHEN rest > 0 AND heavy <= rest THEN 1 ELSE 0 END AS BIGINT) AS c FROM alloc2),
placed AS (SELECT *, coalesce(sum(c) OVER u, 0) AS before_c, coalesce(sum(overlap) OVER u, 0) AS before_o, max(piece_no) OVER (PARTITION BY meeting_id, seg_no) AS last_no FROM alloc3
  WINDOW u AS (PARTITION BY meeting_id, seg_no ORDER BY piece_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pieces AS (SELECT meeting_id, seg_no, CAST(piece_no AS INT) AS piece_no, CAST(start_ms + (end_ms - start_ms) * before_o // total AS BIGINT) AS start_ms,
  CAST(CASE WHEN piece_no = last_no THEN end_ms ELSE start_ms + (end_ms - start_ms) * (before_o + overlap) // total END AS BIGINT) AS end_ms, speaker, substr(text, CAST(before_c + 1 AS INT), CAST(c AS INT)) AS text, start_ms AS seg_start, end_ms AS seg_end FROM placed
  UNION ALL SELECT meeting_id, seg_no, 0, start_ms, end_ms, main, text, start_ms, end_ms FROM base WHERE NOT cut),
pieces1 AS (SELECT * FROM pieces WHERE trim(text) <> '')"""
UTTERANCES = PIECES + """,
n1 AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY seg_start, seg_end, seg_no, piece_no) AS n FROM pieces1),
n2 AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY meeting_id ORDER BY n) = speaker THEN 0 ELSE 1 END AS change FROM n1),
n3 AS (SELECT *, sum(change) OVER (PARTITION BY meeting_id ORDER BY n) AS run FROM n2),
n4 AS (SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY meeting_id, run ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1500 THEN 0 ELSE 1 END AS broken FROM n3),
n5 AS (SELECT *, sum(broken) OVER (PARTITION BY meeting_id ORDER BY n) AS island FROM n4),
n6 AS (SELECT *, CASE WHEN regexp_matches(lag(right(text, 1)) OVER (PARTITION BY meeting_id, island ORDER BY n), '^[A-Za-z0-9]$') AND regexp_matches(left(text, 1), '^[A-Za-z0-9]$') THEN ' ' ELSE '' END AS gap FROM n5),
utt AS (SELECT meeting_id, CAST(island AS INT) AS utt_no, arg_min(start_ms, n) AS start_ms, max(end_ms) AS end_ms, any_value(speaker) AS speaker, string_agg(gap || text, '' ORDER BY n) AS text FROM n6 GROUP BY 1, 2)"""
STATS = UTTERANCES + """,
s0 AS (SELECT meeting_id, speaker, CAST(sum(greatest(0, end_ms - start_ms)) AS BIGINT) AS total_ms, count(*) AS utterance_count, arg_min(start_ms, utt_no) AS first_seen, left(arg_min(text, utt_no), 40) AS first_text FROM utt GROUP BY 1, 2),
stats AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY total_ms DESC, speaker) AS rank, sum(total_ms) OVER (PARTITION BY meeting_id) AS whole FROM s0),
stats1 AS (SELECT meeting_id, speaker, CAST(rank AS INT) AS rank, '發言者' || rank AS label, total_ms, round(total_ms / CASE WHEN whole = 0 THEN 1 ELSE whole END, 6) AS share, utterance_count, first_seen, first_text FROM stats)"""


def pieces(spark: SparkSession, sf_dir: str, bucket_ms: int | None = align.BUCKET_MS) -> DataFrame:
    return align.split_segments(fr.seg(spark, sf_dir), fr.trn_gap(spark, sf_dir), bucket_ms=bucket_ms)


def utterances(spark: SparkSession, sf_dir: str, bucket_ms: int | None = align.BUCKET_MS) -> DataFrame:
    return align.merge_utterances(pieces(spark, sf_dir, bucket_ms))


@query(f"WITH {T1} SELECT * FROM t1")
def t1_overlap_by_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.overlap_by_speaker(fr.seg(spark, sf_dir), fr.trn(spark, sf_dir))


@query(f"WITH {T1} SELECT * FROM t1")
def t1_overlap_plain_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.overlap_by_speaker(fr.seg(spark, sf_dir), fr.trn(spark, sf_dir), bucket_ms=None)


@query(f"WITH {T1} SELECT meeting_id, seg_no, arg_max(speaker, (overlap, -speaker)) AS speaker, max(overlap) AS overlap, CAST(sum(overlap) AS BIGINT) AS total, round(max(overlap) / sum(overlap), 6) AS share FROM t1 GROUP BY 1, 2")
def t2_dominant_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.dominant_speaker(t1_overlap_by_speaker(spark, sf_dir))


@query(f"WITH {T3} SELECT meeting_id, seg_no, turn_no, speaker, distance_ms FROM t3")
def t3_nearest_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = fr.seg(spark, sf_dir), fr.trn_gap(spark, sf_dir)
    return align.nearest_turn(s, t, align.overlap_by_speaker(s, t))


@query(f"WITH {PIECES} SELECT * FROM pieces1")
def t4_split_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(spark, sf_dir)


@query(f"WITH {UTTERANCES} SELECT meeting_id, utt_no, start_ms, end_ms, speaker FROM utt")
def t5_merge_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utterances(spark, sf_dir).drop("text")


@query(f"WITH {STATS} SELECT * FROM stats1")
def t6_label_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.label_speakers(utterances(spark, sf_dir))


@query(f"WITH {UTTERANCES} SELECT meeting_id, utt_no, text FROM utt")
def t7_join_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utterances(spark, sf_dir).select("meeting_id", "utt_no", "text")


RENDERED = STATS + f""",
heads AS (SELECT meeting_id, string_agg('- ' || label || '：' || {clock_sql('total_ms')} || '（' || CAST(round(share * 100) AS INT) || '%，' || utterance_count || ' 段，首次發言 ' || {clock_sql('first_seen')} || '） 首句節錄：' || first_text, chr(10) ORDER BY rank) AS heads FROM stats1 GROUP BY 1),
body AS (SELECT u.meeting_id, string_agg('[' || {clock_sql('u.start_ms')} || '-' || {clock_sql('u.end_ms')} || '] ' || s.label || '：' || u.text, chr(10) ORDER BY u.utt_no) AS body FROM utt u JOIN stats1 s USING (meeting_id, speaker) GROUP BY 1),
rendered AS (SELECT meeting_id, '{align.NOTE}' || chr(10) || '【發言者統計】' || chr(10) || heads || chr(10) || chr(10) || body AS text FROM heads JOIN body USING (meeting_id))"""


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.sources.store import materialised

    u = materialised(utterances(spark, sf_dir), "utterances")
    return align.render_transcript(u, align.label_speakers(u))


@query(f"WITH {RENDERED} SELECT * FROM rendered")
def t8_render_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spark, sf_dir)


_WINDOWS = fr.SEG_BAD + """,
win AS (SELECT meeting_id, seg_no // 2 AS win_no, min(start_ms) AS offset_ms, max(start_ms) - min(start_ms) + 1000 AS length_ms, string_agg(text, ' ' ORDER BY seg_no) AS text FROM seg_bad GROUP BY 1, 2),
chk AS (SELECT s.meeting_id, s.seg_no // 2 AS win_no, s.seg_no AS chunk_no, s.start_ms - w.offset_ms AS start_ms, s.end_ms - w.offset_ms AS end_ms, s.text FROM seg_bad s JOIN win w ON w.meeting_id = s.meeting_id AND w.win_no = s.seg_no // 2),
good AS (SELECT * FROM chk WHERE start_ms IS NOT NULL AND end_ms > start_ms AND trim(text) <> '')"""


@query(f"WITH {_WINDOWS} SELECT g.meeting_id, g.win_no, g.chunk_no, g.start_ms + w.offset_ms AS start_ms, g.end_ms + w.offset_ms AS end_ms, g.text FROM good g JOIN win w USING (meeting_id, win_no) UNION ALL SELECT meeting_id, win_no, 0, offset_ms, offset_ms + length_ms, text FROM win ANTI JOIN good USING (meeting_id, win_no) WHERE trim(text) <> ''")
def t9_stitch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.functions.text import in_order

    s = fr.seg_bad(spark, sf_dir).withColumn("win_no", F.floor(F.col("seg_no") / 2).cast("int"))
    windows = s.groupBy("meeting_id", "win_no").agg(F.min("start_ms").alias("offset_ms"), (F.max("start_ms") - F.min("start_ms") + 1000).alias("length_ms"), in_order("seg_no", "text", " ").alias("text"))
    chunks = s.join(windows.select("meeting_id", "win_no", "offset_ms"), ["meeting_id", "win_no"]).select("meeting_id", "win_no", F.col("seg_no").alias("chunk_no"), (F.col("start_ms") - F.col("offset_ms")).alias("start_ms"), (F.col("end_ms") - F.col("offset_ms")).alias("end_ms"), "text")
    return align.stitch_windows(windows, chunks)


@query(f"WITH {fr.SEG} SELECT * FROM seg")
def t10_build_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.seg(spark, sf_dir)


@query("""WITH src AS (SELECT conv_id AS meeting_id, role AS category, CAST(turn AS INT) AS item_no, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS at, count(*) OVER (PARTITION BY conv_id, role) AS of_n FROM conversations),
slots AS (SELECT DISTINCT conv_id AS meeting_id, slot, ['user', 'assistant', 'user', 'system'][slot % 4 + 1] AS category, slot // 4 * CASE slot % 4 WHEN 0 THEN 2 WHEN 2 THEN 2 ELSE 1 END + CASE slot % 4 WHEN 2 THEN 1 ELSE 0 END AS turn FROM conversations, range(12) r(slot))
SELECT s.meeting_id, CAST(s.slot AS INT) AS slot, s.category, src.item_no FROM slots s JOIN src USING (meeting_id, category) WHERE s.turn % src.of_n = src.at""")
def t11_pattern_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = fr.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting_id"), F.col("role").alias("category"), F.col("turn").cast("int").alias("item_no"))
    return align.pattern_interleave(sources, ["user", "assistant", "user", "system"], 12).select("meeting_id", "slot", "category", "item_no")


@query(f"""WITH {fr.MANIFEST.replace("manifest AS", "man AS")},
{fr.TRN_GAP.replace(fr.SEG + ",", "").strip()},
hit AS (SELECT m.meeting_id, m.seg_no, arg_max(language, (ov, -turn_no)) AS language, max(ov) AS overlap FROM (SELECT s.meeting_id, s.seg_no, t.turn_no, CAST(t.speaker AS VARCHAR) AS language, least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms) AS ov
  FROM seg s JOIN trn_gap t ON s.meeting_id = t.meeting_id AND s.start_ms < t.end_ms AND t.start_ms < s.end_ms) m GROUP BY 1, 2)
SELECT s.meeting_id, s.seg_no, coalesce(h.language, 'unknown') AS language, coalesce(h.overlap, 0) AS overlap FROM seg s LEFT JOIN hit h USING (meeting_id, seg_no)""")
def t12_classify_by_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fr.trn_gap(spark, sf_dir).select("meeting_id", F.col("turn_no").alias("item_no"), "start_ms", "end_ms", F.col("speaker").cast("string").alias("language"))
    return align.classify_by_overlap(fr.seg(spark, sf_dir), items)


@query(f"""WITH {fr.TRN_GAP},
len AS (SELECT meeting_id, max(end_ms) AS length_ms FROM seg GROUP BY 1),
m AS (SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM trn_gap WHERE end_ms > start_ms),
i AS (SELECT *, sum(new) OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM m),
u AS (SELECT meeting_id, island, min(start_ms) AS a, max(end_ms) AS b FROM i GROUP BY 1, 2),
c AS (SELECT meeting_id, sum(greatest(0, least(b, length_ms) - a)) AS covered_ms FROM u JOIN len USING (meeting_id) GROUP BY 1),
bys AS (SELECT meeting_id, speaker, sum(end_ms - start_ms) AS ms FROM trn_gap WHERE end_ms > start_ms GROUP BY 1, 2),
sp AS (SELECT meeting_id, count(*) AS speakers, max(ms) AS top_ms, sum(ms) AS all_ms, count(*) FILTER (WHERE ms < 5000) AS short_speakers FROM bys GROUP BY 1)
SELECT meeting_id, length_ms, CAST(coalesce(covered_ms, 0) AS BIGINT) AS covered_ms, round(coalesce(covered_ms, 0) / length_ms, 6) AS coverage, coalesce(speakers, 0) AS speakers, round(top_ms / all_ms, 6) AS largest_share, coalesce(short_speakers, 0) AS short_speakers
FROM len LEFT JOIN c USING (meeting_id) LEFT JOIN sp USING (meeting_id)""")
def t13_diarization_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.diarization_coverage(fr.seg(spark, sf_dir), fr.trn_gap(spark, sf_dir))


@query(f"""WITH {fr.SEG_BAD}, c AS (SELECT *, coalesce(end_ms > start_ms, false) AS good, count(*) OVER w AS n_all, count(*) FILTER (WHERE end_ms > start_ms) OVER w AS n_good FROM seg_bad WINDOW w AS (PARTITION BY meeting_id))
SELECT meeting_id, seg_no, start_ms, end_ms FROM c WHERE good AND n_good >= greatest(1, n_all // 2)""")
def p3_usable_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.usable_segments(fr.seg_bad(spark, sf_dir)).select("meeting_id", "seg_no", "start_ms", "end_ms")


@query(f"WITH {fr.SEG_BAD} SELECT meeting_id, count(*) FILTER (WHERE end_ms < start_ms AND trim(text) <> '') AS time_degraded, count(*) FILTER (WHERE trim(text) = '') AS dropped, count(*) FILTER (WHERE trim(text) <> '') AS kept FROM seg_bad GROUP BY 1")
def p4_degrade_segment_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.degrade_segment_times(fr.seg_bad(spark, sf_dir))[1]


@query(f"WITH {fr.TRN}, k AS (SELECT meeting_id, turn_no AS old_no, start_ms, CASE WHEN turn_no % 4 = 3 THEN start_ms ELSE end_ms END AS end_ms, speaker FROM trn) SELECT meeting_id, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, end_ms, speaker, old_no) AS INT) AS turn_no, start_ms, end_ms, speaker FROM k WHERE end_ms > start_ms")
def p5_drop_empty_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = fr.trn(spark, sf_dir).withColumn("end_ms", F.when(F.col("turn_no") % 4 == 3, F.col("start_ms")).otherwise(F.col("end_ms")))
    return align.drop_empty_turns(turns)
