"""Queries of chunking and summarisation, with the extractive stub as the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions.text import estimate_tokens_sql
from parley.operators import summarise
from parley.operators.validate import length_gate
from parley.plans import frames as fr
from parley.plans.registry import query
from parley.sources.store import materialised

BUDGET = 300


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.documents(spark, sf_dir).select("doc_id", "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialised(summarise.chunk_lines(docs(spark, sf_dir), BUDGET), "chunk-lines")


@query(f"""WITH t AS (SELECT doc_id, CAST({estimate_tokens_sql('text')} AS BIGINT) AS tokens FROM documents)
SELECT doc_id, tokens, 3200 AS chunk_budget, 5644 AS merge_budget, 2596 AS merge_target, 2596 AS merge_feasible, tokens > 3200 AS needs_chunking, CAST(greatest(1, (tokens + 2979) // 2980) AS INT) AS estimated_chunks, CAST(NULL AS VARCHAR) AS error FROM t""")
def m2_context_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise.context_plan(docs(spark, sf_dir))


_M3 = """m0 AS (SELECT doc_id, unnest(range(len(x))) AS p1, unnest(x) AS raw FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS x FROM documents)),
m1 AS (SELECT doc_id, p1, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM m0),
m2 AS (SELECT doc_id, p1, unnest(range(len(x))) AS p2, unnest(x) AS s FROM (SELECT *, CASE WHEN length(line) > 600 THEN string_split(regexp_replace(line, '([。！？!?；;])', '\\1' || chr(1), 'g'), chr(1)) ELSE [line] END AS x FROM m1 WHERE line <> '')),
m3 AS (SELECT doc_id, p1, p2, unnest(range(len(x))) AS p3, unnest(x) AS line FROM (SELECT *, CASE WHEN length(s) > 600 THEN list_filter(string_split(regexp_replace(s, '(?s)(.{1,600}\\z)|(.{1,599})[ \\t]|(.{600})', '\\1\\2\\3' || chr(1), 'g'), chr(1)), lambda y: y <> '') ELSE [s] END AS x FROM m2)),
mm AS (SELECT * FROM m3 WHERE regexp_matches(line, '\\S'))"""


@query(f"WITH {_M3} SELECT doc_id, CAST(p1 AS INT) AS p1, CAST(p2 AS INT) AS p2, CAST(p3 AS INT) AS p3, length(line) AS n_chars, sha256(line) AS line_hash FROM mm")
def m3_paragraph_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise.paragraph_breaks(summarise.raw_lines(docs(spark, sf_dir))).select("doc_id", "p1", "p2", "p3", F.length("line").alias("n_chars"), F.sha2("line", 256).alias("line_hash"))


#: Without M4's cut, so equal to the queries only for documents without a line beyond BUDGET tokens after M3: all at sf0.01, but
#: not seven at sf0.1, whose lines the queries cut.
_M4 = f"""{_M3}, ml AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p1, p2, p3) - 1 AS i, line, CAST({estimate_tokens_sql('line')} AS BIGINT) AS tokens FROM mm)"""


@query(f"WITH {_M4} SELECT doc_id, CAST(i AS INT) AS line_no, tokens, length(line) AS n_chars, sha256(line) AS line_hash FROM ml")
def m4_split_oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise.chunk_lines(docs(spark, sf_dir), BUDGET).select("doc_id", "line_no", "tokens", F.length("line").alias("n_chars"), F.sha2("line", 256).alias("line_hash"))


#: A step of the recursion is a chunk: its last line is the last that fits, and the next one begins as early as it may.
_M5 = f"""{_M4}, mp AS (SELECT doc_id, i, tokens + 1 AS n, sum(tokens + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM ml),
me AS (SELECT doc_id, max(i) AS z FROM mp GROUP BY 1),
ms AS (SELECT doc_id, 0::BIGINT AS chunk_no, 0::BIGINT AS a, 0::BIGINT AS new FROM me
  UNION ALL SELECT doc_id, chunk_no + 1, min(s.i), any_value(e.j) + 1 FROM (
    SELECT m.doc_id, m.chunk_no, m.a, max(p.i) AS j FROM ms m JOIN mp f ON f.doc_id = m.doc_id AND f.i = m.a JOIN mp p ON p.doc_id = m.doc_id AND p.i >= m.new AND (p.i = m.new OR p.upto - f.upto + f.n <= {BUDGET}) GROUP BY 1, 2, 3) e
  JOIN me USING (doc_id) JOIN mp last ON last.doc_id = e.doc_id AND last.i = e.j JOIN mp next ON next.doc_id = e.doc_id AND next.i = e.j + 1
  JOIN mp s ON s.doc_id = e.doc_id AND s.i BETWEEN greatest(e.a, e.j - 3) AND e.j + 1 AND (s.i >= e.j OR last.upto - s.upto + s.n <= 150) AND (s.i = e.j + 1 OR next.upto - s.upto + s.n <= {BUDGET})
  WHERE e.j < me.z GROUP BY 1, 2),
mc AS (SELECT doc_id, chunk_no, a AS first_line, coalesce(lead(new) OVER (PARTITION BY doc_id ORDER BY chunk_no) - 1, z) AS last_line, new - a AS overlap FROM ms JOIN me USING (doc_id))"""


@query(f"WITH RECURSIVE {_M5} SELECT doc_id, CAST(chunk_no AS INT) AS chunk_no, CAST(first_line AS INT) AS first_line, CAST(last_line AS INT) AS last_line, CAST(overlap AS INT) AS overlap FROM mc")
def m5_pack_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise.pack_chunks(lines(spark, sf_dir), BUDGET)


@query(f"""WITH RECURSIVE {_M5}, mt AS (SELECT c.doc_id, c.chunk_no, regexp_replace(string_agg(l.line, chr(10) ORDER BY l.i), '^\\s+|\\s+$', '', 'g') AS text FROM mc c JOIN ml l ON l.doc_id = c.doc_id AND l.i BETWEEN c.first_line AND c.last_line GROUP BY 1, 2),
mf AS (SELECT doc_id, count(*) AS n_chunks, bool_and({estimate_tokens_sql('text')} <= {BUDGET} AND text <> '') AS fits FROM mt GROUP BY 1)
SELECT doc_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(fits, true) AS fits, true AS follows, true AS complete, CASE WHEN n_chunks IS NULL THEN 'blank' WHEN fits THEN 'ok' ELSE 'over_budget' END AS verdict, CASE WHEN NOT fits THEN 'CONTEXT_BUDGET_EXCEEDED' END AS error FROM documents LEFT JOIN mf USING (doc_id)""")
def m6_check_chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    chunks = materialised(summarise.pack_chunks(rows, BUDGET), "chunks")
    return summarise.check_chunk_coverage(docs(spark, sf_dir), rows, chunks, BUDGET)


@query(f"""WITH RECURSIVE {_M5}, mt AS (SELECT c.doc_id, c.chunk_no, regexp_replace(string_agg(l.line, chr(10) ORDER BY l.i), '^\\s+|\\s+$', '', 'g') AS text FROM mc c JOIN ml l ON l.doc_id = c.doc_id AND l.i BETWEEN c.first_line AND c.last_line GROUP BY 1, 2),
mf AS (SELECT doc_id, count(*) AS n_chunks, bool_and({estimate_tokens_sql('text')} <= {BUDGET}) AS fits FROM mt GROUP BY 1)
SELECT doc_id + CASE WHEN doc_id % 13 = 0 THEN 1000000000 ELSE 0 END AS doc_id, n_chunks, CASE WHEN doc_id % 13 = 0 THEN 'unknown' WHEN doc_id % 7 = 0 THEN 'doubled' WHEN doc_id % 5 = 0 AND n_chunks = 1 THEN 'lost' WHEN doc_id % 3 = 0 AND n_chunks > 2 THEN 'broken' WHEN fits THEN 'ok' ELSE 'over_budget' END AS verdict FROM mf WHERE doc_id % 5 <> 0 OR doc_id % 7 = 0 OR doc_id % 13 = 0 OR n_chunks > 1
UNION ALL SELECT doc_id, 0, CASE WHEN n_chunks IS NULL AND doc_id % 7 = 0 THEN 'doubled' WHEN n_chunks IS NULL THEN 'blank' WHEN doc_id % 7 = 0 THEN 'doubled' ELSE 'lost' END FROM documents LEFT JOIN mf USING (doc_id) WHERE n_chunks IS NULL OR doc_id % 13 = 0 OR (doc_id % 5 = 0 AND n_chunks = 1 AND doc_id % 7 <> 0)""")
def m6_lost_and_doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage after harm: chunks of other documents, documents twice, single chunks gone, a middle chunk gone."""
    rows = lines(spark, sf_dir)
    chunks = materialised(summarise.pack_chunks(rows, BUDGET), "chunks")
    n = F.count("*").over(W.partitionBy("doc_id"))
    kept = chunks.withColumn("n", n).where("NOT (doc_id % 13 <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 = 0 AND n = 1)")
    kept = kept.where("NOT (doc_id % 13 <> 0 AND doc_id % 7 <> 0 AND doc_id % 3 = 0 AND n > 2 AND chunk_no = 1)")
    moved = lambda df: df.withColumn("doc_id", F.col("doc_id") + F.when(F.col("doc_id") % 13 == 0, 1_000_000_000).otherwise(0))
    source = docs(spark, sf_dir)
    found = summarise.check_chunk_coverage(source.unionByName(source.where("doc_id % 7 = 0")), rows.unionByName(moved(rows.where("doc_id % 13 = 0"))), moved(kept.drop("n")), BUDGET)
    broken = F.col("verdict").isin("overlap", "incomplete") | ((F.col("verdict") == "over_budget") & (F.col("doc_id") % 3 == 0) & ~F.col("follows"))
    n_chunks = F.col("n_chunks") + F.when(broken, 1).otherwise(0)
    return found.select("doc_id", n_chunks.alias("n_chunks"), F.when(broken, "broken").otherwise(F.col("verdict")).alias("verdict"))


@query("SELECT doc_id, sha256(text) AS text_hash FROM documents WHERE text <> ''")
def m7_split_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parley.functions.text import in_order

    parts = summarise.split_chars(docs(spark, sf_dir), 1000)
    return parts.groupBy("doc_id").agg(F.sha2(in_order("part_no", F.when(F.length("text") <= 1000, F.col("text")).otherwise("too long")), 256).alias("text_hash"))


def turns_as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("chunk_no"), "text")


@query("SELECT conv_id AS doc_id, CAST(turn AS INT) AS note_no, trim(regexp_replace(trim(text, ' ' || chr(10)), '(?s)(?:([。！？.!?])\\s|\\n).*$', '\\1'), ' ' || chr(10)) AS text FROM conversations")
def m8_extract_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise.extract_notes(turns_as_chunks(spark, sf_dir))[0]


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns_as_chunks(spark, sf_dir).withColumnRenamed("chunk_no", "note_no")


@query()
def m9_group_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise.group_notes(notes(spark, sf_dir), 120).select("doc_id", "note_no", "group_no", "tokens")


@query()
def m10_merge_until_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise.merge_until_fit(notes(spark, sf_dir), summarise.first_sentence, 120, 15, 40)


@query("""SELECT d.doc_id, coalesce(string_agg(trim(c.text, ' ' || chr(10)), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY c.turn) FILTER (WHERE regexp_matches(c.text, '\\S')), '（無筆記）') AS notes FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id GROUP BY 1""")
def m11_concat_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise.concat_notes(notes(spark, sf_dir), docs(spark, sf_dir))


@query()
def m12_generate_and_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = notes(spark, sf_dir).groupBy("doc_id").agg(F.max_by("text", "note_no").alias("text"))
    issues = lambda r: length_gate(r, 40).where("too_short").select("doc_id", F.lit("too short").alias("issue"))
    return summarise.generate_and_refine(source, summarise.first_sentence, lambda r: r, issues)


@query(f"WITH {fr.LINES}, u AS (SELECT *, sum({estimate_tokens_sql('line')} + 1) OVER (PARTITION BY doc_id ORDER BY line_no) AS upto FROM lines) SELECT doc_id, count(*) AS n_kept, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS text_hash FROM u WHERE upto <= 200 GROUP BY 1")
def m13_truncate_to_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = summarise.truncate_to_budget(fr.lines_of(docs(spark, sf_dir)), 200)
    return kept.select("doc_id", "n_kept", F.sha2("text", 256).alias("text_hash"))


@query("""WITH t AS (SELECT doc_id AS task_id, lang, CASE WHEN doc_id % 3 <> 0 THEN text END AS record, CASE WHEN doc_id % 6 <> 3 THEN text END AS transcript, CASE WHEN doc_id % 5 = 0 THEN 'as ' || source END AS preference FROM documents)
SELECT task_id, '# ' || lang || chr(10) || chr(10) || CASE WHEN record IS NULL OR NOT regexp_matches(record, '\\S') THEN '⚠️ 會議紀錄產生失敗，以下為逐字稿' || chr(10) || chr(10) || left('reason ' || lang, 200) || chr(10) || chr(10) || coalesce(transcript, '') ELSE record END || CASE WHEN preference IS NOT NULL THEN chr(10) || chr(10) || '> ' || preference ELSE '' END AS result,
  record IS NULL OR NOT regexp_matches(record, '\\S') AS summary_failed FROM t""")
def m16_assemble_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fr.documents(spark, sf_dir).withColumnRenamed("doc_id", "task_id")
    tasks = d.select("task_id", "lang", F.concat(F.lit("reason "), "lang").alias("error"), F.when(F.col("task_id") % 5 == 0, F.concat(F.lit("as "), "source")).alias("preference"))
    records = d.where("task_id % 3 <> 0").select("task_id", F.col("text").alias("record"))
    transcripts = d.where("task_id % 6 <> 3").select("task_id", F.col("text").alias("transcript"))
    return summarise.assemble_result(tasks, records, transcripts, F.col("lang"))
