"""Queries of sources and sinks, over files and payloads that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.plans import frames as fr
from parley.plans import q_align
from parley.plans.registry import query
from parley.sources import readers, store

UNLABELLED = "base::v1"
LABELLED = "base::v1::labels"


@query("""WITH f AS (SELECT page_id, url, regexp_extract(url, '([^/]+)$', 1) || CASE page_id % 4 WHEN 0 THEN '.mp3' WHEN 1 THEN '.WAV' WHEN 2 THEN '.txt' ELSE '' END AS name, length(html) AS bytes FROM pages)
SELECT page_id, name, bytes, lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) AS extension FROM f WHERE lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) IN ('mp3', 'wav', 'm4a', 'mp4', 'flac', 'ogg', 'aac', 'wma')""")
def s1_scan_media_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in (".mp3", ".WAV", ".txt", "")]), (F.col("page_id") % 4 + 1).cast("int"))
    files = fr.table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", "([^/]+)$", 1), kind).alias("name"), F.length("html").cast("long").alias("bytes"))
    return readers.media_only(files)


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fr.seg(spark, sf_dir)
    chunk = F.struct((F.col("start_ms") / 1000).alias("start"), F.when(F.col("seg_no") % 5 != 0, F.col("end_ms") / 1000).alias("end"), F.when(F.col("seg_no") % 6 != 5, F.concat(F.lit("  "), "text")).otherwise(" ").alias("text"))
    made = s.groupBy("meeting_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", chunk.alias("c")))), lambda x: x["c"]).alias("chunks"))
    whole = F.to_json(F.struct(F.lit("1.0").alias("schema"), F.lit("en").alias("language"), "chunks"))
    broken = F.when(F.col("meeting_id") % 10 == 0, F.left(whole, F.lit(30))).when(F.col("meeting_id") % 10 == 1, F.lit('{"schema": "1.0"}')).otherwise(whole)
    return made.select("meeting_id", broken.alias("payload"))


@query(f"""WITH {fr.SEG} SELECT meeting_id, seg_no, start_ms, CASE WHEN seg_no % 5 = 0 THEN start_ms ELSE end_ms END AS end_ms, trim(text) AS text FROM seg WHERE meeting_id % 10 > 1 AND seg_no % 6 <> 5""")
def s2_read_asr_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.parse_asr_payloads(_payloads(spark, sf_dir))[0]


@query("SELECT DISTINCT conv_id AS meeting_id, CASE conv_id % 10 WHEN 0 THEN 'not json' ELSE 'no chunks' END AS reason FROM conversations WHERE conv_id % 10 < 2")
def s2_bad_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.parse_asr_payloads(_payloads(spark, sf_dir))[1]


def glossary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first line as a glossary line of the file named by its language, in the scope of its source."""
    first = F.split(F.col("text"), " ")
    line = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("# "), F.get(first, F.lit(0)))).when(F.col("doc_id") % 3 == 0, F.concat(F.get(first, F.lit(0)), F.lit(" => "), F.get(first, F.lit(1)))).otherwise(F.get(first, F.lit(0)))
    return fr.documents(spark, sf_dir).where(F.size(first) > 1).select(F.col("source").alias("scope"), F.col("lang").alias("file"), F.col("doc_id").alias("line_no"), line.alias("line"))


GLOSSARY = """gl AS (SELECT source AS scope, lang AS file, doc_id AS line_no, string_split(text, ' ')[1] AS a, string_split(text, ' ')[2] AS b, doc_id FROM documents WHERE len(string_split(text, ' ')) > 1 AND doc_id % 5 <> 0),
gx AS (SELECT scope, file, line_no, CASE WHEN doc_id % 3 = 0 THEN trim(a, ' ') END AS wrong, CASE WHEN doc_id % 3 = 0 THEN trim(b, ' ') ELSE trim(a, ' ') END AS rgt FROM gl),
terms AS (SELECT scope, rgt AS term, CAST(row_number() OVER (PARTITION BY scope ORDER BY min((file, line_no))) AS INT) AS ord FROM gx WHERE rgt <> '' AND NOT starts_with(coalesce(wrong, rgt), '#') GROUP BY 1, 2),
pairs AS (SELECT scope, wrong, rgt, CAST(row_number() OVER (PARTITION BY scope ORDER BY min((file, line_no))) AS INT) AS ord FROM gx WHERE wrong <> '' AND rgt <> '' AND NOT starts_with(wrong, '#') GROUP BY 1, 2, 3)"""


@query(f"WITH {GLOSSARY} SELECT * FROM terms")
def s3_read_glossary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.glossary_of(glossary_lines(spark, sf_dir))[0]


@query(f'WITH {GLOSSARY} SELECT scope, wrong, rgt AS "right", ord FROM pairs')
def s3_read_glossary_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.glossary_of(glossary_lines(spark, sf_dir))[1]


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines of their user's run: metrics on views, an upload line on signups, others as noise."""
    n = F.col("event_id")
    text = lambda x: x.cast("string")
    metrics = F.concat(F.lit("\x1b[32mINFO\x1b[0m pipeline metrics logical="), text(n % 7), F.lit(" attempts="), text(n % 7 + n % 9), F.lit(" rounds="), text(n % 5), F.lit(" \x1b[1mdone\x1b[0m"))
    upload = F.concat(F.lit("\x1b[33mupload f"), text(n % 50), F.lit(".mp3 -> task "), text(F.col("user_id")), F.lit("\x1b[0m"))
    line = F.when(F.col("event_type") == "view", metrics).when(F.col("event_type") == "signup", upload).otherwise(F.concat(F.lit("noise key=1 "), F.col("event_type")))
    return fr.table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), n.alias("line_no"), line.alias("line"))


@query("SELECT event_id AS line_no, event_id % 7 AS logical, event_id % 7 + event_id % 9 AS attempts, event_id % 5 AS rounds FROM events WHERE event_type = 'view'")
def s4_read_pipeline_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readers.pipeline_metrics(log_lines(spark, sf_dir))
    return found.select("line_no", *(F.col("metrics")[k].alias(k) for k in ("logical", "attempts", "rounds")))


@query(f"""WITH {q_align.RENDERED},
rl AS (SELECT meeting_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM rendered),
form AS (SELECT *, '^\\[(\\d+):(\\d\\d):(\\d\\d)-(\\d+):(\\d\\d):(\\d\\d)\\] ([^：]*)：((?s:.*))$' AS f FROM rl)
SELECT meeting_id, CAST(line_no AS INT) AS line_no, CAST(substr(line, 2, 2) AS BIGINT) * 3600 + CAST(substr(line, 5, 2) AS BIGINT) * 60 + CAST(substr(line, 8, 2) AS BIGINT) AS start_s,
  CAST(substr(line, 11, 2) AS BIGINT) * 3600 + CAST(substr(line, 14, 2) AS BIGINT) * 60 + CAST(substr(line, 17, 2) AS BIGINT) AS end_s,
  split_part(substr(line, 21), '：', 1) AS label, substr(line, 22 + length(split_part(substr(line, 21), '：', 1))) AS text FROM form WHERE regexp_matches(line, '^\\[\\d\\d:\\d\\d:\\d\\d-\\d\\d:\\d\\d:\\d\\d\\] [^：]*：')""")
def s5_parse_labelled_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fr.lines_of(q_align.rendered(spark, sf_dir), "meeting_id")
    return readers.parse_labelled_transcript(lines)


@query(f"WITH {fr.MANIFEST} SELECT meeting_id, item_no, start_ms, end_ms, language, text, source FROM manifest")
def s6_read_validation_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fr.manifest(spark, sf_dir)
    item = F.struct((F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "language", "text", "source")
    files = m.groupBy("meeting_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("item_no", item.alias("i")))), lambda x: x["i"])).alias("payload"))
    return readers.parse_manifest(files)


@query("""SELECT doc_id AS task_id, 'name' || doc_id || '_' || doc_id AS result_name, length(text) AS n_transcript, sha256(text) AS record_hash, lang AS template_id FROM documents""")
def s7_write_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fr.documents(spark, sf_dir)
    path = store.shared_path(spark, "results")
    store.write_results(docs.select(F.col("doc_id").alias("task_id"), F.col("lang").alias("template_id"), F.concat(F.lit("/in/name"), "doc_id", F.lit(".mp3")).alias("name"), F.col("text").alias("record"), F.col("text").alias("transcript")), path)
    back = store.read_results(spark, path)
    return back.select("task_id", "result_name", F.length("transcript").cast("long").alias("n_transcript"), F.sha2("record", 256).alias("record_hash"), F.col("template_id").cast("string").alias("template_id"))


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files, store): every third document is in the store, every ninth of those under the labelled signature."""
    docs = fr.documents(spark, sf_dir)
    digest = F.sha2("text", 256)
    files = docs.select(F.col("doc_id").alias("file_id"), F.when(F.col("doc_id") % 17 == 0, F.upper(digest)).otherwise(digest).alias("hash"))
    kept = docs.where("doc_id % 3 = 0").select(digest.alias("hash"), F.when(F.col("doc_id") % 9 == 0, F.lit(LABELLED)).otherwise(F.lit(UNLABELLED)).alias("signature"), (F.col("doc_id") % 9 == 0).alias("labelled"), F.concat(F.lit("t"), F.sha2(F.concat("text", F.lit("!")), 256)).alias("transcript"))
    return files, kept


_STORE = f"""files AS (SELECT doc_id AS file_id, CASE WHEN doc_id % 17 = 0 THEN upper(sha256(text)) ELSE sha256(text) END AS hash FROM documents),
store AS (SELECT sha256(text) AS hash, CASE WHEN doc_id % 9 = 0 THEN '{LABELLED}' ELSE '{UNLABELLED}' END AS signature, doc_id % 9 = 0 AS labelled, 't' || sha256(text || '!') AS transcript FROM documents WHERE doc_id % 3 = 0)"""


@query(f"WITH {_STORE}, k AS (SELECT hash, max(transcript) AS transcript FROM store WHERE signature = '{UNLABELLED}' GROUP BY 1) SELECT hash, file_id, transcript, transcript IS NOT NULL AS hit FROM files LEFT JOIN k USING (hash)")
def j6_split_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.split_cached(*stored(spark, sf_dir), UNLABELLED, UNLABELLED)


@query(f"WITH {_STORE} SELECT sha256(text) AS hash, '{UNLABELLED}' AS signature, false AS labelled, min('n' || doc_id) AS transcript FROM documents WHERE sha256(text) NOT IN (SELECT hash FROM store WHERE signature = '{UNLABELLED}') GROUP BY 1")
def s8_write_transcript_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = fr.documents(spark, sf_dir).select(F.sha2("text", 256).alias("hash"), F.lit(UNLABELLED).alias("signature"), F.lit(False).alias("labelled"), F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("transcript"))
    return store.append_store(results, stored(spark, sf_dir)[1])


def laid_out(spark: SparkSession, sf_dir: str) -> str:
    """The store of ``stored`` as a table of buckets, appended in two batches, the second of them twice."""
    path, kept = store.shared_path(spark, "store"), stored(spark, sf_dir)[1]
    half = F.substring("hash", 2, 1) < "8"
    store.append_batch(kept.where(half), path, "1")
    for _ in range(2):
        store.append_batch(kept, path, "2")
    return path


@query(f"WITH {_STORE} SELECT hash, signature, bool_or(labelled) AS labelled, min(transcript) AS transcript, substr(hash, 1, 2) AS bucket, CASE WHEN substr(hash, 2, 1) < '8' THEN '1' ELSE '2' END AS batch FROM store GROUP BY 1, 2")
def s8_append_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.open_store(spark, laid_out(spark, sf_dir))


@query(f"WITH {_STORE}, k AS (SELECT hash, max(transcript) AS transcript FROM store WHERE signature = '{UNLABELLED}' GROUP BY 1) SELECT hash, file_id, transcript, transcript IS NOT NULL AS hit FROM files LEFT JOIN k USING (hash)")
def j6_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.lookup(stored(spark, sf_dir)[0], laid_out(spark, sf_dir), UNLABELLED, UNLABELLED)


@query("""SELECT lang, '{"lang":"' || lang || '","documents":' || count(*) || ',"chars":' || CAST(sum(n_chars) AS BIGINT) || '}' AS value FROM documents GROUP BY 1""")
def s9_write_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.shared_path(spark, "report")
    store.write_validation_report(fr.documents(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars")), path)
    return spark.read.text(path).select(F.get_json_object("value", "$.lang").alias("lang"), "value")
