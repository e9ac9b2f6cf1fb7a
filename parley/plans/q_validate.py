"""Queries of validation and extraction, with Latin rule tables over the given documents (template: language)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import estimate_tokens_sql
from parley.operators import validate
from parley.plans import frames as fr
from parley.plans import q_sources, templates
from parley.plans.registry import query
from parley.sources import readers
from parley.sources.store import materialised

#: (template, kind, label, pattern), safe for both regular-expression dialects.
RULES = [
    ("en", "required", "article", " the "),
    ("en", "required", "conjunction", " and then "),
    ("fr", "required", "article", " le "),
    ("de", "required", "article", " der "),
    ("de", "extra", "die", " die "),
    ("es", "extra", "que", " que "),
    ("en", "forbidden", "address", r"[a-z]+@[a-z]+\.[a-z]+"),
    ("en", "forbidden", "number", r"\d{3}"),
    ("fr", "forbidden", "number", r"\d{3}"),
    ("de", "forbidden", "token", r"token ="),
]
TITLES = [("a", "The and"), ("b", "License"), ("c", "Licensed under"), ("d", "The")]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.documents(spark, sf_dir).select("doc_id", F.col("lang").alias("template_id"), "text")


def rules(spark: SparkSession) -> DataFrame:
    return templates.rules(spark, RULES)


_RULES = "r(t, k, ord, label, p) AS (VALUES " + ", ".join(f"('{t}', '{k}', {i}, '{n}', '{p}')" for i, (t, k, n, p) in enumerate(RULES)) + ")"


def _listed(kinds: str, want: bool) -> str:
    test = "regexp_matches(d.text, r.p)" if want else "NOT regexp_matches(d.text, r.p)"
    return f"WITH {_RULES} SELECT d.doc_id, coalesce(string_agg(r.label, ',' ORDER BY r.ord) FILTER (WHERE {test}), '') AS labels FROM documents d LEFT JOIN r ON r.t = d.lang AND r.k IN ({kinds}) GROUP BY 1"


@query(_listed("'required', 'extra'", False))
def v1_missing_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.missing_sections(records(spark, sf_dir), rules(spark)).select("doc_id", F.array_join("missing", ",").alias("labels"))


@query(_listed("'forbidden'", True))
def v2_forbidden_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.forbidden_hits(records(spark, sf_dir), rules(spark)).select("doc_id", F.array_join("forbidden", ",").alias("labels"))


@query("SELECT doc_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 500 AS too_short FROM documents")
def v3_length_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.length_gate(records(spark, sf_dir), 500).select("doc_id", "too_short")


@query(f"SELECT doc_id, CAST(least(2000, greatest(250, {estimate_tokens_sql('text')} // 15)) AS BIGINT) AS min_chars, length(regexp_replace(short, '^\\s+|\\s+$', '', 'g')) < least(2000, greatest(250, {estimate_tokens_sql('text')} // 15)) AS too_short FROM (SELECT *, regexp_replace(text, '[aeiou]', '', 'g') AS short FROM documents)")
def v3_length_gate_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records are the transcripts without their vowels."""
    docs = records(spark, sf_dir)
    return validate.length_gate_by_source(docs.withColumn("text", F.regexp_replace("text", "[aeiou]", "")), docs).select("doc_id", "min_chars", "too_short")


_LEAKS = {
    "markup_leak": "regexp_matches({t}, '(?i)<(?:think|thought|details)\\b') OR regexp_matches({t}, '(?i)</(?:think|thought|details)>') OR regexp_matches({t}, '<[/!]?[A-Za-z][^>]*>') OR contains({t}, '```')",
    "rubric_leak": "regexp_matches({t}, '(?i)\\bAnalysis of the Transcript\\b|\\bEvaluation Criteria\\b|\\bMeeting (?:Name|Time|Location)\\s*[:：]|\\bLet''?s\\s+(?:infer|name|call|assume)\\b|\\bA suitable name\\b|\\bNot (?:explicitly )?stated\\b|評估標準|法制合規性|權責明確度|意見真實性|\\[請從文本中提取|\\[請填寫')",
}
_FOREIGN = "NOT regexp_matches(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '^[|\\-*#>]') AND regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> '' AND len(regexp_extract_all(line, '[A-Za-z]+')) >= 6 AND len(regexp_extract_all(line, '[㐀-鿿]')) <= 2"


def _leaks(source: str, key: str, text: str) -> str:
    return f"""WITH l AS (SELECT {key}, unnest(string_split({text}, chr(10))) AS line FROM {source}), f AS (SELECT {key}, bool_or({_FOREIGN}) AS foreign_line FROM l GROUP BY 1)
SELECT s.{key}, {_LEAKS['markup_leak'].format(t='s.' + text)} AS markup_leak, {_LEAKS['rubric_leak'].format(t='s.' + text)} AS rubric_leak, f.foreign_line FROM {source} s JOIN f USING ({key})"""


@query(_leaks("documents", "doc_id", "text"))
def v4_leakage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.leakage_flags(records(spark, sf_dir)).select("doc_id", "markup_leak", "rubric_leak", "foreign_line")


@query(_leaks("pages", "page_id", "html"))
def v4_leakage_flags_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.leakage_flags(fr.table(spark, sf_dir, "pages"), "html").select("page_id", "markup_leak", "rubric_leak", "foreign_line")


_KEY = "lower(regexp_replace({}, '[\\s:：,，。；;（）()「」『』【】\\[\\]／/\\\\-]+', '', 'g'))"


_GRAMS = "SELECT {k}, array_to_string(w[g : g + 7], ' ') AS gram, {t} FROM (SELECT *, unnest(range(1, CAST(len(w) - 6 AS BIGINT))) AS g FROM (SELECT *, regexp_split_to_array(lower(text), '[^a-z0-9]+') AS w FROM {s}) WHERE len(w) >= 8)"


#: Up to so many grams of passages (two numbers each) are sent to the tasks; the documents' grams then stay where they are.
MOST_GRAMS = 1_000_000


def grams(df: DataFrame, key: str, *more: str) -> DataFrame:
    """(key, gram): the runs of eight Latin words of each text, by hash."""
    words = F.split(F.lower("text"), "[^a-z0-9]+")
    runs = F.transform(F.sequence(F.lit(0), F.size("w") - 8), lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(8)]))
    return df.withColumn("w", words).where(F.size("w") >= 8).select(key, *more, F.explode(F.array_distinct(runs)).alias("gram"))


@query(f"""WITH p AS (SELECT DISTINCT d.doc_id, b.item_id FROM ({_GRAMS.format(k='doc_id', t='1 AS x', s='documents')}) d JOIN ({_GRAMS.format(k='item_id', t='1 AS y', s='benchmark')}) b USING (gram)),
e AS (SELECT DISTINCT p.doc_id, {_KEY.format('b.text')} AS w FROM p JOIN benchmark b USING (item_id)), t AS (SELECT doc_id, {_KEY.format('text')} AS t FROM documents)
SELECT t.doc_id, CAST(count(w) AS INT) AS n_expected, CAST(count(w) FILTER (WHERE NOT contains(t.t, w)) AS INT) AS n_missing FROM t LEFT JOIN e ON e.doc_id = t.doc_id AND w <> '' GROUP BY 1""")
def v5_action_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected of a document: the benchmark passages with which it shares eight words in a row."""
    items = fr.table(spark, sf_dir, "benchmark").select("item_id", "text")
    docs = records(spark, sf_dir)
    few = materialised(grams(items, "item_id"), "item-grams")
    if few.count() <= MOST_GRAMS:
        few = F.broadcast(few)
    wanted = grams(docs, "doc_id").join(few, "gram").select("doc_id", "item_id").distinct()
    return validate.action_recall(wanted.join(items, "item_id").select("doc_id", F.col("text").alias("action")), docs)


HEADERS, NONE = ["Action"], ["nothing here"]


def action_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as notes: a table of turns with header, rule, "none" rows, and a row of two cells."""
    from parley.functions.text import in_order

    c = fr.table(spark, sf_dir, "conversations").withColumn("t", F.regexp_replace("text", r"[|\n]", "/"))
    row = F.when(F.col("turn") % 5 == 4, F.lit("| nothing here yet | | |")).when(F.col("turn") % 5 == 3, F.concat(F.lit("| "), "t", F.lit(" | two |"))).otherwise(F.concat(F.lit("| "), "t", F.lit(" | "), "role", F.lit(" | |")))
    line = F.when(F.col("turn") == 0, F.concat(F.lit("Notes\n| Action | Who | Till |\n| --- | :---: | --- |\n| - | - | - |\n"), row)).otherwise(row)
    return c.groupBy(F.col("conv_id").alias("doc_id")).agg(in_order("turn", line, "\n").alias("text"))


def kept_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that leave out every third turn."""
    from parley.functions.text import in_order

    c = fr.table(spark, sf_dir, "conversations").where("turn % 3 <> 2")
    return c.groupBy(F.col("conv_id").alias("doc_id")).agg(in_order("turn", F.regexp_replace("text", r"[|\n]", "/"), "\n").alias("text"))


_NOTES = f"""turns AS (SELECT conv_id AS doc_id, turn, regexp_replace(text, '[|\\n]', '/', 'g') AS t FROM conversations),
wanted AS (SELECT DISTINCT doc_id, {_KEY.format('t')} AS w FROM turns WHERE turn % 5 < 3 AND NOT contains(t, 'nothing here') AND NOT contains(t, ':---') AND {_KEY.format('t')} <> ''),
kept AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY turn) AS text FROM turns WHERE turn % 3 <> 2 GROUP BY 1)"""


@query(f"WITH {_NOTES} SELECT k.doc_id, CAST(count(w) AS INT) AS n_expected, CAST(count(w) FILTER (WHERE NOT contains({_KEY.format('k.text')}, w)) AS INT) AS n_missing FROM kept k LEFT JOIN wanted USING (doc_id) GROUP BY 1")
def v5_note_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected actions are read from the notes' tables."""
    return validate.action_recall(validate.note_actions(action_notes(spark, sf_dir), "doc_id", HEADERS, NONE), kept_turns(spark, sf_dir))


@query("""WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b(\\d{2,4})\\b', 1)) AS year FROM documents), b AS (SELECT doc_id + 1 AS doc_id, unnest(regexp_extract_all(text, '\\b(\\d{2,4})\\b', 1)) AS year FROM documents)
SELECT DISTINCT doc_id, year FROM a EXCEPT SELECT doc_id, year FROM b""")
def v6_ungrounded_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = records(spark, sf_dir)
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), "text")
    return validate.ungrounded_years(docs, before, arabic=r"\b(\d{2,4})\b", chinese=None)


@query(f"""WITH {fr.LINES}, h AS (SELECT doc_id, bool_or(NOT contains(line, '|') AND NOT regexp_matches(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '^The\\b') AND regexp_matches(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '\\d+\\.\\d+')) AS has_source_tag FROM lines GROUP BY 1)
SELECT h.doc_id, has_source_tag, lang IN ('en', 'fr') AND NOT has_source_tag AS tag_missing FROM h JOIN documents USING (doc_id)""")
def v7_source_tag_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.source_tag_presence(records(spark, sf_dir), ["en", "fr"], r"\d+\.\d+", r"^The\b").select("doc_id", "has_source_tag", "tag_missing")


_PARTS = f"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), f AS (SELECT doc_id, bool_or({_FOREIGN}) AS fl FROM l GROUP BY 1),
i AS (SELECT d.doc_id, CASE r.k WHEN 'required' THEN 1 WHEN 'extra' THEN 2 ELSE 3 END AS a, r.ord AS b, CASE r.k WHEN 'required' THEN 'missing: ' WHEN 'extra' THEN 'missing info: ' ELSE 'forbidden: ' END || r.label AS issue FROM documents d JOIN r ON r.t = d.lang WHERE regexp_matches(d.text, r.p) = (r.k = 'forbidden')
UNION ALL SELECT doc_id, 4, 0, 'too short' FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 250
UNION ALL SELECT doc_id, 5, 0, 'markup leak' FROM documents WHERE {_LEAKS['markup_leak'].format(t='text')}
UNION ALL SELECT doc_id, 6, 0, 'foreign or rubric text' FROM documents JOIN f USING (doc_id) WHERE fl OR {_LEAKS['rubric_leak'].format(t='text')})"""


@query(f"WITH {_RULES}, {_PARTS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a, b) - 1 AS INT) AS issue_no, issue FROM i")
def v8_quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.quality_issues(records(spark, sf_dir), rules(spark))


YEAR, TAG, HEADER = r"\b(\d{2,4})\b", r"\d+\.\d+", r"^The\b"


def with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the actions of the conversation of their number as notes, and the document before them as transcript."""
    docs = records(spark, sf_dir)
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), "text")
    return validate.quality_evidence(docs, action_notes(spark, sf_dir), before, YEAR, None, HEADERS, NONE)


def all_issues(evidence: DataFrame, rules: DataFrame) -> DataFrame:
    return validate.issue_list(evidence, rules, 250, None, ["en", "fr"], TAG, HEADER, YEAR, None)


_ALL = f"""{_RULES}, {_PARTS}, {_NOTES}, {fr.LINES},
h AS (SELECT doc_id, bool_or(NOT contains(line, '|') AND NOT regexp_matches(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '^The\\b') AND regexp_matches(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '\\d+\\.\\d+')) AS tagged FROM lines GROUP BY 1),
lost AS (SELECT doc_id, count(*) AS n FROM wanted JOIN documents USING (doc_id) WHERE NOT contains({_KEY.format('text')}, w) GROUP BY 1),
told AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\b(\\d{{2,4}})\\b', 1)) AS year FROM documents),
made_up AS (SELECT doc_id, string_agg(year, ', ' ORDER BY year) AS years FROM (SELECT * FROM told WHERE doc_id - 1 IN (SELECT doc_id FROM documents) EXCEPT SELECT doc_id + 1, year FROM told) GROUP BY 1),
j AS (SELECT * FROM i UNION ALL SELECT doc_id, 7, 0, 'missing actions: ' || n FROM lost
UNION ALL SELECT doc_id, 8, 0, 'no source tag' FROM h JOIN documents USING (doc_id) WHERE lang IN ('en', 'fr') AND NOT tagged
UNION ALL SELECT doc_id, 9, 0, 'ungrounded years: ' || years FROM made_up)"""


@query(f"WITH {_ALL} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a, b) - 1 AS INT) AS issue_no, issue FROM j")
def v8_all_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 to V7 in one table."""
    found = all_issues(with_evidence(spark, sf_dir), rules(spark))
    return found.select("doc_id", F.posexplode("issues").alias("issue_no", "issue"))


@query(f"WITH {_ALL} SELECT d.doc_id, count(issue) AS n_issues, coalesce(string_agg(issue, '; ' ORDER BY a, b), '') AS issues FROM documents d LEFT JOIN j USING (doc_id) GROUP BY 1")
def v8_issue_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, a list per record."""
    found = all_issues(with_evidence(spark, sf_dir), rules(spark))
    return found.select("doc_id", F.size("issues").cast("long").alias("n_issues"), F.array_join("issues", "; ").alias("issues"))


@query(f"""WITH {fr.LINES}, n AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '^[ \\t]*>[ \\t]?', ''), '^[ \\t]*#{{1,6}}[ \\t]*', ''), '^[ \\t]*[-*•][ \\t]+', ''), '\\*\\*|__', '', 'g'), '\\r', '', 'g') AS line FROM lines),
m AS (SELECT doc_id, bool_or(starts_with(ltrim(line), 'The and')) AS la, bool_or(starts_with(ltrim(line), 'License')) AS lb, bool_or(starts_with(ltrim(line), 'Licensed under')) AS lc, bool_or(starts_with(ltrim(line), 'The')) AS ld, string_agg(line, chr(10) ORDER BY line_no) AS t FROM n GROUP BY 1)
SELECT doc_id, CASE WHEN la THEN 'a' WHEN lb THEN 'b' WHEN lc THEN 'c' WHEN ld THEN 'd' WHEN contains(t, 'Licensed under') THEN 'c' WHEN contains(t, 'The and') THEN 'a' WHEN contains(t, 'License') THEN 'b' WHEN contains(t, 'The') THEN 'd' ELSE 'none' END AS template_id FROM m""")
def v9_resolve_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.resolve_template(records(spark, sf_dir).drop("template_id"), TITLES, "none").select("doc_id", "template_id")


#: Acceptance limits for Latin documents: "body" characters are letters, the rest digits.
LATIN = {"body": 1500, "decision": 40, "meaningful": 300, "section": 20, "action": 8, "action_table": 20, "ratio": 0.98, "paragraphs": 5}


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = records(spark, sf_dir)
    return docs.select("*", F.when(F.col("doc_id") % 2 == 0, "docx").otherwise("md").alias("kind"), F.size(F.split("text", "\n")).alias("paragraphs"), F.lit(0).alias("tables"), F.lit(0).alias("needs_tables"))


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.acceptance_checks(artifacts(spark, sf_dir), rules(spark), {"en": "The and", "fr": "Le", "de": "Die"}, boundary="^The", limits=LATIN, body="[A-Za-z]", latin="[_]", markers=["token =", "!!"], actions=["Licensed under"], decision=" the ", name_field=r"(?m)^And")


_WINDOWS = """w_{n} AS (SELECT doc_id, max(len(regexp_extract_all(substr(regexp_replace(w, '(?m)^The(?s:.*)$', ''), 1, 1200), '[A-Za-z]'))) AS m FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '{p}')[2:]) AS w FROM documents) GROUP BY 1)"""
_V10 = f"""{_WINDOWS.format(n='d', p=' the ')}, {_WINDOWS.format(n='en2', p=' and then ')}, {_WINDOWS.format(n='fr', p=' le ')}, {_WINDOWS.format(n='de', p=' der ')},
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
la AS (SELECT doc_id, bool_or(starts_with(regexp_replace(regexp_replace(line, '^[ \\t]*[-*•][ \\t]+', ''), '^\\s+', ''), CASE lang WHEN 'en' THEN 'The and' WHEN 'fr' THEN 'Le' WHEN 'de' THEN 'Die' END)) AS titled,
  bool_or(regexp_matches(line, '^And')) AS named, bool_or(NOT regexp_matches(line, '^\\s*\\|.*\\|\\s*$') AND regexp_matches(line, 'Licensed under| die | que ') AND len(regexp_extract_all(regexp_replace(line, '^.*?(?:Licensed under| die | que )', ''), '[A-Za-z]')) >= 8) AS acts,
  bool_or(regexp_matches(line, '^\\s*\\|.*\\|\\s*$') AND NOT regexp_matches(line, '^\\s*\\|[\\s:|-]+\\|\\s*$') AND len(regexp_extract_all(line, '[A-Za-z]')) >= 20) AS tacts, count(*) AS paragraphs FROM ln JOIN documents USING (doc_id) GROUP BY 1),
ms AS (SELECT d.doc_id, count(*) FILTER (WHERE NOT regexp_matches(d.text, r.p)) AS missing FROM documents d LEFT JOIN r ON r.t = d.lang AND r.k IN ('required', 'extra') GROUP BY 1),
b AS (SELECT d.doc_id, d.lang, d.text, coalesce(titled, false) AS titled, named, acts, tacts, paragraphs, CASE WHEN missing IS NULL THEN 0 ELSE missing END AS missing, coalesce(w_d.m, 0) AS dec_m, len(regexp_extract_all(d.text, '[A-Za-z]')) AS n, len(regexp_extract_all(d.text, '[_0-9]')) AS o,
  (lang = 'en' AND (coalesce(w_d.m, 0) >= 20 OR coalesce(w_en2.m, 0) >= 20)) OR (lang = 'fr' AND coalesce(w_fr.m, 0) >= 20) OR (lang = 'de' AND coalesce(w_de.m, 0) >= 20) AS real_one
  FROM documents d JOIN la USING (doc_id) JOIN ms USING (doc_id) LEFT JOIN w_d USING (doc_id) LEFT JOIN w_en2 USING (doc_id) LEFT JOIN w_fr USING (doc_id) LEFT JOIN w_de USING (doc_id)),
q AS (SELECT *, contains(text, 'token =') OR contains(text, '!!') AS fallback, CASE WHEN n + o = 0 THEN 0.0::DOUBLE ELSE round(CAST(n AS DOUBLE) / (n + o), 6) END AS ratio FROM b),
c AS (SELECT doc_id, 'not_fallback' AS check_id, NOT fallback AS ok, CAST(fallback AS VARCHAR) AS detail FROM q UNION ALL SELECT doc_id, 'formal_title', titled OR named, CAST(titled AS VARCHAR) FROM q UNION ALL SELECT doc_id, 'required_sections', missing = 0, CAST(missing AS VARCHAR) FROM q
  UNION ALL SELECT doc_id, 'has_decisions', dec_m >= 40, CAST(dec_m AS VARCHAR) FROM q UNION ALL SELECT doc_id, 'has_action_items', acts OR tacts, CAST(acts AS VARCHAR) FROM q UNION ALL SELECT doc_id, 'min_length', n >= 1500, CAST(n AS VARCHAR) FROM q
  UNION ALL SELECT doc_id, 'no_placeholder', NOT regexp_matches(text, 'TODO|XXX') AND n >= 300 AND real_one, CAST(n AS VARCHAR) FROM q UNION ALL SELECT doc_id, 'structure_nonempty', CASE WHEN doc_id % 2 = 0 THEN paragraphs >= 5 END, CAST(paragraphs AS VARCHAR) FROM q
  UNION ALL SELECT doc_id, 'cjk_ratio', ratio >= 0.98, CAST(ratio AS VARCHAR) FROM q),
s AS (SELECT doc_id, check_id, CASE WHEN ok THEN 'PASS' WHEN ok IS NULL THEN 'SKIP' ELSE 'FAIL' END AS status, detail FROM c)"""


@query(f"WITH {_RULES}, {_V10} SELECT * FROM s")
def v10_acceptance_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks(spark, sf_dir)


@query(f"WITH {_RULES}, {_V10} SELECT doc_id, CASE WHEN bool_or(status = 'FAIL') THEN 'REJECTED' ELSE 'ACCEPTED' END AS verdict, count(*) FILTER (WHERE status = 'FAIL') AS n_failed FROM s GROUP BY 1")
def v11_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.verdict(checks(spark, sf_dir))


@query(f"""WITH {fr.LINES}, m AS (SELECT *, CASE WHEN regexp_matches(line, '^The') THEN 1 WHEN regexp_matches(line, '^And') THEN 0 END AS mark FROM lines),
s AS (SELECT *, count(mark) OVER w AS section FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
o AS (SELECT doc_id, section, max(mark) AS open, substr(string_agg(CASE WHEN mark = 1 THEN substr(line, 4) ELSE line END, chr(10) ORDER BY line_no), 1, 300) AS w FROM s WHERE section > 0 GROUP BY 1, 2)
SELECT doc_id, count(*) AS n_windows, CAST(max(len(regexp_extract_all(w, '[a-z]'))) AS INT) AS most_body FROM o WHERE open = 1 GROUP BY 1""")
def v12_section_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.section_windows(records(spark, sf_dir), "^The", "^And", cap=300, body="[a-z]")


@query("""WITH m AS (SELECT user_id AS run, count(*) AS n_lines, bool_and(event_id % 7 > 0 AND event_id % 7 + event_id % 9 <= 2 * (event_id % 7) AND event_id % 5 <= 3) AS metrics_ok FROM events WHERE event_type = 'view' GROUP BY 1),
k AS (SELECT user_id AS run, count(*) FILTER (WHERE event_type = 'error') AS n_markers FROM events GROUP BY 1)
SELECT k.run, coalesce(n_lines, 0) AS n_lines, coalesce(metrics_ok, false) AND n_markers = 0 AS ok FROM k LEFT JOIN m USING (run)""")
def v13_metrics_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = q_sources.log_lines(spark, sf_dir)
    metrics = readers.pipeline_metrics(logs).join(logs.select("line_no", "run"), "line_no")
    return validate.metrics_gate(metrics, logs, ["noise key=1 error"])


@query("""WITH a AS (SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_suppkey % 10 <> 3), b AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 10 = 7 THEN s_nationkey + 1 ELSE s_nationkey END AS s_nationkey FROM supplier WHERE s_suppkey % 10 <> 5)
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS gone, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS new, false AS same""")
def v14_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fr.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    end = s.where("s_suppkey % 10 <> 5").withColumn("s_nationkey", F.when(F.col("s_suppkey") % 10 == 7, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey")))
    return validate.snapshot_diff(s.where("s_suppkey % 10 <> 3"), end)


@query("SELECT user_id AS run, count(*) AS n, count(*) = 1 AS ok FROM events WHERE event_type = 'signup' GROUP BY 1")
def v15_unique_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.unique_mapping(readers.upload_mappings(q_sources.log_lines(spark, sf_dir)))


@query(f"WITH {fr.TASKS} SELECT task_id, seq, coalesce(status = 'completed', false) AND seq % 4 = 0 AS ok FROM task_events")
def v16_terminal_state_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.when(F.col("seq") % 4 == 0, False).when(F.col("seq") % 4 == 1, True)
    return validate.terminal_state_gate(fr.task_events(spark, sf_dir).withColumn("summary_failed", failed)).select("task_id", "seq", "ok")


@query("""WITH f AS (SELECT doc_id, length(text) >= 100 AS long_enough, regexp_matches(text, '(?m)^Le') AS structured, contains(lower(text), 'error') OR contains(lower(text), 'failed') AS has_error, len(regexp_extract_all(text, '\\b[A-Za-z]+\\b')) AS w, len(regexp_extract_all(text, '[㐀-鿿]')) AS c FROM (SELECT doc_id, regexp_replace(text, '[À-ÿ]', 'e', 'g') AS text FROM documents))
SELECT doc_id, long_enough, structured, has_error, CASE WHEN w + c = 0 THEN true ELSE w / (w + c) <= 0.1 END AS native_words, long_enough AND structured AND NOT has_error AND CASE WHEN w + c = 0 THEN true ELSE w / (w + c) <= 0.1 END AS valid FROM f""")
def v17_legacy_summary_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.legacy_summary_valid(records(spark, sf_dir).withColumn("text", F.regexp_replace("text", "[À-ÿ]", "e")), marks="(?m)^Le")


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as records with a table of turns after every second turn."""
    from parley.functions.text import in_order

    c = fr.table(spark, sf_dir, "conversations").withColumn("t", F.regexp_replace("text", r"[|\n]", "/"))
    line = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("## "), "t")).otherwise(F.concat(F.lit("| "), "role", F.lit(" | "), "t", F.lit(" |"), F.when(F.col("turn") % 3 == 1, "\n| --- | :-: |").otherwise("")))
    return c.groupBy(F.col("conv_id").alias("doc_id")).agg(in_order("turn", line, "\n").alias("text"))


@query("""WITH c AS (SELECT conv_id AS doc_id, turn, role, regexp_replace(text, '[|\\n]', '/', 'g') AS t FROM conversations WHERE turn % 3 <> 0),
n AS (SELECT *, CAST(turn // 3 AS INT) AS part FROM c), d AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY part) AS table_no, row_number() OVER (PARTITION BY doc_id, part ORDER BY turn) AS row_no FROM n)
SELECT doc_id, CAST(table_no AS INT) AS table_no, CAST(row_no AS INT) AS row_no, role || '^' || regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS cells FROM d""")
def e1_extract_md_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.extract_md_tables(markdown(spark, sf_dir)).withColumn("cells", F.array_join("cells", "^"))


@query("""WITH c AS (SELECT conv_id AS doc_id, turn, role, regexp_replace(text, '[|\\n]', '/', 'g') AS t, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations),
x AS (SELECT doc_id, min(CASE WHEN turn = 0 THEN t END) AS h, string_agg('| ' || role || ' | ' || t || ' |' || CASE WHEN turn % 3 = 1 THEN chr(10) || '| --- | :-: |' ELSE '' END, chr(10) ORDER BY turn) FILTER (WHERE turn IN (1, 2)) AS tbl FROM c GROUP BY 1),
k AS (SELECT '| 案由及承辦單位 | 辦理情形 | 解除列管 | 繼續列管 |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || '| ' AS head)
SELECT doc_id, CASE WHEN regexp_matches(h, '[:：]') AND nullif(regexp_replace(regexp_extract(h, '^[^:：]*[:：]((?s:.*))$', 1), '^\\s+|\\s+$', '', 'g'), '') IS NOT NULL THEN head || regexp_replace(regexp_extract(h, '^[^:：]*[:：]((?s:.*))$', 1), '^\\s+|\\s+$', '', 'g') || ' |  |  |  |' ELSE coalesce(tbl, head || '（待確認） |  |  |  |') END AS previous,
  coalesce(tbl, head || '（待確認） | （待確認）： |  |  |') AS summary FROM x, k""")
def e2_tracking_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.tracking_tables(markdown(spark, sf_dir), previous="^## ", summary="^## ")


FORM = [("A", "The", False), ("B", "And|Of", False), ("C", "Licensed under", True)]


@query(f"""WITH {fr.LINES}, s AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(line, '^(The|And|Of|Licensed under) ', '\\1: '), '^\\s+|\\s+$', '', 'g') AS line FROM lines),
e AS (SELECT *, max(CASE WHEN regexp_matches(line, '^A ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS ended FROM s WHERE NOT starts_with(line, '# ')),
m AS (SELECT *, CASE WHEN regexp_matches(line, '^The\\s*:') THEN 'A' WHEN regexp_matches(line, '^(And|Of)\\s*:') THEN 'B' WHEN regexp_matches(line, '^Licensed under\\s*:') THEN 'C' END AS label FROM e WHERE ended = 0),
b AS (SELECT *, count(label) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM m),
f AS (SELECT *, max(label) OVER (PARTITION BY doc_id, block) AS field FROM b WHERE block > 0),
p AS (SELECT doc_id, field, block, regexp_replace(string_agg(CASE WHEN label IS NOT NULL THEN regexp_replace(regexp_replace(line, '^(The|And|Of|Licensed under)\\s*:', ''), '^\\s+', '') ELSE line END, chr(10) ORDER BY line_no), '^\\n+|\\n+$', '', 'g') AS value FROM f WHERE label IS NOT NULL OR field <> 'C' GROUP BY 1, 2, 3),
v AS (SELECT doc_id, field, arg_min(value, block) AS value FROM p WHERE value <> '' GROUP BY 1, 2)
SELECT d.doc_id, x.field, coalesce(v.value, '（待確認）') AS value FROM documents d CROSS JOIN (VALUES ('A'), ('B'), ('C')) x(field) LEFT JOIN v ON v.doc_id = d.doc_id AND v.field = x.field""")
def e3_extract_form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = records(spark, sf_dir).withColumn("text", F.array_join(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, "^(The|And|Of|Licensed under) ", "$1: ")), "\n"))
    return validate.extract_form_fields(docs, FORM, terminator="^A ")


@query(f"""WITH {fr.LINES}, s AS (SELECT doc_id, line_no, line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM lines),
k AS (SELECT *, CASE WHEN regexp_matches(s, '^#{{1,6}} ') THEN 'heading' WHEN regexp_matches(s, '^\\|[\\s:|-]+\\|$') THEN 'table_rule' WHEN regexp_matches(s, '^\\|.*\\|$') THEN 'table' WHEN regexp_matches(s, '^(?:-{{3,}}|\\*{{3,}}|_{{3,}})$') THEN 'rule' WHEN starts_with(s, '>') THEN 'quote'
  WHEN regexp_matches(s, '^(?:[-*+]|\\d+[.)]) ') THEN 'list' WHEN regexp_matches(s, '^[A-Z][a-z]+\\.') THEN 'section' WHEN regexp_matches(s, '^([^\\s|#>*,\\-]{{1,12}})\\s*,\\s*(.*)$') THEN 'label' ELSE 'paragraph' END AS kind FROM s WHERE s <> '')
SELECT doc_id, CAST(line_no AS INT) AS line_no, kind, CAST(CASE kind WHEN 'heading' THEN length(regexp_extract(s, '^(#{{1,6}}) ', 1)) WHEN 'list' THEN length(regexp_extract(line, '^( *)', 1)) // 2 + 1 ELSE 0 END AS INT) AS level,
  CASE WHEN kind = 'label' THEN regexp_extract(s, '^([^\\s|#>*,\\-]{{1,12}})\\s*,\\s*(.*)$', 1) ELSE '' END AS label, CASE WHEN kind = 'label' THEN regexp_extract(s, '^([^\\s|#>*,\\-]{{1,12}})\\s*,\\s*(.*)$', 2) ELSE '' END AS value FROM k""")
def e4_classify_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.classify_lines(records(spark, sf_dir), section=r"^[A-Z][a-z]+\.", label=r"^([^\s|#>*,\-]{1,12})\s*,\s*(.*)$")


@query(f"WITH {fr.LINES} SELECT doc_id, CAST(line_no AS INT) AS line_no, unnest(regexp_extract_all(regexp_replace(line, '\\*\\*\\*', '**', 'g'), '\\*\\*([^*]+)\\*\\*', 1)) AS span FROM lines")
def e5_bold_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.bold_spans(records(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"\*\*\*", "**")))
