"""Queries of cleaning. Patterns with a DuckDB form use neither look-around nor back-references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import normalise_headings
from parley.operators import clean, correct
from parley.plans import frames as fr
from parley.plans import q_sources, templates
from parley.plans.registry import query

#: Latin stand-ins for the rule tables, so that both engines see hits in the given documents.
DRIFT = "éèäß"
MAPPING = {"é": "e", "è": "e", "ä": "a", "ß": "s"}
PATTERNS = [r"Licensed under[^\n]*", r"Released under[^\n.]*\.", r"This work is licensed[^\n]*"]
FIXES = [("the the", "the"), ("erth", "earth"), ("que que", "que")]
VOCABULARY = [(" the ", " THE "), (" die ", " DIE "), ("that of ", "of ")]
TOKEN, LINES = r"(?:tion|ment)", [r"^The\b", r"\.$"]
HEADERS = [("Title: (tbc)", r"^Title\s*:"), ("Opening", r"^The and\b")]
SECTIONS = [(r"Licen[sc]ed", ["License:", "(tbc)"], [(r"Apache", ["Apache: (tbc)"]), (r"Version", ["Version: (tbc)"])]), (" the ", ["Body", "none"], [])]


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.documents(spark, sf_dir).select("doc_id", "text")


def hashed(df: DataFrame, *more: str) -> DataFrame:
    return df.select("doc_id", F.sha2("text", 256).alias("text_hash"), *more)


@query(f"WITH {fr.LINES} SELECT doc_id, CAST(count(*) FILTER (WHERE regexp_matches(line, '[{DRIFT}]')) AS INT) AS drift_lines, CAST(sum(len(regexp_extract_all(line, '[{DRIFT}]'))) AS INT) AS drift_chars FROM lines GROUP BY 1")
def p6_simplified_drift_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drift_counts(docs(spark, sf_dir), DRIFT).select("doc_id", "drift_lines", "drift_chars")


@query(f"WITH {fr.LINES} SELECT doc_id, sha256(string_agg(CASE WHEN regexp_matches(line, '[éß]') THEN translate(line, 'éèäß', 'eeas') ELSE line END, chr(10) ORDER BY line_no)) AS text_hash FROM lines GROUP BY 1")
def p7_variant_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(docs(spark, sf_dir).withColumn("text", clean.variant_normalised(F.col("text"), MAPPING, "éß")))


_PLAIN = "regexp_replace(text, '[#|>*`\\-]+', ' ', 'g')"


@query(f"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[㐀-鿿]')) AS cjk_chars, len(regexp_extract_all(text, '[A-Za-z]')) AS latin_chars, len(regexp_extract_all(text, '[0-9]')) AS digit_chars,
  len(regexp_extract_all({_PLAIN}, '\\b[a-zA-Z][A-Za-z0-9_/-]*\\b')) AS words, len(regexp_extract_all({_PLAIN}, '[㐀-鿿]')) AS plain_cjk FROM (SELECT doc_id, regexp_replace(text, '[À-ÿ]', 'e', 'g') AS text FROM documents)),
r AS (SELECT *, CASE WHEN words + plain_cjk = 0 THEN 0.0 ELSE CAST(words AS DOUBLE) / (words + plain_cjk) END AS ratio, CASE WHEN cjk_chars + latin_chars + digit_chars = 0 THEN 0.0 ELSE CAST(cjk_chars AS DOUBLE) / (cjk_chars + latin_chars + digit_chars) END AS share FROM c)
SELECT doc_id, cjk_chars, latin_chars, digit_chars, round(share, 6) AS cjk_share, round(ratio, 6) AS foreign_ratio, ratio > 0.25 AS excess, ratio > 0.15 AS above_15, ratio > 0.10 AS above_10 FROM r""")
def p8_language_mix_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Word ends beside letters with accents differ between the dialects.
    return clean.language_mix(docs(spark, sf_dir).withColumn("text", F.regexp_replace("text", "[À-ÿ]", "e")))


_C1 = f"""b1 AS (SELECT doc_id, text, len(regexp_extract_all(text, '{PATTERNS[0]}')) AS n1, regexp_replace(text, '{PATTERNS[0]}', '', 'g') AS t1 FROM documents),
b2 AS (SELECT *, len(regexp_extract_all(t1, '{PATTERNS[1]}')) AS n2, regexp_replace(t1, '{PATTERNS[1]}', '', 'g') AS t2 FROM b1),
b3 AS (SELECT *, len(regexp_extract_all(t2, '{PATTERNS[2]}')) AS n3, regexp_replace(t2, '{PATTERNS[2]}', '', 'g') AS t3 FROM b2),
c1 AS (SELECT doc_id, CAST(n1 + n2 + n3 AS INT) AS boilerplate_removed, regexp_replace(CASE WHEN n1 + n2 + n3 > 0 THEN regexp_replace(regexp_replace(t3, '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') ELSE t3 END, '^\\s+|\\s+$', '', 'g') AS text FROM b3)"""


@query(f"WITH {_C1} SELECT doc_id, sha256(text) AS text_hash, boilerplate_removed FROM c1")
def c1_remove_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(clean.remove_boilerplate(docs(spark, sf_dir), PATTERNS, ignore_case=False), "boilerplate_removed")


@query()
def c2_collapse_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(clean.collapse_loops(docs(spark, sf_dir)), "loops_collapsed")


_C3 = """c3l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line, len(string_split(text, chr(10))) AS total FROM {src}),
c3p AS (SELECT *, CASE WHEN n < total - 1 THEN line || chr(10) ELSE line END AS part, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM c3l),
c3m AS (SELECT *, length(s) >= 4 AND coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY n) = s, false) AS gone FROM c3p),
c3 AS (SELECT doc_id, coalesce(string_agg(part, '' ORDER BY n) FILTER (WHERE NOT gone), '') AS text, CAST(count(*) FILTER (WHERE gone) AS INT) AS dedup_removed FROM c3m GROUP BY 1)"""


@query(f"WITH {_C3.format(src='documents')} SELECT doc_id, sha256(text) AS text_hash, dedup_removed FROM c3")
def c3_dedup_consecutive_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(clean.dedup_consecutive_sentences(docs(spark, sf_dir), ends="(?<=\n)"), "dedup_removed")


_FIXED = "regexp_replace(regexp_replace(regexp_replace(text, 'the the', 'the', 'g'), 'erth', 'earth', 'g'), 'que que', 'que', 'g')"


@query(f"SELECT doc_id, sha256({_FIXED}) AS text_hash, concat_ws(',', CASE WHEN contains(text, 'the the') THEN 'the the' END, CASE WHEN contains(text, 'erth') THEN 'erth' END, CASE WHEN contains(text, 'que que') THEN 'que que' END) AS fired FROM documents")
def c4_apply_term_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(clean.apply_term_fixes(docs(spark, sf_dir), FIXES).withColumn("fired", F.array_join("term_fixes", ",")), "fired")


@query()
def c5_clean_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(clean.clean_corpus(docs(spark, sf_dir), MAPPING, PATTERNS, FIXES), "boilerplate_removed", "loops_collapsed", "dedup_removed", "term_fixes")


_C6 = f"""WITH {fr.LINES}, f AS (SELECT *, ltrim(line, ' ' || chr(9)) AS start, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM lines),
g AS (SELECT *, NOT (contains(line, '（待確認）') OR s = '' OR regexp_matches(start, '^[#*|\\->]')) AND (regexp_matches(start, '^(?i:Sure\\b|Here''?s\\b)') OR (regexp_matches(start, '^[A-Za-z]') AND NOT contains(line, 'License')
  AND len(regexp_extract_all(regexp_replace(line, '[\\p{{L}}\\p{{N}}_]*[\\p{{N}}_À-ÖØ-öø-ÿ][\\p{{L}}\\p{{N}}_]*', ' ', 'g'), '[a-zA-Z]+')) > 0.5 * len(regexp_extract_all(line, '\\S+')) AND len(regexp_extract_all(line, '[㐀-鿿]')) < 4)) AS gone FROM f)"""


@query(f"{_C6} SELECT doc_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '')) AS text_hash, CAST(count(*) FILTER (WHERE gone) AS INT) AS lines_dropped FROM g GROUP BY 1")
def c6_drop_foreign_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(clean.drop_foreign_lines(docs(spark, sf_dir), ["License"], r"(?i)^(?:Sure\b|Here'?s\b)"), "lines_dropped")


@query("SELECT doc_id, sha256(replace(replace(replace(text, ' the ', ' THE '), ' die ', ' DIE '), 'that of ', 'of ')) AS text_hash FROM documents")
def c7_replace_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(clean.replace_vocabulary(docs(spark, sf_dir), VOCABULARY))


@query(f"WITH {fr.LINES} SELECT doc_id, sha256(string_agg(CASE WHEN regexp_matches(line, '{TOKEN}') AND (regexp_matches(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '^The\\b') OR regexp_matches(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '\\.$')) THEN regexp_replace(regexp_replace(line, '{TOKEN}', '(tbc)', 'g'), '(?:\\(tbc\\)){{2,}}', '(tbc)', 'g') ELSE line END, chr(10) ORDER BY line_no)) AS text_hash FROM lines GROUP BY 1")
def c8_repair_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(clean.repair_placeholders(docs(spark, sf_dir), TOKEN, LINES, "(tbc)"))


#: Openings and endings of model outputs, for records that have them.
OPENINGS = ["<think>a\nb</think>\n", "```markdown\n", "好的，我來整理如下：\n", "以下是本次會議記錄：", "以下是整理結果。", "我為您整理重點：", "根據逐字稿，", "OK, ", "Sure，", "<details open>\nx\n</details>\n\n\n\n"]
ENDINGS = ["\n```", "", "\n</details>", "\n\n\n\nend"]


def _nested(text: str, patterns: list[str], flags: str) -> str:
    for p in patterns:
        text = f"regexp_replace({text}, '{flags}{p}', '', 'g')"
    return text


def _chosen(texts: list[str]) -> str:
    return "[" + ", ".join("'" + t.replace("\n", "' || chr(10) || '") + "'" for t in texts) + "]"


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_C9 = rf"""w AS (SELECT doc_id, {_chosen(OPENINGS)}[doc_id % {len(OPENINGS)} + 1] || CASE WHEN doc_id % 3 = 0 THEN '會議名稱：例會' || chr(10) WHEN doc_id % 7 = 0 THEN '# head' || chr(10) ELSE '' END || text || {_chosen(ENDINGS)}[doc_id % {len(ENDINGS)} + 1] AS t FROM documents),
a AS (SELECT doc_id, t, {_TRIM.format("regexp_replace(" + _nested(_TRIM.format("t"), clean.WRAPPERS, "(?im)") + r", '(?i)^\s*```(?:markdown)?\s*', '')")} AS x FROM w),
b AS (SELECT doc_id, t, regexp_replace({_nested("x", clean.CLOSING, "(?im)")}, '\n{{3,}}', chr(10) || chr(10), 'g') AS x FROM a),
c AS (SELECT doc_id, t, {_TRIM.format(f"CASE WHEN regexp_matches(x, '(?m){clean.ANCHORS}') THEN substr(x, length(regexp_extract(x, '(?s)^(.*?)(?m:{clean.ANCHORS})', 1)) + 1) ELSE x END")} AS x FROM b)"""


@query(f"WITH {_C9} SELECT doc_id, sha256(x) AS text_hash, CAST(length(t) - length(x) AS INT) AS stripped FROM c")
def c9_strip_generated_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda texts: F.get(F.array(*[F.lit(t) for t in texts]), (F.col("doc_id") % len(texts)).cast("int"))
    head = F.when(F.col("doc_id") % 3 == 0, "會議名稱：例會\n").when(F.col("doc_id") % 7 == 0, "# head\n").otherwise("")
    wrapped = docs(spark, sf_dir).withColumn("text", F.concat(pick(OPENINGS), head, "text", pick(ENDINGS)))
    return hashed(clean.strip_wrappers(wrapped), "stripped")


#: Latin letters by characters of CJK texts and full-width marks, so that blanks stand between all kinds.
WIDE_FROM, WIDE_TO = "aeinrsto.,", "會議記錄かナ龍人，。"
_C10 = rf"regexp_replace(regexp_replace(translate(text, '{WIDE_FROM}', '{WIDE_TO}'), '\s+', ' ', 'g'), ' ?([，。]) ?', '\1', 'g')"
_WIDE = r"[\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
_C10 = rf"regexp_replace(regexp_replace({_C10}, '({_WIDE}) +', '\1' || chr(1), 'g'), chr(1) || '({_WIDE})', '\1', 'g')"


@query(rf"SELECT doc_id, sha256(regexp_replace(replace({_C10}, chr(1), ' '), '^\s+|\s+$', '', 'g')) AS text_hash FROM documents")
def c10_normalise_cjk_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = docs(spark, sf_dir).withColumn("text", F.translate("text", WIDE_FROM, WIDE_TO))
    return hashed(wide.withColumn("text", clean.cjk_spaced(F.col("text"))))


@query(r"""WITH h AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?m)^(T|D|L)', '##\1', 'g'), '(?m)^A', '####A', 'g') || chr(10) || chr(10) || chr(10) AS text FROM documents)
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '(?m)^(#{1,3})\s*', '\1 ', 'g'), '^\s+|\s+$', '', 'g')) AS text_hash FROM h""")
def c13_normalise_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with some initials are headings without a space."""
    headed = F.concat(F.regexp_replace(F.regexp_replace("text", "(?md)^(T|D|L)", "##$1"), "(?md)^A", "####A"), F.lit("\n\n\n"))
    return hashed(docs(spark, sf_dir).withColumn("text", normalise_headings(headed)))


_C11 = r"""t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS text FROM {src}),
p AS (SELECT doc_id, text, concat_ws(chr(10), CASE WHEN NOT regexp_matches(text, '(?m)^Title\s*:') THEN 'Title: (tbc)' END, CASE WHEN NOT regexp_matches(text, '(?m)^The and\b') THEN 'Opening' END) AS head,
  concat_ws(chr(10), CASE WHEN NOT regexp_matches(text, 'Licen[sc]ed') THEN 'License:' || chr(10) || '(tbc)' ELSE nullif(concat_ws(chr(10), CASE WHEN NOT contains(text, 'Apache') THEN 'Apache: (tbc)' END, CASE WHEN NOT contains(text, 'Version') THEN 'Version: (tbc)' END), '') END,
  CASE WHEN NOT contains(text, ' the ') THEN 'Body' || chr(10) || 'none' END) AS tail FROM t)
SELECT doc_id, sha256(regexp_replace(concat_ws(chr(10) || chr(10), nullif(head, ''), nullif(text, ''), nullif(tail, '')), '^\s+|\s+$', '', 'g')) AS text_hash FROM p"""


@query("WITH " + _C11.replace("{src}", "documents"))
def c11_ensure_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(clean.ensure_structure(docs(spark, sf_dir), HEADERS, SECTIONS))


@query(f"""{_C6}, k AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS text FROM g GROUP BY 1),
v AS (SELECT doc_id, replace(replace(replace(text, ' the ', ' THE '), ' die ', ' DIE '), 'that of ', 'of ') AS text FROM k), """ + _C11.replace("{src}", "v"))
def c12_finalise_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean.replace_vocabulary(clean.drop_foreign_lines(docs(spark, sf_dir), ["License"], r"(?i)^(?:Sure\b|Here'?s\b)"), VOCABULARY)
    return hashed(clean.ensure_structure(out, HEADERS, SECTIONS))


@query()
def c12_finalise_with_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(clean.finalise_records(docs(spark, sf_dir), templates.GENERAL_HEADERS, templates.GENERAL_SECTIONS, protected(spark, sf_dir)), "excess")


def protected(spark: SparkSession, sf_dir: str) -> list[str]:
    """English terms of one scope's glossary."""
    return correct.protected_terms(q_sources.s3_read_glossary_terms(spark, sf_dir).where("scope = 'src0'"))
