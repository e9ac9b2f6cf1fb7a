"""Queries of correction. Syllables of Latin letters stand in for those of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import correct
from parley.plans import frames as fr
from parley.plans import q_sources
from parley.plans.registry import query
from parley.sources import readers

#: letter: (initial, final). b/d and v/w sound alike by their initials, i/y by their finals.
LETTERS = {"b": ("zh", "a"), "d": ("z", "a"), "v": ("f", "u"), "w": ("h", "u"), "i": ("y", "in"), "y": ("y", "ing"), "o": ("", "o"), "e": ("", "e"), "n": ("n", "an"), "r": ("r", "ang"), "l": ("l", "an"), "t": ("t", "o"), "h": ("h", "e"), "a": ("", "a"), "s": ("sh", "i"), "z": ("s", "i")}
TERMS = ["thor", "enan", "than", "owe", "sed", "toro"]


def syllables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, i, f) for c, (i, f) in LETTERS.items()], "ch string, initial string, final string")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as segments."""
    return fr.lines_of(fr.documents(spark, sf_dir)).select("doc_id", F.col("line_no").alias("seg_no"), F.col("line").alias("text"))


@query("SELECT doc_id, sha256(text) AS text_hash FROM documents WHERE text <> ''")
def k1_segment_for_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments joined give each document back; longer ones than 400 characters would show as another hash."""
    from parley.functions.text import in_order

    segs = correct.segment_for_correction(fr.documents(spark, sf_dir))
    fit = F.when(F.length("text") <= 400, F.col("text")).otherwise("too long")
    return segs.groupBy("doc_id").agg(F.sha2(in_order("seg_no", fit), 256).alias("text_hash"))


@query()
def k1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.segment_for_correction(fr.documents(spark, sf_dir)).select("doc_id", "seg_no", F.length("text").alias("n_chars"))


_SEGS = "segs AS (SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS seg_no, unnest(string_split(text, chr(10))) AS text FROM documents)"


def wrong_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two words of each benchmark passage."""
    words = F.split(F.regexp_replace("text", r"[.,\s]+$", ""), " ")
    return fr.table(spark, sf_dir, "benchmark").select(F.concat_ws(" ", F.element_at(words, -2), F.element_at(words, -1)).alias("wrong"), F.lit("x").alias("right"))


_FORMS = "forms AS (SELECT DISTINCT concat_ws(' ', string_split(t, ' ')[-2], string_split(t, ' ')[-1]) AS wrong FROM (SELECT regexp_replace(text, '[.,\\s]+$', '') AS t FROM benchmark))"


@query(f"WITH {_SEGS}, {_FORMS} SELECT doc_id, seg_no FROM segs s WHERE EXISTS (SELECT 1 FROM forms f WHERE contains(s.text, f.wrong))")
def k2_needs_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.needs_correction(segments(spark, sf_dir), wrong_forms(spark, sf_dir)).select("doc_id", "seg_no")


def _near_values() -> str:
    known = {f"{i}|{f}": (i, f) for i, f in LETTERS.values()}
    alike = lambda a, b, pairs: a == b or (a, b) in pairs or (b, a) in pairs
    near = sorted((a, b) for a, (ia, fa) in known.items() for b, (ib, fb) in known.items() if alike(ia, ib, correct.NEAR_INITIALS) and alike(fa, fb, correct.NEAR_FINALS))
    syl = {c: f"{i}|{f}" for c, (i, f) in LETTERS.items()}
    letters = ", ".join(f"('{x}', '{y}')" for x in LETTERS for y in LETTERS if (syl[x], syl[y]) in near)
    return f"near(x, y) AS (VALUES {letters})"


_K3 = f"""{_near_values()}, {_SEGS}, terms(term) AS (VALUES {', '.join(f"('{t}')" for t in TERMS)}),
plain AS (SELECT doc_id, seg_no, regexp_replace(text, '[^a-z]', '', 'g') AS p FROM segs),
win AS (SELECT doc_id, seg_no, p, term, unnest(range(0, CAST(length(p) - length(term) + 1 AS BIGINT))) AS start FROM plain, terms WHERE length(p) >= length(term) AND NOT contains(p, term)),
cells AS (SELECT doc_id, seg_no, term, start, substr(p, CAST(start + o + 1 AS INT), 1) AS x, substr(term, CAST(o + 1 AS INT), 1) AS y FROM (SELECT *, unnest(range(0, CAST(length(term) AS BIGINT))) AS o FROM win))"""


@query(f"WITH {_K3} SELECT doc_id, seg_no, term, CAST(start AS INT) AS start FROM cells GROUP BY 1, 2, 3, 4 HAVING bool_and((x, y) IN (SELECT (x, y) FROM near))")
def k3_near_homophone_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    return correct.near_homophone_hits(segments(spark, sf_dir), terms, syllables(spark), "[a-z]")


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with candidates: letters swapped for near ones, others for wrong ones, some dropped, added, or rewritten."""
    # At most 400 characters each, which bounds difflib; no text is left out.
    s = correct.segment_for_correction(fr.documents(spark, sf_dir))
    k = F.pmod(F.col("doc_id") * 7 + F.col("seg_no"), F.lit(6))
    first = lambda a, b: F.regexp_replace("text", f"(?s)^(.*?){a}", f"$1{b}")
    candidate = F.when(k == 0, first("b", "d")).when(k == 1, first("n", "x")).when(k == 2, F.concat("text", F.lit(" and more"))).when(k == 3, F.substring("text", 3, 10_000)).when(k == 4, F.reverse("text")).otherwise(F.col("text"))
    return s.select("doc_id", "seg_no", F.col("text").alias("original"), candidate.alias("candidate"))


def gated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    glossary = spark.createDataFrame([("n", "x")], "wrong string, right string").limit(0)
    return correct.gate_corrections(proposals(spark, sf_dir), syllables(spark), glossary)


@query()
def k4_gate_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir)[0].select("doc_id", "seg_no", F.sha2("text", 256).alias("text_hash"), "dropped")


@query()
def k4_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir)[1]


@query(f"""WITH {_SEGS}, c AS (SELECT doc_id, seg_no, string_split(text, ' ')[1] AS original, string_split(text, ' ')[2] AS corrected, (doc_id + seg_no) % 3 = 0 AS accepted, (doc_id + seg_no) % 5 = 1 AND (doc_id + seg_no) % 3 <> 0 AS whole FROM segs WHERE len(string_split(text, ' ')) > 1)
SELECT doc_id, (SELECT count(*) FROM segs s WHERE s.doc_id = c.doc_id) AS segments_total, count(*) FILTER (WHERE accepted) AS segments_corrected, count(*) FILTER (WHERE whole) AS segments_discarded FROM c GROUP BY 1
UNION ALL SELECT doc_id, count(*), 0, 0 FROM segs WHERE doc_id NOT IN (SELECT doc_id FROM c) GROUP BY 1""")
def k5_correction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.correction_report(_changes(spark, sf_dir), segments(spark, sf_dir))[0]


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, n = F.split("text", " "), F.col("doc_id") + F.col("seg_no")
    s = segments(spark, sf_dir).where(F.size(w) > 1)
    return s.select("doc_id", "seg_no", F.when((n % 5 == 1) & (n % 3 != 0), -1).otherwise(0).alias("op_no"), F.get(w, F.lit(0)).alias("original"), F.get(w, F.lit(1)).alias("corrected"), (n % 3 == 0).alias("accepted"))


@query(f"""WITH {_SEGS}, c AS (SELECT doc_id, seg_no, string_split(text, ' ')[1] AS original, string_split(text, ' ')[2] AS corrected FROM segs WHERE len(string_split(text, ' ')) > 1 AND (doc_id + seg_no) % 3 = 0),
f AS (SELECT doc_id, original, corrected, min(seg_no) AS pos FROM c GROUP BY 1, 2, 3) SELECT doc_id, original, corrected, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS ord FROM f""")
def k5_accepted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.correction_report(_changes(spark, sf_dir), segments(spark, sf_dir))[1]


@query(f"WITH {_SEGS} SELECT doc_id, seg_no, right(coalesce(string_agg(text, '') OVER (PARTITION BY doc_id ORDER BY seg_no ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), ''), 60) AS context FROM (SELECT * FROM segs WHERE text <> '')")
def k6_preceding_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.preceding_context(segments(spark, sf_dir).where("text <> ''")).select("doc_id", "seg_no", "context")


@query(f"WITH {q_sources.GLOSSARY}, u AS (SELECT *, sum(length(term) + 1) OVER (PARTITION BY scope ORDER BY ord) AS upto FROM terms) SELECT scope, count(*) AS n_terms, string_agg(term, ' ' ORDER BY ord) AS hotwords FROM u WHERE upto <= 120 GROUP BY 1")
def k7_hotword_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.hotword_prefix(q_sources.s3_read_glossary_terms(spark, sf_dir), 120)


@query(f"""WITH {q_sources.GLOSSARY}, t AS (SELECT scope, string_agg(term, '、' ORDER BY ord) AS a FROM terms WHERE ord <= 8 GROUP BY 1), p AS (SELECT scope, string_agg(wrong || '→' || rgt, '、' ORDER BY ord) AS b FROM pairs WHERE ord <= 4 GROUP BY 1)
SELECT coalesce(t.scope, p.scope) AS scope, concat_ws(chr(10), a, b) AS block FROM t FULL JOIN p ON t.scope = p.scope""")
def k7_glossary_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct.glossary_block(q_sources.s3_read_glossary_terms(spark, sf_dir), q_sources.s3_read_glossary_pairs(spark, sf_dir), 8, 4)


@query(f"""WITH {q_sources.GLOSSARY}, s AS (SELECT DISTINCT scope FROM terms WHERE scope <> 'src0'), a AS (SELECT s.scope, term, 0 AS side, ord FROM terms CROSS JOIN s WHERE terms.scope = 'src0' UNION ALL SELECT scope, term, 1, ord FROM terms WHERE scope <> 'src0'),
f AS (SELECT scope, term, min((side, ord)) AS pos FROM a GROUP BY 1, 2) SELECT scope, CAST(row_number() OVER (PARTITION BY scope ORDER BY pos) AS INT) AS ord, term FROM f""")
def k8_union_glossaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = q_sources.s3_read_glossary_terms(spark, sf_dir)
    return correct.union_glossaries(terms.where("scope = 'src0'"), terms.where("scope <> 'src0'"))


@query(f"WITH {q_sources.GLOSSARY}, m AS (SELECT scope, ord, CASE WHEN ord % 3 = 0 THEN '第' || ord || '項' WHEN ord % 3 = 1 THEN term || '組' ELSE term END AS term FROM terms) SELECT * FROM m WHERE regexp_matches(term, '[A-Za-z]')")
def k9_english_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third term is in Chinese, every third mixed."""
    n = F.col("ord").cast("string")
    term = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("第"), n, F.lit("項"))).when(F.col("ord") % 3 == 1, F.concat("term", F.lit("組"))).otherwise(F.col("term"))
    return correct.english_terms(q_sources.s3_read_glossary_terms(spark, sf_dir).withColumn("term", term))


@query(f"""WITH {_SEGS}, r AS (SELECT *, (doc_id + seg_no) % 11 = 5 AS stable, (doc_id + seg_no) % 4 = 2 AS soft FROM segs), b AS (SELECT *, bool_or(stable) OVER (PARTITION BY doc_id ORDER BY seg_no) AS broken FROM r)
SELECT doc_id, seg_no, broken, CASE WHEN broken OR stable OR soft THEN length(text) ELSE length(text) + 1 END AS n_final FROM b""")
def m15_circuit_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") + F.col("seg_no")
    r = segments(spark, sf_dir).withColumn("candidate", F.concat("text", F.lit("!"))).withColumn("error", F.when(n % 11 == 5, "PROVIDER_UNREACHABLE").when(n % 4 == 2, "timed out once"))
    return correct.circuit_break(r).select("doc_id", "seg_no", "broken", F.length("final").alias("n_final"))
