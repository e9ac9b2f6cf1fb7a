"""Validation of records against rule tables, grounding in transcripts, acceptance checks, and extraction from records.

Rules are few (checked against MAX_RULES), so they become literal patterns in one expression over a record's row: no
shuffle, and each pattern is compiled once. What spans several rows is keyed by the record.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions.text import CJK, CJK_BODY, CONFIRM, action_key, chars_of, counted, dynamic_min_chars, estimate_tokens, in_order, once
from parley.operators.clean import stripped

MAX_RULES = 5000
NO_LABELS = "array<string>"


def rule_rows(rules: DataFrame) -> list:
    """A rule table's rows (template_id, kind, ord, label, pattern) in order."""
    rows = rules.orderBy("template_id", "ord").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: join them as a table instead")
    return rows


def _labels(rows: list, kinds: tuple[str, ...], hit: bool, prefix: str = "") -> Column:
    """Labels of the record's template whose pattern is there (hit) or isn't."""
    text = F.coalesce("text", F.lit(""))
    found = []
    for r in rows:
        if r["kind"] in kinds:
            there = text.rlike("(?U)" + r["pattern"])
            found.append(F.when((F.col("template_id") == r["template_id"]) & (there if hit else ~there), F.lit(prefix + r["label"])))
    return F.array_compact(F.array(*found)) if found else F.array().cast(NO_LABELS)


def missing_sections(records: DataFrame, rules: DataFrame) -> DataFrame:
    """V1: adds ``missing``: labels of required and extra patterns that the record lacks."""
    return records.withColumn("missing", _labels(rule_rows(rules), ("required", "extra"), False))


def forbidden_hits(records: DataFrame, rules: DataFrame) -> DataFrame:
    """V2: adds ``forbidden``: labels of forbidden patterns that the record has."""
    return records.withColumn("forbidden", _labels(rule_rows(rules), ("forbidden",), True))


def length_gate(records: DataFrame, minimum: Column | int = 250) -> DataFrame:
    """V3: adds ``too_short``."""
    return records.withColumn("too_short", F.length(stripped(F.coalesce("text", F.lit("")))) < minimum)


def length_gate_by_source(records: DataFrame, transcripts: DataFrame, key: str = "doc_id") -> DataFrame:
    """V3 with M14: adds ``min_chars``, which follows the transcript's tokens, and ``too_short`` against it."""
    least = transcripts.select(key, dynamic_min_chars(estimate_tokens(F.col("text"))).alias("min_chars"))
    joined = records.join(least, key, "left").withColumn("min_chars", F.coalesce("min_chars", F.lit(250).cast("long")))
    return length_gate(joined, F.col("min_chars"))


# Traces of a model's reasoning, and rubric phrases that it repeats.
MARKUP_LEAKS = [r"(?i)<(?:think|thought|details)\b", r"(?i)</(?:think|thought|details)>", r"<[/!]?[A-Za-z][^>]*>", "```"]
RUBRIC_LEAKS = [
    r"(?i)\bAnalysis of the Transcript\b",
    r"(?i)\bEvaluation Criteria\b",
    r"(?i)\bMeeting (?:Name|Time|Location)\s*[:：]",
    r"(?i)\bLet'?s\s+(?:infer|name|call|assume)\b",
    r"(?i)\bA suitable name\b",
    r"(?i)\bNot (?:explicitly )?stated\b",
    "評估標準",
    "法制合規性",
    "權責明確度",
    "意見真實性",
    r"\[請從文本中提取",
    r"\[請填寫",
]


def leakage_flags(records: DataFrame, text: str = "text") -> DataFrame:
    """V4: adds markup_leak, rubric_leak, foreign_line (a plain line of six Latin words or more and two CJK characters at most)."""
    body = F.coalesce(text, F.lit(""))
    any_hit = lambda patterns: reduce(lambda a, b: a | b, (body.rlike(p) for p in patterns))
    plain = lambda x: ~stripped(x).rlike(r"^[|\-*#>]") & (stripped(x) != "")
    foreign = F.exists(F.split(body, r"\r?\n"), lambda x: plain(x) & (counted(x, "[A-Za-z]+") >= 6) & (counted(x, CJK) <= 2))
    return records.withColumn("markup_leak", any_hit(MARKUP_LEAKS)).withColumn("rubric_leak", any_hit(RUBRIC_LEAKS)).withColumn("foreign_line", foreign)


# What a notes' table calls its first column, and how it says that there is no action.
ACTION_HEADERS = ["待辦事項", "事項說明"]
NO_ACTION = ["本次會議未明確指派待辦事項", "未於本段確認"]
LINE_END = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"


def table_actions(text: Column, headers: list[str] = ACTION_HEADERS, none: list[str] = NO_ACTION) -> Column:
    """The first cells of a text's table rows of three cells or more, in order: no header, rule or "none" rows."""
    rows = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), stripped), lambda x: x.rlike(r"^\|(?:[\s\S]*\|)?$") & ~x.contains(":---") & ~x.rlike(r"(?U)^\|\s*-+\s*(?:\|\s*-+\s*)+\|$"))
    cells = F.transform(rows, lambda x: F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"))
    firsts = F.transform(F.filter(cells, lambda c: F.size(c) >= 3), lambda c: stripped(F.get(c, F.lit(0))))
    skip = lambda f: f.isin(headers) | reduce(lambda a, x: a | f.contains(x), none, F.lit(False))
    return F.filter(firsts, lambda f: ~skip(f))


def note_actions(notes: DataFrame, key: str = "doc_id", headers: list[str] = ACTION_HEADERS, none: list[str] = NO_ACTION) -> DataFrame:
    """V5: (key, action) of the action tables in notes (key, text); what has no letters or digits is no action."""
    each = notes.select(key, F.explode(table_actions(F.col("text"), headers, none)).alias("action"))
    return each.where(action_key(F.col("action")) != "")


def action_recall(expected: DataFrame, records: DataFrame, key: str = "doc_id") -> DataFrame:
    """V5: per record how many expected actions (key, action) its text doesn't contain, compared without blanks and marks."""
    wanted = expected.select(key, action_key(F.col("action")).alias("wanted")).where("wanted <> ''").groupBy(key).agg(F.collect_set("wanted").alias("wanted"))
    joined = records.join(wanted, key, "left")
    lost = once(action_key(F.coalesce("text", F.lit(""))), lambda t: F.filter(F.coalesce("wanted", F.array().cast(NO_LABELS)), lambda w: ~F.contains(t, w)))
    return joined.select(key, F.coalesce(F.size("wanted"), F.lit(0)).alias("n_expected"), F.size(lost).alias("n_missing")).withColumn("n_expected", F.greatest("n_expected", F.lit(0)))


# Digits with their values, and how years are written.
CHINESE_DIGITS = {"〇": 0, "○": 0, "零": 0, "一": 1, "二": 2, "兩": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
ARABIC_YEAR = r"(?<!\d)(\d{2,4})\s*年(?!代)"
CHINESE_YEAR = r"([〇○零一二三四五六七八九十百兩]{2,4})\s*年(?!代)"


def chinese_number(token: Column) -> Column:
    """Digits read one by one, or with tens and hundreds, as text; null where that makes 0."""
    plain = F.translate(token, "".join(CHINESE_DIGITS), "".join(str(d) for d in CHINESE_DIGITS.values()))
    digits = F.split(plain, "")

    def step(acc: Column, c: Column) -> Column:
        unit = F.when(c == "十", 10).when(c == "百", 100)
        counted_ = F.struct((acc["total"] + F.greatest(acc["part"], F.lit(1)) * unit).alias("total"), F.lit(0).alias("part"))
        return F.when(unit.isNotNull(), counted_).otherwise(F.struct(acc["total"].alias("total"), F.coalesce(c.try_cast("int"), F.lit(0)).alias("part")))

    summed = F.aggregate(digits, F.struct(F.lit(0).alias("total"), F.lit(0).alias("part")), step, lambda a: a["total"] + a["part"])
    return F.when(plain.rlike(r"^\d+$"), plain).when(summed > 0, summed.cast("string"))


def year_tokens(text: Column, arabic: str = ARABIC_YEAR, chinese: str | None = CHINESE_YEAR) -> Column:
    found = F.regexp_extract_all(text, F.lit(arabic), 1)
    if chinese:
        found = F.concat(found, F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(chinese), 1), chinese_number)))
    return F.array_sort(F.array_distinct(found))


def ungrounded_years(records: DataFrame, transcripts: DataFrame, key: str = "doc_id", arabic: str = ARABIC_YEAR, chinese: str | None = CHINESE_YEAR) -> DataFrame:
    """V6: (key, year) of years in a record that its transcript doesn't have."""
    said = transcripts.select(key, year_tokens(F.col("text"), arabic, chinese).alias("said"))
    told = records.select(key, year_tokens(F.col("text"), arabic, chinese).alias("told")).where(F.size("told") > 0)
    joined = told.join(said, key, "left")
    return joined.select(key, F.explode(F.array_except("told", F.coalesce("said", F.array().cast(NO_LABELS)))).alias("year"))


# A source tag with a clock time, and the header lines where none is looked for.
SOURCE_TAG = r"（[^）]{0,24}?\d{1,2}:\d{2}(?::\d{2})?[^）]{0,12}?）"
HEADER_FIELD = r"^(?:時間|地點|主持人|出席人員|紀錄)[:：]"


def source_tag_presence(records: DataFrame, traced: list[str], tag: str = SOURCE_TAG, header: str = HEADER_FIELD) -> DataFrame:
    """V7: adds ``has_source_tag`` (outside header and table lines) and ``tag_missing`` for templates that need one."""
    lines = F.split(F.coalesce("text", F.lit("")), r"\r?\n")
    there = F.exists(lines, lambda x: ~x.contains("|") & ~stripped(x).rlike("(?U)" + header) & stripped(x).rlike(tag))
    out = records.withColumn("has_source_tag", there)
    return out.withColumn("tag_missing", F.coalesce(F.col("template_id").isin(*traced), F.lit(False)) & ~F.col("has_source_tag"))


def quality_evidence(records: DataFrame, notes: DataFrame | None = None, transcripts: DataFrame | None = None, arabic: str = ARABIC_YEAR, chinese: str | None = CHINESE_YEAR, headers: list[str] = ACTION_HEADERS, none: list[str] = NO_ACTION) -> DataFrame:
    """V8: records with what they are compared with: ``wanted`` (keys of their notes' actions) and ``said`` (years in their
    transcripts; null where there is no transcript). Notes and transcripts are read row by row, and what they give comes to the
    record in one shuffle. Records that share a doc_id all stay."""
    whole = F.struct(*[F.col(c) for c in records.columns if c != "doc_id"])
    kind = records.select(whole.alias("r")).schema["r"].dataType.simpleString()
    rows = records.select("doc_id", whole.alias("r"), F.lit(None).cast(NO_LABELS).alias("wanted"), F.lit(None).cast(NO_LABELS).alias("said"))
    if notes is not None:
        keys = F.filter(F.transform(table_actions(F.col("text"), headers, none), action_key), lambda k: k != "")
        rows = rows.unionByName(notes.select("doc_id", F.lit(None).cast(kind).alias("r"), F.array_distinct(keys).alias("wanted"), F.lit(None).cast(NO_LABELS).alias("said")))
    if transcripts is not None:
        rows = rows.unionByName(transcripts.select("doc_id", F.lit(None).cast(kind).alias("r"), F.lit(None).cast(NO_LABELS).alias("wanted"), year_tokens(F.coalesce("text", F.lit("")), arabic, chinese).alias("said")))
    met = rows.groupBy("doc_id").agg(F.collect_list("r").alias("r"), F.array_distinct(F.flatten(F.collect_list("wanted"))).alias("wanted"), F.count("said").alias("n"), F.array_distinct(F.flatten(F.collect_list("said"))).alias("said"))
    return met.select("doc_id", F.explode("r").alias("r"), "wanted", F.when(F.col("n") > 0, F.col("said")).alias("said")).select("doc_id", "r.*", "wanted", "said")


def issue_list(records: DataFrame, rules: DataFrame, minimum: Column | int = 250, drift: str | None = None, traced: list[str] = (), tag: str = SOURCE_TAG, header: str = HEADER_FIELD, arabic: str = ARABIC_YEAR, chinese: str | None = CHINESE_YEAR) -> DataFrame:
    """V8: adds ``issues``, a record's list in the order of the checks: V1 required and extra, V2, V3, drift, V4, V5, V7, V6.
    V5 and V6 look at ``wanted`` and ``said`` (``quality_evidence``) where they are; a record without a transcript has no V6."""
    rows = rule_rows(rules)
    flagged = source_tag_presence(leakage_flags(length_gate(records, minimum)), list(traced), tag, header)
    one = lambda cond, text: F.when(cond, F.array(F.lit(text) if isinstance(text, str) else text)).otherwise(F.array().cast(NO_LABELS))
    parts = [_labels(rows, ("required",), False, "missing: "), _labels(rows, ("extra",), False, "missing info: "), _labels(rows, ("forbidden",), True, "forbidden: "), one(F.col("too_short"), "too short")]
    if drift:
        parts.append(one(F.col("text").rlike(drift), "drift"))
    parts += [one(F.col("markup_leak"), "markup leak"), one(F.col("rubric_leak") | F.col("foreign_line"), "foreign or rubric text")]
    if "wanted" in records.columns:
        lost = once(action_key(F.coalesce("text", F.lit(""))), lambda t: F.size(F.filter("wanted", lambda w: ~F.contains(t, w))))
        flagged = flagged.withColumn("lost", lost)
        parts.append(one(F.col("lost") > 0, F.concat(F.lit("missing actions: "), F.col("lost").cast("string"))))
    parts.append(one(F.col("tag_missing"), "no source tag"))
    if "said" in records.columns:
        flagged = flagged.withColumn("made_up", F.array_except(year_tokens(F.coalesce("text", F.lit("")), arabic, chinese), "said"))
        parts.append(one(F.size("made_up") > 0, F.concat(F.lit("ungrounded years: "), F.array_join("made_up", ", "))))
    return flagged.select(*records.columns, F.concat(*parts).alias("issues"))


def quality_issues(records: DataFrame, rules: DataFrame, minimum: Column | int = 250, drift: str | None = None, **more: object) -> DataFrame:
    """V8: one row per issue: (doc_id, issue_no, issue) in the order of the checks; ``more`` as for ``issue_list``."""
    return issue_list(records, rules, minimum, drift, **more).select("doc_id", F.posexplode("issues").alias("issue_no", "issue"))


def normalised_markdown(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), "[　 ]", " ")
    for p in (r"(?m)^[ \t]*>[ \t]?", r"(?m)^[ \t]*#{1,6}[ \t]*", r"(?m)^[ \t]*[-*•][ \t]+"):
        out = F.regexp_replace(out, p, "")
    return F.regexp_replace(out, r"\*\*|__", "")


def resolve_template(records: DataFrame, templates: list[tuple[str, str]], default: str) -> DataFrame:
    """V9: adds ``template_id``: the first (id, title) with a line that begins with the title, else the longest title that
    the text contains, else the default. Templates in registry order; a bounded list."""
    text = normalised_markdown(F.coalesce("text", F.lit("")))
    line = lambda title: F.exists(F.split(text, "\n"), lambda x: F.startswith(stripped(x), F.lit(title)))
    by_line = [F.when(line(title), F.lit(i)) for i, title in templates if title]
    longest = sorted((t for t in templates if t[1]), key=lambda t: -len(t[1]))
    inside = [F.when(F.contains(text, F.lit(title)), F.lit(i)) for i, title in longest]
    return records.withColumn("template_id", F.coalesce(*by_line, *inside, F.lit(default)))


def section_windows(records: DataFrame, heading: str, boundary: str, cap: int = 1200, body: str = CJK_BODY) -> DataFrame:
    """Per record the sections that begin after a heading line, up to the next boundary line or ``cap`` characters:
    how many, and the most body characters in one."""
    lines = records.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    mark = F.when(F.col("line").rlike(heading), 1).when(F.col("line").rlike(boundary), 0)
    order = W.partitionBy("doc_id").orderBy("line_no")
    marked = lines.withColumn("mark", mark).withColumn("section", F.count("mark").over(order)).withColumn("open", F.last("mark", ignorenulls=True).over(order))
    rest = F.when(F.col("mark") == 1, F.regexp_replace("line", f"^.*?(?:{heading})", "")).otherwise(F.col("line"))
    windows = marked.where("open = 1").groupBy("doc_id", "section").agg(F.substring(in_order("line_no", rest, "\n"), 1, cap).alias("window"))
    return windows.groupBy("doc_id").agg(F.count("*").alias("n_windows"), F.max(counted(F.col("window"), body)).alias("most_body"))


# Acceptance limits and markers.
LIMITS = {"body": 600, "decision": 20, "meaningful": 100, "section": 10, "action": 2, "action_table": 10, "ratio": 0.5, "paragraphs": 15}
FALLBACK_MARKERS = ["StableServiceError", "Traceback", "summary_failed", "⚠️"]
ACTION_WORDS = ["待辦事項", "辦理事項", "預定事項"]
DECISION = r"決議(?:事項)?\s*[:：]"


def acceptance_checks(artifacts: DataFrame, rules: DataFrame, titles: dict[str, str], boundary: str = r"^[一二三四五六七八九十]+、", limits: dict | None = None, body: str = CJK_BODY, latin: str = "[A-Za-z]", markers: list[str] | None = None, actions: list[str] | None = None, decision: str = DECISION, name_field: str = r"(?m)^\s*會議名稱\s*[:：]") -> DataFrame:
    """(doc_id, check_id, status, detail) for artifacts (doc_id, kind, template_id, text, paragraphs, tables).

    A check that doesn't apply to the artifact's kind is SKIP. detail holds the measured value.
    """
    rows, limits = rule_rows(rules), LIMITS | (limits or {})
    text = F.coalesce("text", F.lit(""))
    n = lambda t: chars_of(t, body)
    # All windows of a text; a window ends at a boundary line, at the next heading, or after 1200 characters.
    windows = lambda p: F.transform(once(F.split(text, p), lambda parts: F.slice(parts, F.lit(2), F.size(parts))), lambda w: F.substring(F.regexp_extract(w, f"(?s)^(.*?)(?:(?m:{boundary})|\\z)", 1), 1, 1200))
    most = lambda p: F.coalesce(F.array_max(F.transform(windows(p), lambda w: n(w))), F.lit(0))
    plain = F.regexp_replace(text, "[（(]待確認[）)]", "")
    title = reduce(lambda a, kv: F.when(F.col("template_id") == kv[0], F.lit(kv[1])).otherwise(a), titles.items(), F.lit(None).cast("string"))
    starts = F.exists(F.split(normalised_markdown(text), "\n"), lambda x: F.startswith(stripped(x), title))
    lines = F.split(text, r"\r?\n")
    words = "|".join(ACTION_WORDS if actions is None else actions)
    labels = "|".join(r["pattern"] for r in rows if r["kind"] == "extra")
    acts_of = F.exists(lines, lambda x: x.rlike(f"{words}|{labels}" if labels else words) & ~x.rlike(r"^\s*\|.*\|\s*$") & (n(F.regexp_replace(x, f"^.*?(?:{words}{'|' + labels if labels else ''})", "")) >= limits["action"]))
    table_acts = F.exists(lines, lambda x: x.rlike(r"^\s*\|.*\|\s*$") & ~x.rlike(r"^\s*\|[\s:|-]+\|\s*$") & (n(x) >= limits["action_table"]))
    # What several checks use is a column first, so it is computed once.
    measured = artifacts.select("*", n(text).alias("cjk"), (chars_of(text, latin) + chars_of(text, "[0-9]")).alias("other"), most(decision).alias("decided"), n(plain).alias("meaningful"), F.coalesce(starts, F.lit(False)).alias("titled"), F.size(_labels(rows, ("required", "extra"), False)).alias("missing"), acts_of.alias("acts"))
    cjk, other, decided, meaningful, titled, missing, acts = (F.col(c) for c in ("cjk", "other", "decided", "meaningful", "titled", "missing", "acts"))
    ratio = F.round(F.coalesce(F.try_divide(cjk.cast("double"), (cjk + other).cast("double")), F.lit(0.0)), 6)
    required = [r for r in rows if r["kind"] == "required"]
    real = reduce(lambda a, r: a | ((F.col("template_id") == r["template_id"]) & (most(r["pattern"]) >= limits["section"])), required, F.lit(False))
    fallback = reduce(lambda a, m: a | text.contains(m), FALLBACK_MARKERS if markers is None else markers, F.lit(False))
    verdict = lambda ok: F.when(ok, "PASS").otherwise("FAIL")
    checks = [
        ("not_fallback", verdict(~fallback), fallback.cast("string")),
        ("formal_title", verdict(titled | text.rlike(name_field)), titled.cast("string")),
        ("required_sections", verdict(missing == 0), missing.cast("string")),
        ("has_decisions", verdict(decided >= limits["decision"]), decided.cast("string")),
        ("has_action_items", verdict(acts | table_acts), acts.cast("string")),
        ("min_length", verdict(cjk >= limits["body"]), cjk.cast("string")),
        ("no_placeholder", verdict(~text.rlike("TODO|XXX") & (meaningful >= limits["meaningful"]) & real), meaningful.cast("string")),
        ("structure_nonempty", F.when(F.col("kind") != "docx", "SKIP").otherwise(verdict((F.col("paragraphs") >= limits["paragraphs"]) & (F.col("tables") >= F.col("needs_tables")))), F.col("paragraphs").cast("string")),
        ("cjk_ratio", verdict(ratio >= limits["ratio"]), ratio.cast("string")),
    ]
    made = F.array(*[F.struct(F.lit(i).alias("check_id"), s.alias("status"), d.alias("detail")) for i, s, d in checks])
    return measured.select("doc_id", F.explode(made).alias("c")).select("doc_id", "c.*")


def verdict(checks: DataFrame) -> DataFrame:
    """Any FAIL rejects; SKIP counts for neither."""
    return checks.groupBy("doc_id").agg(F.when(F.bool_or(F.col("status") == "FAIL"), "REJECTED").otherwise("ACCEPTED").alias("verdict"), F.count_if(F.col("status") == "FAIL").alias("n_failed"))


def metrics_gate(metrics: DataFrame, log_lines: DataFrame, markers: list[str] = ("Traceback", "ERROR"), max_rounds: int = 3) -> DataFrame:
    """Metrics (run, metrics map), log_lines (run, line): per run whether keys are there, logical calls above 0,
    attempts at most twice those, rounds at most three, and no forbidden marker in its log."""
    m = F.col("metrics")
    keys = reduce(lambda a, k: a & F.map_contains_key(m, k), ("logical", "attempts", "rounds"), F.lit(True))
    ok = keys & (m["logical"] > 0) & (m["attempts"] <= 2 * m["logical"]) & (m["rounds"] <= max_rounds)
    judged = metrics.groupBy("run").agg(F.count("*").alias("n_lines"), F.bool_and(F.coalesce(ok, F.lit(False))).alias("metrics_ok"))
    bad = reduce(lambda a, x: a | F.col("line").contains(x), markers, F.lit(False))
    marked = log_lines.groupBy("run").agg(F.count_if(bad).alias("n_markers"))
    joined = judged.join(marked, "run", "full")
    return joined.select("run", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), (F.coalesce("metrics_ok", F.lit(False)) & (F.coalesce("n_markers", F.lit(0)) == 0)).alias("ok"))


def snapshot_diff(start: DataFrame, end: DataFrame) -> DataFrame:
    """One row: rows gone, rows new, and whether the snapshots are equal."""
    columns = start.columns
    both = start.select(*columns, F.lit(1).alias("side")).unionByName(end.select(*columns, F.lit(-1).alias("side"))).groupBy(*columns).agg(F.sum("side").alias("n"))
    return both.agg(F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).alias("gone"), F.coalesce(F.sum(F.greatest(-F.col("n"), F.lit(0))), F.lit(0)).alias("new")).withColumn("same", (F.col("gone") == 0) & (F.col("new") == 0))


def unique_mapping(uploads: DataFrame) -> DataFrame:
    """Per run how many upload mappings there are; ok only with exactly one."""
    return uploads.groupBy("run").agg(F.count("*").alias("n")).withColumn("ok", F.col("n") == 1)


def terminal_state_gate(tasks: DataFrame) -> DataFrame:
    """Adds ``ok``: completed, and summary_failed is false and not merely unknown."""
    return tasks.withColumn("ok", (F.coalesce(F.col("status") == "completed", F.lit(False))) & F.col("summary_failed").eqNullSafe(False))


def legacy_summary_valid(summaries: DataFrame, marks: str = r"(?m)^\s*(?:#|[-*] |\d+\.)", errors: tuple[str, ...] = ("error", "failed")) -> DataFrame:
    """Long enough, structured, without an error word, and foreign by at most a tenth."""
    text = F.coalesce("text", F.lit(""))
    words, cjk = counted(text, r"\b[A-Za-z]+\b"), counted(text, CJK)
    ratio = F.coalesce(F.try_divide(words.cast("double"), (words + cjk).cast("double")), F.lit(0.0))
    wrong = reduce(lambda a, e: a | F.lower(text).contains(e), errors, F.lit(False))
    return summaries.select("doc_id", (F.length(text) >= 100).alias("long_enough"), text.rlike(marks).alias("structured"), wrong.alias("has_error"), (ratio <= 0.1).alias("native_words")).withColumn("valid", F.col("long_enough") & F.col("structured") & ~F.col("has_error") & F.col("native_words"))


def extract_md_tables(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, table_no, row_no, cells) of runs of pipe-delimited lines, rule lines left out."""
    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    w = W.partitionBy(key).orderBy("line_no")
    in_table = F.col("line").rlike(r"^\s*\|.*\|\s*$")
    rows = lines.withColumn("t", in_table).where("t").withColumn("new", (F.coalesce(F.lag("line_no").over(w), F.lit(-2)) != F.col("line_no") - 1).cast("int")).withColumn("table_no", F.sum("new").over(w).cast("int"))
    rows = rows.where(~F.col("line").rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    cells = F.transform(F.split(F.regexp_replace(stripped(F.col("line")), r"^\||\|$", ""), r"\|"), lambda c: stripped(c))
    return rows.select(key, "table_no", F.row_number().over(W.partitionBy(key, "table_no").orderBy("line_no")).alias("row_no"), cells.alias("cells"))


TRACKING_HEADER = "| 案由及承辦單位 | 辦理情形 | 解除列管 | 繼續列管 |"
TRACKING_RULE = "| --- | --- | --- | --- |"


def tracking_tables(records: DataFrame, previous: str = "歷次.{0,14}列管案件", summary: str = "決議事項辦理情形彙整表", label: str = r"^決議事項\s*[:：]\s*$") -> DataFrame:
    """(doc_id, previous, summary): the two follow-up tables as text.

    After the first heading line: a value on the line makes a table of one row; else the table that follows at once (blank
    lines, and for the second the label line, may stand between); else a skeleton to confirm.
    """
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    one = lambda v: F.concat(F.lit(f"{TRACKING_HEADER}\n{TRACKING_RULE}\n| "), v, F.lit(" |  |  |  |"))

    def after(ls: Column, at: Column, skip: Column) -> Column:
        rest = F.filter(ls, lambda y: y["i"] > at)
        first = F.array_min(F.transform(F.filter(rest, lambda y: (stripped(y["x"]) != "") & ~skip_line(y["x"], skip)), lambda y: y["i"]))
        stop = F.array_min(F.transform(F.filter(rest, lambda y: (y["i"] >= first) & ~F.startswith(stripped(y["x"]), F.lit("|"))), lambda y: y["i"]))
        table = F.filter(rest, lambda y: (y["i"] >= first) & (stop.isNull() | (y["i"] < stop)))
        return F.nullif(F.array_join(F.transform(table, lambda y: stripped(y["x"])), "\n"), F.lit(""))

    def skip_line(x: Column, skip: Column) -> Column:
        return skip & stripped(x).rlike("(?U)" + label)

    out = records.select("doc_id", lines.alias("ls"))
    head = lambda p: F.get(F.filter("ls", lambda y: y["x"].rlike(p)), F.lit(0))
    out = out.withColumn("p", head(previous)).withColumn("s", head(summary))
    inline = F.nullif(stripped(F.regexp_extract("p.x", r"^[^:：]*[:：]([\s\S]*)$", 1)), F.lit(""))
    first = F.coalesce(F.when(inline.isNotNull(), one(inline)), after(F.col("ls"), F.col("p.i"), F.lit(False)), one(F.lit(CONFIRM)))
    skeleton = F.lit(f"{TRACKING_HEADER}\n{TRACKING_RULE}\n| {CONFIRM} | {CONFIRM}： |  |  |")
    return out.select("doc_id", first.alias("previous"), F.coalesce(after(F.col("ls"), F.col("s.i"), F.lit(True)), skeleton).alias("summary"))


def extract_form_fields(records: DataFrame, fields: list[tuple[str, str, bool]], terminator: str = r"^(?:## |</?details)|^(?:---|\*\*\*|___)$", missing: str = CONFIRM) -> DataFrame:
    """(doc_id, field, value) for every record and field; fields (name, label alternatives, on the label's line only).

    The first value that isn't empty wins. A block goes on to the next label line or the terminator, where scanning ends.
    """
    lines = records.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw")).withColumn("line", stripped(F.col("raw")))
    order = W.partitionBy("doc_id").orderBy("line_no")
    lines = lines.where("NOT startswith(line, '# ')").withColumn("ended", F.max(F.col("line").rlike(terminator)).over(order)).where("NOT ended")
    label = F.coalesce(*[F.when(F.col("line").rlike(rf"(?U)^(?:{alternatives})\s*[:：]"), F.lit(name)) for name, alternatives, _ in fields])
    everything = "|".join(a for _, a, _ in fields)
    rest = stripped(F.regexp_replace("line", rf"(?U)^(?:{everything})\s*[:：]", ""))
    marked = lines.withColumn("label", label).withColumn("block", F.count("label").over(order)).withColumn("field", F.last("label", ignorenulls=True).over(order)).where("field IS NOT NULL")
    marked = marked.withColumn("part", F.when(F.col("label").isNotNull(), rest).otherwise(F.col("line")))
    inline = [n for n, _, alone in fields if alone]
    kept = marked.where(F.col("label").isNotNull() | ~F.col("field").isin(*inline))
    blocks = kept.groupBy("doc_id", "field", "block").agg(F.regexp_replace(in_order("line_no", "part", "\n"), r"^\n+|\n+$", "").alias("value")).where("value <> ''")
    firsts = blocks.groupBy("doc_id", "field").agg(F.min_by("value", "block").alias("value"))
    wanted = records.select("doc_id", F.explode(F.array(*[F.lit(n) for n, _, _ in fields])).alias("field"))
    return wanted.join(firsts, ["doc_id", "field"], "left").select("doc_id", "field", F.coalesce("value", F.lit(missing)).alias("value"))


def classify_lines(docs: DataFrame, section: str = r"^[一二三四五六七八九十壹貳參肆伍陸柒捌玖拾]+、", label: str = r"^([^\s:：|#>*\-]{1,12})\s*[:：]\s*(.*)$") -> DataFrame:
    """(doc_id, line_no, kind, level, label, value) of lines that aren't blank; kinds in order of precedence."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("s", stripped(F.col("line"))).where("s <> ''")
    s = F.col("s")
    kind = (
        F.when(s.rlike("^#{1,6} "), "heading")
        .when(s.rlike(r"^\|[\s:|-]+\|$"), "table_rule")
        .when(s.rlike(r"^\|.*\|$"), "table")
        .when(s.rlike(r"^(?:-{3,}|\*{3,}|_{3,})$"), "rule")
        .when(s.startswith(">"), "quote")
        .when(s.rlike(r"^(?:[-*+]|\d+[.)]) "), "list")
        .when(s.rlike(section), "section")
        .when(s.rlike(label), "label")
        .otherwise("paragraph")
    )
    indent = F.length(F.regexp_extract("line", r"^( *)", 1))
    level = F.when(kind == "heading", F.length(F.regexp_extract("s", "^(#{1,6}) ", 1))).when(kind == "list", F.floor(indent / 2) + 1).otherwise(0).cast("int")
    of_label = lambda i: F.when(kind == "label", F.regexp_extract("s", label, i)).otherwise("")
    return lines.select("doc_id", "line_no", kind.alias("kind"), level.alias("level"), of_label(1).alias("label"), of_label(2).alias("value"))


def bold_spans(docs: DataFrame) -> DataFrame:
    """E5: (doc_id, line_no, span) of **x** spans."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(r"\*\*([^*]+)\*\*"), 1)).alias("span"))
