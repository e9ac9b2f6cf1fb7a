"""Cleaning of transcripts and records. Every job is an expression over a row's text: no shuffle, whatever the corpus.
Collapsing loops (C2) is the one that Arrow batches go through; the others are built-in functions.

Patterns and vocabularies are parameters (rule tables of bounded size); the defaults are those of Chinese meeting records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import loops
from parley.functions.text import CJK, CONFIRM, chars_of, counted, once

# Characters that exist in simplified Chinese only.
SIMPLIFIED = "为会体们动办务发号启实对开当录总应数术样气没点产监类统网规让议话这进项华质关证长门问间东车贝见页风飞马鸟龙齐语说读写学习经济级红结组织给继续记报确认单资讯电脑络软设备预处调审决书简称属"
# Phrases that speech models add from subtitles.
BOILERPLATE = [
    r"請[訂订]閱[^\n。]*",
    r"[謝谢]{1,2}[謝谢]?觀看[^\n。]*",
    r"感謝(?:您的)?[收觀]看[^\n。]*",
    r"字幕[由提供製作志愿者]{0,4}[^\n。]{0,20}(?:提供|製作|字幕組|社[群区]|Amara\.org)[^\n。]*",
    r"(?:by\s+)?Amara\.org[^\n]*",
    r"明天(?:見|再見)[!！]?\s*$",
    r"訂閱[、,，]?按讚[、,，]?開啟小鈴鐺[^\n。]*",
]
# Official terms that are always wrong as written.
TERM_FIXES = [("會議紀錄表", "會議紀錄"), ("薦任官", "薦任"), ("筒任", "簡任"), ("函辦(?=[^㐀-鿿]|$)", "函頒"), ("呈核(?=無誤)", "陳核")]
# English words that records don't keep.
VOCABULARY = [
    (r"\bOkay\b", "好"),
    (r"\bokay\b", "好"),
    (r"\bSure\b", "好"),
    (r"\bsure\b", "好"),
    (r"\bRecap\b", "總結"),
    (r"\brecap\b", "總結"),
    (r"\bExecutive Summary\b", "執行摘要"),
    (r"\bDiscussion & Decisions\b", "詳細議題與決議"),
    (r"\bAction Items\b", "待辦事項"),
    (r"\bStand\s*by\b", "待命"),
    (r"\bstand\s*by\b", "待命"),
    (r"\$\s*\\rightarrow\s*\$", "→"),
    (r"\\rightarrow", "→"),
]
# How an English preamble begins; skeleton tokens; the lines where they are mended.
PREAMBLE = r"(?i)^(?:Analysis of the Transcript|Evaluation Criteria|Let'?s\b|Here'?s\b|Below is\b|Okay[,，]?\s*(?:let|here)|Sure[,，]?\b)"
UNFILLED = r"[（(](?:機關及科別|機關科別|民國年|年|月|日|星期|時分|次)[）)]"
FIELD_LINES = [r"^(?:時間|地點|主持人|出席人員|紀\s*錄|散會)\s*[:：]", r"(?:紀錄|彙整表)\s*$"]

SENTENCE_END = r"(?<=[。！？!?\n])"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def has_any(text: Column, characters: str) -> Column:
    """Whether one of many characters occurs: one lookup a character, where a class of a pattern tries them in turn."""
    return F.translate(text, characters, "") != text


def drift_counts(docs: DataFrame, characters: str = SIMPLIFIED) -> DataFrame:
    """Adds lines with a drift character and how many such characters there are."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: has_any(x, characters))
    return docs.withColumn("drift_lines", F.size(lines)).withColumn("drift_chars", F.coalesce(F.length("text") - F.length(F.translate("text", characters, "")), F.lit(0)))


def variant_normalised(text: Column, mapping: dict[str, str], characters: str = SIMPLIFIED) -> Column:
    """Characters of ``mapping`` are replaced in the lines that drift, and only there."""
    old, new = "".join(mapping), "".join(mapping.values())
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(has_any(x, characters), F.translate(x, old, new)).otherwise(x)), "\n")


def language_mix(docs: DataFrame) -> DataFrame:
    """Characters of CJK, Latin and digits with their shares, and whether words are foreign beyond 0.25, 0.15, 0.10."""
    plain = F.regexp_replace("text", r"[#|>*`\-]+", " ")
    words = counted(plain, r"\b[a-zA-Z][A-Za-z0-9_/-]*\b")
    cjk = chars_of(plain, CJK)
    ratio = F.coalesce(F.try_divide(words.cast("double"), (words + cjk).cast("double")), F.lit(0.0))
    latin, digits, body = chars_of(F.col("text"), "[A-Za-z]"), chars_of(F.col("text"), "[0-9]"), chars_of(F.col("text"), CJK)
    share = F.coalesce(F.try_divide(body.cast("double"), (body + latin + digits).cast("double")), F.lit(0.0))
    return docs.select("doc_id", body.alias("cjk_chars"), latin.alias("latin_chars"), digits.alias("digit_chars"), F.round(share, 6).alias("cjk_share"), F.round(ratio, 6).alias("foreign_ratio"), (ratio > 0.25).alias("excess"), (ratio > 0.15).alias("above_15"), (ratio > 0.10).alias("above_10"))


def remove_boilerplate(docs: DataFrame, patterns: list[str] | None = None, ignore_case: bool = True) -> DataFrame:
    """Spans of the patterns go, one pattern after the other; adds ``boilerplate_removed``. Blanks are squeezed only
    where something went."""
    flag = "(?iu)" if ignore_case else ""
    out = docs.withColumn("boilerplate_removed", F.lit(0))
    for p in BOILERPLATE if patterns is None else patterns:
        out = out.withColumn("boilerplate_removed", F.col("boilerplate_removed") + counted(F.col("text"), flag + p)).withColumn("text", F.regexp_replace("text", flag + p, ""))
    squeezed = F.regexp_replace(F.regexp_replace("text", r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    return out.withColumn("text", stripped(F.when(F.col("boilerplate_removed") > 0, squeezed).otherwise(F.col("text"))))


def collapse_loops(docs: DataFrame) -> DataFrame:
    """One character eight times or more, or 2-20 characters four times or more, with light separators at most, become
    two, with the first separator; adds ``loops_collapsed``. Single characters go first. A null text stays null."""
    out = docs.withColumn("loops", loops.collapsed("text"))
    return out.withColumn("text", F.col("loops.text")).withColumn("loops_collapsed", F.col("loops.n")).drop("loops")


def dedup_consecutive_sentences(docs: DataFrame, min_len: int = 4, ends: str = SENTENCE_END) -> DataFrame:
    """A sentence equal, trimmed, to the one before goes; adds ``dedup_removed``."""
    same = lambda parts, x, i: (i > 0) & (F.length(stripped(x)) >= min_len) & (stripped(x) == stripped(F.get(parts, i - 1)))
    kept = lambda parts: F.struct(F.filter(parts, lambda x, i: ~F.coalesce(same(parts, x, i), F.lit(False))).alias("kept"), F.size(parts).alias("n"))
    out = docs.withColumn("cut", once(F.split("text", ends), kept))
    return out.withColumn("text", F.array_join("cut.kept", "")).withColumn("dedup_removed", F.col("cut.n") - F.size("cut.kept")).drop("cut")


def apply_term_fixes(docs: DataFrame, fixes: list[tuple[str, str]] | None = None) -> DataFrame:
    """C4: replacements in order; adds ``term_fixes``, the patterns that fired."""
    out = docs.withColumn("term_fixes", F.array().cast("array<string>"))
    for pattern, new in TERM_FIXES if fixes is None else fixes:
        fired = F.when(F.col("text").rlike(pattern), F.array(F.lit(pattern))).otherwise(F.array().cast("array<string>"))
        out = out.withColumn("term_fixes", F.concat("term_fixes", fired)).withColumn("text", F.regexp_replace("text", pattern, new))
    return out


def clean_corpus(docs: DataFrame, mapping: dict[str, str] | None = None, patterns: list[str] | None = None, fixes: list[tuple[str, str]] | None = None) -> DataFrame:
    """P7, C1, C2, C3, C4 in this order, with their counters as columns."""
    before = F.col("text")
    out = docs.withColumn("text", variant_normalised(before, mapping)) if mapping else docs
    out = out.withColumn("normalised", F.lit(False) if not mapping else has_any(F.col("text"), "".join(mapping.values())))
    return apply_term_fixes(dedup_consecutive_sentences(collapse_loops(remove_boilerplate(out, patterns))), fixes)


def drop_foreign_lines(docs: DataFrame, protected: list[str] = (), preamble: str = PREAMBLE) -> DataFrame:
    """Preamble lines, and lines that begin with a Latin letter and are foreign by more than half with under four CJK
    characters, go; markup lines, lines to confirm, and lines with a protected term stay. Adds ``lines_dropped``."""

    def foreign(line: Column) -> Column:
        start = F.ltrim(line)
        kept = line.contains(CONFIRM) | (stripped(line) == "") | start.rlike(r"^[#*|\->]")
        shielded = F.lit(False)
        for term in protected:
            shielded |= line.contains(term)
        words, total = counted(line, r"\b[a-zA-Z]+\b"), F.size(F.filter(F.split(line, r"\s+"), lambda w: w != ""))
        heavy = start.rlike("^[A-Za-z]") & ~shielded & (words > 0.5 * total) & (counted(line, CJK) < 4)
        return ~kept & (start.rlike(preamble) | heavy)

    lines = F.split("text", "\n")
    out = docs.withColumn("cut", once(lines, lambda ls: F.struct(F.filter(ls, lambda x: ~foreign(x)).alias("kept"), F.size(ls).alias("n"))))
    return out.withColumn("text", F.array_join("cut.kept", "\n")).withColumn("lines_dropped", F.col("cut.n") - F.size("cut.kept")).drop("cut")


def replace_vocabulary(docs: DataFrame, vocabulary: list[tuple[str, str]] | None = None) -> DataFrame:
    """C7."""
    text = F.col("text")
    for pattern, new in VOCABULARY if vocabulary is None else vocabulary:
        text = F.regexp_replace(text, pattern, new)
    return docs.withColumn("text", text)


def repair_placeholders(docs: DataFrame, token: str = UNFILLED, lines: list[str] | None = None, mark: str = CONFIRM) -> DataFrame:
    """Skeleton tokens become the mark, on header and title lines only; adjacent marks become one."""
    which = FIELD_LINES if lines is None else lines

    def mended(line: Column) -> Column:
        here = F.lit(False)
        for p in which:
            here |= stripped(line).rlike("(?U)" + p)
        fixed = F.regexp_replace(F.regexp_replace(line, token, mark), rf"(?:\Q{mark}\E){{2,}}", mark)
        return F.when(here & line.rlike(token), fixed).otherwise(line)

    return docs.withColumn("text", F.array_join(F.transform(F.split("text", "\n"), mended), "\n"))


# What models put around a record, in the order in which it goes.
WRAPPERS = [
    r"<(?:think|thought|details)\b[^>]*>(?s:.*?)</(?:think|thought|details)>",
    r"^\s*</?(?:think|thought|details)[^>]*>\s*$",
    r"^```(?:markdown)?\s*",
    r"^好的[，,]?\s*我[來来][整幫]理.*?[：:。\n]",
    r"^以下是.*?會議記錄[：:。\n]",
    r"^以下是.*?整理結果[：:。\n]",
    r"^我[來来]為[您你]整理.*?[：:。\n]",
    r"^根據逐字稿[，,]?\s*",
    r"^OK[,，]?\s*",
    r"^Sure[,，]?\s*",
]
# What goes once the text is trimmed, and the line at which a record begins.
CLOSING = [r"\n?```$", r"</?(?:think|thought|details)[^>]*>"]
ANCHORS = r"^會議名稱[：:]|^#\s"
#: Letters of any case, lines that end at \n alone, white space of any script.
LINES_OF = "(?imdU)"


def strip_wrappers(docs: DataFrame, wrappers: list[str] | None = None, anchors: str = ANCHORS) -> DataFrame:
    """Thought tags, fences and chatty openings go, and what stands before the first anchor line; adds ``stripped``."""
    text = stripped(F.coalesce("text", F.lit("")))
    for p in WRAPPERS if wrappers is None else wrappers:
        text = F.regexp_replace(text, LINES_OF + p, "")
    text = stripped(F.regexp_replace(text, r"(?iU)^\s*```(?:markdown)?\s*", ""))
    for p in CLOSING:
        text = F.regexp_replace(text, LINES_OF + p, "")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")

    def cut(t: Column) -> Column:
        at = F.regexp_instr(t, F.lit("(?mdU)" + anchors))
        return stripped(F.when(at > 1, F.substr(t, at.cast("int"))).otherwise(t))

    return docs.withColumn("cut", once(text, cut)).withColumn("stripped", F.length("text") - F.length("cut")).withColumn("text", F.col("cut")).drop("cut")


# Characters of CJK texts that stand without blanks, and full-width marks (the blank U+3000 isn't one).
CJK_TEXT = r"\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
CJK_MARK = r"\u2014\u2018\u2019\u201c\u201d\u2026\u3001-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65"


def cjk_spaced(text: Column) -> Column:
    """Blanks become one; none between CJK characters or beside full-width marks."""
    one = F.regexp_replace(text, r"(?U)\s+", " ")
    between = F.regexp_replace(one, f"(?<=[{CJK_TEXT}]) (?=[{CJK_TEXT}])", "")
    return F.trim(F.regexp_replace(between, f" (?=[{CJK_MARK}])|(?<=[{CJK_MARK}]) ", ""))


def ensure_structure(docs: DataFrame, headers: list[tuple[str, str]], sections: list[tuple[str, list[str], list[tuple[str, list[str]]]]]) -> DataFrame:
    """C11: missing header lines go before, missing sections or their missing subfields after, in order of the rules.

    headers (line, pattern); sections (pattern, lines, subfields (pattern, lines)). A fence around the text goes, and blank
    lines become one.
    """
    text = stripped(F.coalesce("text", F.lit("")))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?i)^```(?:markdown)?\s*", ""), r"\n?```$", ""), r"\n{3,}", "\n\n")
    out = docs.withColumn("text", text)
    missing = lambda pattern, lines: F.when(~F.col("text").rlike("(?U)" + pattern), F.array(*[F.lit(x) for x in lines])).otherwise(F.array().cast("array<string>"))
    nothing = F.array().cast("array<string>")
    head = F.concat(nothing, *[missing(f"(?m){p}", [line]) for line, p in headers])
    tail = F.concat(nothing, *[F.when(~F.col("text").rlike("(?U)" + p), F.array(*[F.lit(x) for x in lines])).otherwise(F.concat(nothing, *[missing(q, more) for q, more in subfields])) for p, lines, subfields in sections])
    out = out.withColumn("head", F.array_join(head, "\n")).withColumn("tail", F.array_join(tail, "\n"))
    parts = F.filter(F.array("head", "text", "tail"), lambda x: x != "")
    return out.withColumn("text", stripped(F.array_join(parts, "\n\n"))).drop("head", "tail")


def finalise_records(docs: DataFrame, headers: list, sections: list, protected: list[str] = (), mapping: dict[str, str] | None = None, vocabulary: list[tuple[str, str]] | None = None) -> DataFrame:
    """C6, C7, P7, the P8 flag (``excess``), C11."""
    out = replace_vocabulary(drop_foreign_lines(docs, protected), vocabulary)
    if mapping:
        out = out.withColumn("text", variant_normalised(F.col("text"), mapping))
    plain = F.regexp_replace("text", r"[#|>*`\-]+", " ")
    words, cjk = counted(plain, r"\b[a-zA-Z][A-Za-z0-9_/-]*\b"), counted(plain, CJK)
    return ensure_structure(out.withColumn("excess", words > 0.25 * (words + cjk)), headers, sections)
