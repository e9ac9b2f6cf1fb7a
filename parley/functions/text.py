"""Column helpers from Spark built-ins: token estimates, clock texts, spacing, names, signatures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character classes for counting: CJK in cleaning and token estimates, and the narrower one of acceptance checks.
CJK = "[㐀-鿿]"
CJK_BODY = "[㐀-䶿一-鿿豈-﫿]"
LATIN_TOKEN = r"[A-Za-z0-9_]+(?:[-/:.][A-Za-z0-9_]+)*"
CONFIRM = "（待確認）"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def counted(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def chars_of(text: Column, characters: str) -> Column:
    """How many characters of a class there are: what is left without the runs between them, which are fewer."""
    return F.length(F.regexp_replace(text, f"[^{characters[1:-1]}]+", ""))


def estimate_tokens(text: Column) -> Column:
    """max(1, CJK characters + 1.2 per Latin word + a quarter of the rest); 0 for a null or empty text."""

    def of_marked(m: Column) -> Column:
        words = F.length(m) - F.length(F.translate(m, "\x00", ""))
        cjk = F.length(m) - F.length(F.regexp_replace(m, CJK, ""))
        return cjk + F.floor(words * 12 / 10) + F.floor((F.length(m) - words - cjk) / 4)

    # One pass over the text: each Latin word becomes one character, and the rest is short.
    total = once(F.regexp_replace(F.translate(text, "\x00", " "), LATIN_TOKEN, "\x00"), of_marked)
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(F.greatest(F.lit(1), total)).cast("long")


def estimate_tokens_sql(c: str) -> str:
    """The same in DuckDB, for texts without CJK characters or with them."""
    rest = f"length(regexp_replace(regexp_replace({c}, '{LATIN_TOKEN}', '', 'g'), '[㐀-鿿]', '', 'g'))"
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN 0 ELSE greatest(1, len(regexp_extract_all({c}, '[㐀-鿿]')) + (len(regexp_extract_all({c}, '{LATIN_TOKEN}')) * 12) // 10 + {rest} // 4) END"


def dynamic_min_chars(tokens: Column, low: int = 250, high: int = 2000) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.floor(tokens / 15))).cast("long")


def clock(ms: Column) -> Column:
    """HH:MM:SS of milliseconds, rounded down; negative counts as 0."""
    s = F.floor(F.greatest(F.lit(0), ms) / 1000).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(s / 3600).cast("long")
    return F.concat(F.when(hours > 99, hours.cast("string")).otherwise(two(hours)), F.lit(":"), two(F.floor(s % 3600 / 60).cast("long")), F.lit(":"), two(s % 60))


def clock_sql(ms: str) -> str:
    s = f"(greatest(0, {ms}) // 1000)"
    return f"(lpad(CAST({s} // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST({s} % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({s} % 60 AS VARCHAR), 2, '0'))"


def gap_between(left_tail: Column, right_head: Column) -> Column:
    """The space that joins two pieces: between Latin and Latin, CJK and Latin, Latin and CJK."""
    latin = lambda c: c.rlike("^[A-Za-z0-9]$")
    cjk = lambda c: c.rlike(f"^{CJK}$")
    spaced = (latin(left_tail) & latin(right_head)) | (cjk(left_tail) & latin(right_head)) | (latin(left_tail) & cjk(right_head))
    return F.when(spaced, F.lit(" ")).otherwise(F.lit(""))


def safe_base_name(name: Column) -> Column:
    """Without folder and extension, only letters, digits, _ - . blank and CJK."""
    base = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"\.[^.]*$", "")
    return F.regexp_replace(base, r"(?U)[^\p{Alnum}_\- .一-鿿]", "")


# Recognition options in the order of the signature, with what stands for one that is unset.
SIGNATURE_OPTIONS = {"backend": "unset", "model": "unset", "revision": "unpinned", "language": "auto", "initial_prompt": "", "beam_size": "default", "vad_enabled": "default", "diarization": "diarization:off"}
#: Options of which an empty text is unset too.
EMPTY_IS_UNSET = ("revision", "language", "initial_prompt", "diarization")


def cache_signature(**options: Column) -> Column:
    """P10: first 16 hex digits of the sha256 of the options' values, joined by '::'. Options left out are unset."""
    unknown = set(options) - set(SIGNATURE_OPTIONS)
    if unknown:
        raise ValueError(f"no such options: {sorted(unknown)}")
    said = lambda name: options.get(name, F.lit(None)).cast("string")
    values = [F.coalesce(F.nullif(said(n), F.lit("")) if n in EMPTY_IS_UNSET else said(n), F.lit(unset)) for n, unset in SIGNATURE_OPTIONS.items()]
    return F.left(F.sha2(F.concat_ws("::", *values), 256), F.lit(16))


def preview(text: Column, chars: int = 2000) -> Column:
    return F.substring(text, 1, chars)


def normalise_headings(text: Column) -> Column:
    """No more than one blank line together; one space after up to three marks of a heading; trimmed."""
    spaced = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"(?mdU)^(#{1,3})\s*", "$1 ")
    return F.regexp_replace(spaced, r"(?U)^\s+|\s+$", "")


def action_key(text: Column) -> Column:
    """For comparing action items: without blanks and punctuation, in lower case."""
    return F.lower(F.regexp_replace(text, r"(?U)[\s:：,，。；;（）()「」『』【】\[\]／/\\-]+", ""))


def in_order(position: Column | str, value: Column | str, separator: str = "") -> Column:
    """Aggregate: the values in order of their position, joined."""
    p, v = (F.col(x) if isinstance(x, str) else x for x in (position, value))
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(p.alias("p"), v.alias("v")))), lambda x: x["v"]), separator)
