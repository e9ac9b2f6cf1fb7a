"""Operator 8, quality rules with adaptive thresholds. DataFrame functions only.

Measures of each text are gathered in mergeable quantile sketches per language and source; small groups use the merged
sketches of their language, and those the merged sketches of all. A sketch counts a measure's values in buckets that grow
by a constant factor, so it has about a thousand buckets at most whatever its group's size, merging adds counts, and its
quantiles are of exact rank and within ``ERROR`` of the value; no order of rows or partitions changes it. The quartiles give
fences (three times the spread beyond the quartile, with a least spread, so that a group of nearly equal texts doesn't
reject its own), and measures are joined with the fences of their group and filtered.

Repeated windows are told by a 64-bit hash of their words. Defined results: a null or empty text has no words and fails the base rule; null language and null source are groups;
repeated rows each get a row and count in the sketches; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BLANK = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: (measure, numerator, denominator, least spread, sides): fences above ("high") or on both sides ("both").
MEASURES = [
    ("symbols", "n_symbols", "word_chars", 0.02, "high"),
    ("dup_lines", "n_dup_lines", "n_lines", 0.10, "high"),
    ("repeats", "n_repeat_words", "n_words", 0.05, "high"),
    ("word_length", "word_chars", "n_words", 0.40, "both"),
]

#: Values of a bucket differ from the one that stands for it by this share at most.
ERROR = 0.01
GROWTH = (1 + ERROR) / (1 - ERROR)
ZERO = -(1 << 30)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words that lie in 5-word windows found twice or more in the text."""
    window = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))

    def marked(hashes: Column) -> Column:
        at = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        near = lambda s, p, d: F.coalesce(F.get(s, p + d)["h"] == F.get(s, p)["h"], F.lit(False))
        starts = _let(at, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, p: near(s, p, -1) | near(s, p, 1)), lambda x: x["i"])))
        grow = lambda acc, i: F.struct((i + WINDOW).alias("upto"), (acc["n"] + (i + WINDOW - F.greatest(acc["upto"], i)).cast("long")).alias("n"))
        return F.aggregate(starts, F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")), grow, lambda acc: acc["n"])

    counted = lambda hashes: F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(marked(hashes))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(_let(window(words), counted))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (all but the first three long)."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    rows = docs.select("doc_id", "lang", "source", of_words.alias("w"), of_lines.alias("l"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    return rows.select("doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")


def ratio(numerator: str, denominator: str) -> Column:
    return F.try_divide(F.col(numerator).cast("double"), F.col(denominator).cast("double"))


def bucket_of(value: Column) -> Column:
    """The bucket of a value: the least i with GROWTH^i not below it; ZERO for 0."""
    return F.when(value <= 0, ZERO).otherwise(F.ceil(F.log(value) / math.log(GROWTH))).cast("int")


def value_of(bucket: Column) -> Column:
    """The value that stands for a bucket, within ERROR of all its values."""
    return F.when(bucket == ZERO, 0.0).otherwise(F.pow(F.lit(GROWTH), bucket) * (2 / (GROWTH + 1)))


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the sketches of each group, as rows that can be added up. Rows without words are
    left out."""
    measures = F.array(*[F.struct(F.lit(m).alias("measure"), bucket_of(ratio(a, b)).alias("bucket")) for m, a, b, _, _ in MEASURES])
    each = rows.where("n_words > 0").select("lang", "source", F.inline(measures))
    return each.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, a struct of low and high quartile for each measure) of sketches merged by ``keys``."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    # A list of a sketch's buckets, of which there are a bounded number.
    whole = merged.groupBy(*keys, "measure").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("buckets"))

    def at(share: float) -> Column:
        """The first bucket up to which there are ``share`` of all values."""
        step = lambda acc, x: F.struct(F.when(acc["upto"] < share * F.col("n"), x["bucket"]).otherwise(acc["bucket"]).alias("bucket"), (acc["upto"] + x["n"]).alias("upto"))
        return value_of(F.aggregate("buckets", F.struct(F.lit(ZERO).alias("bucket"), F.lit(0).cast("long").alias("upto")), step, lambda acc: acc["bucket"]))

    found = whole.select(*keys, "measure", "n", F.struct(at(0.25).alias("a"), at(0.75).alias("b")).alias("q"))
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("measure") == m, F.col("q"))).alias(m) for m, *_ in MEASURES))


def fences(rows: DataFrame, min_group: int = 100, width: float = 3.0) -> DataFrame:
    """(lang, source, low_ and high_ of each measure). Rows without words are not in the sketches."""
    sketch = written(sketches(rows), "quality-sketches")
    named = lambda df, tag: df.withColumnsRenamed({c: f"{tag}_{c}" for c in df.columns if c not in ("lang", "source")})
    own, by_lang = named(quartiles(sketch, ["lang", "source"]), "own"), named(quartiles(sketch, ["lang"]), "lang").withColumnRenamed("lang", "of_lang")
    overall = quartiles(sketch, []).first()  # two numbers a measure
    joined = own.join(by_lang, F.col("lang").eqNullSafe(F.col("of_lang")), "left")
    out = ["lang", "source"]
    for m, _, _, least, sides in MEASURES:
        every = F.struct(*[F.lit(overall[m][c] if overall and overall[m] else None).cast("double").alias(c) for c in ("a", "b")])
        q = F.when(F.col("own_n") >= min_group, F.col(f"own_{m}")).when(F.col("lang_n") >= min_group, F.col(f"lang_{m}")).otherwise(every)
        spread = width * F.greatest(q["b"] - q["a"], F.lit(least))
        out += [(q["b"] + spread).alias(f"high_{m}"), (q["a"] - spread if sides == "both" else F.lit(float("-inf"))).alias(f"low_{m}")]
    return joined.select(*out)


def filtered(docs: DataFrame, min_words: int = 10, max_repeat_percent: int = 20, min_group: int = 100, width: float = 3.0) -> DataFrame:
    """Per row of ``docs``: doc_id, the measures, base_failed, kept."""
    rows = written(measured(docs), "quality-measures")
    limits = written(fences(rows, min_group, width).withColumnsRenamed({"lang": "of_lang", "source": "of_source"}), "quality-fences")
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    inside = F.lit(True)
    for m, a, b, _, _ in MEASURES:
        x = ratio(a, b)
        inside &= F.coalesce((x <= F.col(f"high_{m}")) & (x >= F.col(f"low_{m}")), F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & inside).alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    return filtered(docs)
