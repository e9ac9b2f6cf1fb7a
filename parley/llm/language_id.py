"""Operator 1, language identification by Bayesian evidence fusion.

Evidence on a text: the likelihood of its byte trigrams under each language; the language its markup declares; the suffix
of its address; and a prior of its host. Likelihoods are learned from a bounded sample of declared rows (``fit``, about
``sample_per_language`` texts a language, chosen by hash of the text, equal texts once). How far a declaration or suffix can
be trusted is counted over all rows by grouped aggregation, against what the text alone says. Host priors are counts per
host, smoothed towards the parent domain, that towards all rows.

A language is learned if about ``min_texts`` different texts declare it, however small a share of the table that is; of more
than ``max_languages`` such languages, those with most texts are. Where the table declares any other, one more column stands
for all languages that aren't learned. A text of ``LETTERS_TO_JUDGE`` letters or more is strange to the best learned language
if its trigrams are less likely than those of nearly all texts that declare that language (``STRANGE`` deviations below their
mean). A text that declares a language which isn't learned keeps it unless it is long enough and not strange; one that
declares nothing is "und" if it is strange; one that declares a learned language is of a learned one.

A text is rejected when it has too few letters to be read at all, or when no language reaches ``min_posterior``.

Defined results: a null or empty text has no letters, language "und", and is rejected; a null or empty declaration, suffix or
host is no evidence; repeated rows each get a row; an empty table gives no rows; a table in which no language can be learned
makes every row with letters enough its declared language, else "und"; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_table, steps, written
from .html_text import extract

#: Letters: a-z and bytes outside ASCII; all else is a word end.
LETTERS = byte_table(bytes(range(97, 123)) + bytes(range(128, 256)))
CELLS = 1 << 16
UNKNOWN = "und"
STRANGE, LETTERS_TO_JUDGE = 5.0, 100


def _cells(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each byte trigram that has a letter, the text of each, and the letters of each text."""
    buffer = b"  ".join(texts).translate(LETTERS)
    a = np.frombuffer(b" " + buffer + b"  ", np.uint8).astype(np.uint32)
    n = len(a) - 2
    code = (a[:n] << np.uint32(16)) | (a[1 : n + 1] << np.uint32(8)) | a[2 : n + 2]
    sizes = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)[:n]
    owner = np.pad(owner, (0, n - len(owner)), constant_values=len(texts) - 1)
    middle = a[1 : n + 1] != 32
    letters = np.bincount(owner[middle], minlength=len(texts))
    cell = ((code[middle] * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    return cell, owner[middle], letters


def fit(docs: DataFrame, text: str, declared: Column, sample_per_language: int = 400, min_texts: int = 5, max_languages: int = 200) -> tuple[list[str | None], np.ndarray]:
    """(languages, log-likelihood of each cell by language) from a bounded sample of rows that declare one. The last language
    is None, that of all others, if there are others."""
    rows = docs.select(F.col(text).alias("text"), declared.alias("declared")).where("text is not null and declared is not null")
    counts = written(rows.groupBy("declared").agg(F.approx_count_distinct("text", 0.02).alias("n")), "language-counts")
    known = counts.where(F.col("n") >= min_texts).orderBy(F.desc("n"), "declared").limit(max_languages).collect()  # max_languages rows
    sizes = {r["declared"]: r["n"] for r in known}
    named = sorted(sizes)
    others = counts.limit(max_languages + 1).count() > len(named)
    if not named:
        return [None] * others, np.full((CELLS, int(others)), -np.log(CELLS), np.float32)
    # A row is in the sample if its hash falls below the share that gives the wanted number of rows.
    share = F.create_map(*[x for k in named for x in (F.lit(k), F.lit(min(1.0, sample_per_language / sizes[k])))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003.0
    # Copies of a text are drawn together, so each text counts once: a large group of copies can't fill the sample.
    sample = rows.where(F.col("declared").isin(named)).where(draw < share[F.col("declared")]).dropDuplicates()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch, texts in steps(batches, "text"):
            cell, owner, _ = _cells(texts)
            own = np.array(batch.column(1).to_pylist(), object)
            for k in set(own.tolist()):
                sums[k] = sums.get(k, 0) + np.bincount(cell[(own == k)[owner]], minlength=CELLS)
        for k, v in sums.items():
            some = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(v[some], pa.int64())], ["declared", "cell", "n"])

    table = sample.mapInArrow(count, "declared string, cell int, n long").groupBy("declared", "cell").agg(F.sum("n").alias("n"))
    cells = table.toArrow()  # at most CELLS rows a language
    made = np.full((CELLS, len(named)), 0.5)
    column = {k: i for i, k in enumerate(named)}
    at = np.array([column[k] for k in cells.column("declared").to_pylist()], np.int64)
    made[cells.column("cell").to_numpy(), at] += cells.column("n").to_numpy()
    logs = np.log(made / made.sum(0)).astype(np.float32)
    return ([*named, None], np.column_stack([logs, np.full(CELLS, -np.log(CELLS), np.float32)])) if others else (named, logs)


def _likelihoods(rows: DataFrame, model: tuple[list[str], np.ndarray], temper: float) -> DataFrame:
    """Adds ``letters`` and ``text_ll`` (per language, tempered: neighbouring trigrams aren't independent). Drops the text."""
    named, table = model
    sent = rows.sparkSession.sparkContext.broadcast(table)  # CELLS numbers a language
    kept = [c for c in rows.columns if c != "text"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = sent.value
        for batch, texts in steps(batches, "text"):
            cell, owner, letters = _cells(texts)
            sums = np.stack([np.bincount(owner, logs[cell, j], minlength=len(texts)) for j in range(logs.shape[1])], 1) if len(named) else np.zeros((len(texts), 0))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(named)), pa.array((sums * temper).ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(letters, pa.int64()), flat], [*kept, "letters", "text_ll"])

    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("letters", T.LongType()), T.StructField("text_ll", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(scan, schema)


def _with_others(scored: DataFrame, named: list[str | None]) -> DataFrame:
    """Gives the last column, that of all languages not learned, the lead where a text is strange to the best of the others."""
    scored = written(scored, "language-scored")
    ours = F.slice("text_ll", 1, len(named) - 1)
    best, each = F.array_position(ours, F.array_max(ours)).cast("int"), F.array_max(ours) / F.col("letters")
    own = F.element_at(F.array(*[F.lit(x) for x in named[:-1]]), best)
    usual = scored.where((F.col("letters") >= LETTERS_TO_JUDGE) & (F.col("declared") == own)).groupBy(best.alias("best")).agg(F.avg(each).alias("mean"), F.coalesce(F.stddev(each), F.lit(0.0)).alias("deviation"))
    least = {r["best"]: r["mean"] - STRANGE * max(r["deviation"], 0.01 * abs(r["mean"])) for r in usual.collect()}  # a row a language
    bound = F.element_at(F.array(*[F.lit(least.get(i)).cast("double") for i in range(1, len(named))]), best)
    strange = (F.col("letters") >= LETTERS_TO_JUDGE) & (each < bound)
    usual_text = F.coalesce((F.col("letters") >= LETTERS_TO_JUDGE) & (each >= bound), F.lit(False))
    learned = F.col("declared").isin(named[:-1])
    wins = F.when(F.col("declared").isNull(), F.coalesce(strange, F.lit(False))).when(learned, False).otherwise(~usual_text)
    top = F.array_max(ours)
    return scored.withColumn("text_ll", F.concat(ours, F.array(F.when(wins, top + 20.0).otherwise(top - 20.0))))


def _trust(scored: DataFrame, by: str, n: int, weight: float = 20.0) -> DataFrame:
    """(by, log P(value | language) as an array), counted over all rows, smoothed towards the value's overall share."""
    pairs = written(scored.where(F.col(by).isNotNull() & (F.col("best") >= 0)).groupBy(by, "best").agg(F.count("*").alias("n")), f"language-{by}")
    by_value = pairs.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("m"), F.sum("n").alias("value_n"))
    totals = {r["best"]: r["n"] for r in pairs.groupBy("best").agg(F.sum("n").alias("n")).collect()}  # a row a language
    every = max(1, sum(totals.values()))
    log = lambda i: F.log((F.coalesce(F.col("m")[F.lit(i)], F.lit(0)) + weight * F.col("value_n") / every) / (totals.get(i, 0) + weight))
    return by_value.select(by, F.array(*[log(i) for i in range(n)]).alias(f"{by}_ll"))


def _counts(scored: DataFrame, by: list[str], n: int, name: str) -> DataFrame:
    counted = [F.sum((F.col("best") == i).cast("long")).alias(f"n{i}") for i in range(n)]
    return scored.where(F.col("best") >= 0).groupBy(*by).agg(*counted).select(*by, F.array(*[f"n{i}" for i in range(n)]).alias(name))


def _priors(scored: DataFrame, n: int, weight: float = 20.0) -> DataFrame:
    """(host, parent, prior_ll): the host's counts smoothed towards its parent's, those towards all rows', those to equal shares."""
    hosts = written(_counts(scored.where(F.col("host").isNotNull()), ["host", "parent"], n, "own"), "language-hosts")
    summed = lambda c, name: F.array(*[F.sum(F.col(c)[i]) for i in range(n)]).alias(name)
    parents = hosts.groupBy(F.col("parent").alias("of_parent")).agg(summed("own", "up"))
    top = [x or 0 for x in hosts.agg(summed("own", "top")).first()["top"]]  # a number a language
    p0 = F.array(*[F.lit((c + weight / n) / (sum(top) + weight)) for c in top])
    total = lambda c: F.aggregate(c, F.lit(0).cast("double"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    smooth = lambda c, prior: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.coalesce(F.get(F.col(c), i), F.lit(0)) + weight * F.get(prior, i)) / (total(F.col(c)) + weight))
    out = hosts.join(parents, F.col("parent").eqNullSafe(F.col("of_parent")), "left").select("host", "own", "up")
    out = out.withColumn("p1", smooth("up", p0)).withColumn("p2", smooth("own", F.col("p1")))
    return out.select("host", F.transform("p2", lambda x: F.log(x)).alias("prior_ll"))


def identify(docs: DataFrame, key: str, text: Column, declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, parent: Column | None = None, sample_per_language: int = 400, temper: float = 0.2, min_letters: int = 8, min_posterior: float = 0.5) -> DataFrame:
    """Per row: the key, language, posterior, letters, accepted. Evidence columns may be left out."""
    none = F.lit(None).cast("string")
    rows = docs.select(F.col(key), text.alias("text"), *((none if c is None else F.nullif(c.cast("string"), F.lit(""))).alias(a) for a, c in (("declared", declared), ("suffix", suffix), ("host", host), ("parent", parent))))
    named, table = fit(rows, "text", F.col("declared"), sample_per_language)
    if not named:
        blank = _likelihoods(rows, (named, table), temper)
        return blank.select(key, F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("posterior"), "letters", F.lit(False).alias("accepted"))
    n = len(named)
    numbers = F.sequence(F.lit(0), F.lit(n - 1))
    scored = _likelihoods(rows, (named, table), temper)
    if named[-1] is None and n > 1:
        scored = _with_others(scored, named)
    best = F.when(F.col("letters") >= min_letters, F.array_position("text_ll", F.array_max("text_ll")).cast("int") - 1).otherwise(-1)
    scored = written(scored.withColumn("best", best), "language")
    fused = scored
    for by, made in (("declared", _trust(scored, "declared", n)), ("suffix", _trust(scored, "suffix", n)), ("host", _priors(scored, n))):
        fused = fused.join(made, by, "left")
    add = lambda i: F.get("text_ll", i) + sum((F.coalesce(F.get(c, i), F.lit(0.0)) for c in ("declared_ll", "suffix_ll", "prior_ll")), F.lit(0.0))
    fused = fused.select(key, "letters", "declared", F.transform(numbers, add).alias("ll"))
    top = F.array_max("ll")
    share = 1.0 / F.aggregate("ll", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    fused = fused.select(key, "letters", "declared", F.array_position("ll", top).cast("int").alias("at"), share.alias("posterior"))
    learned = F.element_at(F.array(*[F.lit(x).cast("string") for x in named]), F.col("at"))
    # None has won: the declared language, unless it is one that would have been known by its text.
    found = F.coalesce(learned, F.when(~F.col("declared").isin([x for x in named if x is not None]), F.col("declared")))
    accepted = (F.col("letters") >= min_letters) & (F.col("posterior") >= min_posterior) & found.isNotNull()
    return fused.select(key, F.when(accepted, found).otherwise(UNKNOWN).alias("language"), F.round("posterior", 6).alias("posterior"), "letters", accepted.alias("accepted"))


def report(docs: DataFrame) -> DataFrame:
    """Over ``documents``: lang is what the document declares, source stands for its host."""
    return identify(docs, "doc_id", F.col("text"), declared=F.col("lang"), host=F.col("source"))


#: The part of a host that someone registered: two labels, or three under a country's own second level.
REGISTERED = r"([^.]+\.(?:(?:ac|co|com|edu|gob|gouv|gov|ne|net|or|org)\.[a-z]{2}|[^.]+))$"


def pages_report(pages: DataFrame) -> DataFrame:
    """Over ``pages``: the html element's lang, the address's top-level suffix and host, and the text as operator 10 has it."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([a-zA-Z]{2,3})", 1))
    blank = lambda c: F.nullif(c, F.lit(""))
    told = {"declared": declared, "suffix": F.regexp_extract(host, r"\.([^.]+)$", 1), "host": host, "parent": F.regexp_extract(host, REGISTERED, 1)}
    read = extract(pages.select("page_id", "url", "html", *(blank(c).alias(k) for k, c in told.items())), [*told])
    return identify(read, "page_id", F.col("text"), **{k: F.col(k) for k in told})
