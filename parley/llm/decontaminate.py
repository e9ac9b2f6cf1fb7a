"""Operator 2, benchmark decontamination by winnowing.

Of the k-gram hashes of a text, the smallest in each window of w consecutive ones is kept (all of them on ties). Two texts
that share k+w-1 consecutive words therefore share a kept hash at the same place of the shared span. Training and test
fingerprints are joined on the hash, and each hit is extended along its diagonal to the longest run of equal words; runs
of at least the window's length count. The words themselves are compared at the end, so a hash collision adds nothing.

Two forms of the join: while the test fingerprints are few (``max_broadcast``, counted first), they are sent to every task
and each document is done in one pass without a shuffle; beyond that, fingerprints of both sides are shuffled and joined,
under those (k, w) that items call for. The items that a document may hold are then laid behind its text, which is shuffled
once whatever their number, and are extended one by one as they pass.

Defined results: a null or empty text has no words and no hits; an empty benchmark gives no hits; items with the same
text all count; an item without an id goes by the empty string; rows repeat as they come; other columns of either table are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, byte_table, mixed, steps, written

#: 0-9, a-z (A-Z lower-cased) and every byte outside ASCII.
WORD_BYTES = byte_table(bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256)))
MAX_K = 5
SPAN = "array<struct<item:string,first:int,last:int>>"


def scheme(n_words: int, span: int) -> tuple[int, int]:
    """(k, w) for items of so many words: k + w - 1 is the length of the item's windows."""
    length = min(span, n_words)
    k = min(MAX_K, length)
    return k, length - k + 1


def winnow(words: Words, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the kept k-grams of each text that has k + w - 1 words."""
    n = len(words) - k + 1
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = np.zeros(n, np.uint64)
    for j in range(k):
        gram = gram * np.uint64(0xD6E8FEB86659FD93) + words.hash[j : j + n]
    gram = mixed(gram)
    windows = n - w + 1
    low = gram[:windows].copy()
    for j in range(1, w):
        np.minimum(low, gram[j : j + windows], out=low)
    whole = words.text[:windows] == words.text[k + w - 2 : k + w - 2 + windows]
    kept = np.zeros(n, bool)
    for j in range(w):
        kept[j : j + windows] |= whole & (gram[j : j + windows] == low)
    at = np.flatnonzero(kept)
    return at, gram[at]


class Items:
    """Test items with their fingerprints, by scheme, ready for lookups."""

    def __init__(self, rows: list[tuple[str, bytes]], span: int):
        rows = [(i, t) for i, t in rows if t]
        self.span = span
        self.ids = [i for i, _ in rows]
        words = Words([t for _, t in rows], WORD_BYTES)
        self.hashes = [words.hash[a:b] for a, b in zip(words.first, words.last, strict=True)]
        self.words = [words.buffer[words.start[a] : words.end[b - 1]].split() if b > a else [] for a, b in zip(words.first, words.last, strict=True)]
        self.by_scheme = {}
        for s in sorted({scheme(len(x), span) for x in self.hashes if len(x)}):
            mine = {i for i, x in enumerate(self.hashes) if len(x) and scheme(len(x), span) == s}
            at, found = winnow(words, *s)
            own = np.array([words.text[p] in mine for p in at], bool)
            at, found = at[own], found[own]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            seen = np.zeros(1 << 16, bool)
            seen[found >> np.uint64(48)] = True
            self.by_scheme[s] = (found, words.text[at], at - words.first[words.text[at]], seen)

    def hits(self, words: Words) -> list[list[tuple[str, int, int]]]:
        """For each text: (item, first word, last word + 1) of each run of equal words that is long enough."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(words.first))]
        for s, (known, item, place, seen) in self.by_scheme.items():
            at, found = winnow(words, *s)
            few = seen[found >> np.uint64(48)]
            at, found = at[few], found[few]
            low, high = np.searchsorted(known, found), np.searchsorted(known, found, "right")
            some = np.flatnonzero(high > low)
            if not len(some):
                continue
            reach = (high - low)[some]
            pick = np.repeat(low[some], reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
            where = np.repeat(at[some], reach)
            for t, i, d in sorted(set(zip(words.text[where].tolist(), item[pick].tolist(), (where - place[pick]).tolist(), strict=True))):
                out[t] += self.extended(words, t, i, d, s[0] + s[1] - 1)
        return out

    def extended(self, words: Words, text: int, i: int, diagonal: int, least: int) -> list[tuple[str, int, int]]:
        begin, end = max(diagonal, words.first[text]), min(diagonal + len(self.hashes[i]), words.last[text])
        same = np.zeros(end - begin + 2, np.int8)
        same[1:-1] = words.hash[begin:end] == self.hashes[i][begin - diagonal : end - diagonal]
        change = np.diff(same)
        out = []
        for a, b in zip(np.flatnonzero(change == 1) + begin, np.flatnonzero(change == -1) + begin, strict=True):
            if b - a >= least and words.buffer[words.start[a] : words.end[b - 1]].split() == self.words[i][a - diagonal : b - diagonal]:
                out.append((self.ids[i], int(a - words.first[text]), int(b - words.first[text])))
        return out


def _spans(found: list[list[tuple[str, int, int]]]) -> pa.Array:
    kind = pa.list_(pa.struct([("item", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))
    return pa.array([[dict(zip(("item", "first", "last"), x, strict=True)) for x in row] for row in found], kind)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, span: int = 10, max_broadcast: int = 2_000_000) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, and spans (item, first word, last word + 1) of every shared run."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where(F.col("text").isNotNull())
    # A fingerprint is at most one per word: this bounds what would be broadcast before anything is gathered.
    sizes = items.select(F.sum(F.length("text")).alias("n")).first()
    docs = docs.select("doc_id", "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("item", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])))])
    if (sizes["n"] or 0) <= 6 * max_broadcast:
        rows = [(r["item"], r["text"].encode()) for r in items.toLocalIterator()]
        sent = spark.sparkContext.broadcast((rows, span))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Items(*sent.value)
            for batch, texts in steps(batches, "text"):
                words = Words(texts, WORD_BYTES)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.last - words.first, pa.int64()), _spans(known.hits(words))], ["doc_id", "n_words", "spans"])

        return docs.mapInArrow(scan, schema)
    return _joined(docs, items, span, schema)


def _fingerprints(df: DataFrame, key: str, span: int, schemes: list[tuple[int, int]], own_only: bool) -> DataFrame:
    """(key, k, w, hash) of every kept k-gram, each hash once per key."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, "text"):
            words = Words(texts, WORD_BYTES)
            for k, w in schemes:
                at, found = winnow(words, k, w)
                own = words.text[at]
                if own_only:
                    sizes = words.last - words.first
                    fits = np.array([scheme(int(sizes[t]), span) == (k, w) for t in own], bool)
                    own, found = own[fits], found[fits]
                if not len(own):
                    continue
                pairs = np.unique(np.stack([own.astype(np.uint64), found]), axis=1)
                n = pairs.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs[0].astype(np.int64))), pa.array(np.full(n, k * 100 + w, np.int32)), pa.array(pairs[1].view(np.int64))], [key, "scheme", "hash"])

    return df.select(key, "text").mapInArrow(scan, T.StructType([df.schema[key], T.StructField("scheme", T.IntegerType()), T.StructField("hash", T.LongType())]))


def _schemes(items: DataFrame, span: int) -> list[tuple[int, int]]:
    """The (k, w) that items call for: ``span`` at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in steps(batches, "text"):
            words = Words(texts, WORD_BYTES)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.minimum(words.last - words.first, span)))], ["n"])

    found = items.select("text").mapInArrow(count, "n long").distinct().collect()
    return sorted({scheme(r["n"], span) for r in found if r["n"]})


def _joined(docs: DataFrame, items: DataFrame, span: int, schema: T.StructType) -> DataFrame:
    """The join for a benchmark of any size. Rows are told apart by doc_id and text; equal ones are one here."""
    row = F.sha2(F.concat_ws("\x01", F.coalesce(F.col("doc_id").cast("string"), F.lit("\x02")), F.coalesce("text", F.lit(""))), 256)
    keyed = docs.withColumn("row", row)
    items = items.withColumn("item_row", F.sha2(F.concat_ws("\x01", "item", "text"), 256))
    schemes = _schemes(items, span)
    ours = _fingerprints(keyed, "row", span, schemes, False)
    theirs = _fingerprints(items, "item_row", span, schemes, True)
    # One row a document and item, whatever number of fingerprints they share.
    pairs = ours.join(theirs, ["scheme", "hash"]).select("row", "item_row").distinct()
    passages = items.select("item_row", "item", F.col("text").alias("passage")).dropDuplicates(["item_row"])
    wanted = pairs.join(passages, "item_row").select("row", "item", F.col("passage").alias("text"), F.lit(True).alias("is_item"))
    held = keyed.select("row", "text").join(pairs.select("row").distinct(), "row", "left_semi").select("row", F.lit(None).cast("string").alias("item"), "text", F.lit(False).alias("is_item"))
    laid = held.unionByName(wanted).repartition("row").sortWithinPartitions("row", "is_item", "item")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A document's text comes before its items."""
        words = None
        for batch, texts in steps(batches, "text"):
            rows, spans = [], []
            for row, item, is_item, text in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), texts, strict=True):
                if is_item:
                    rows.append(row)
                    spans.append(Items([(item, text)], span).hits(words)[0])
                else:
                    words = Words([text], WORD_BYTES)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), _spans(spans)], ["row", "spans"])

    found = written(laid.mapInArrow(extend, f"row string, spans {SPAN}").distinct(), "decontaminate").groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, "text"):
            words = Words(texts, WORD_BYTES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(words.last - words.first, pa.int64())], ["doc_id", "row", "n_words"])

    counted = keyed.mapInArrow(count, T.StructType([schema["doc_id"], T.StructField("row", T.StringType()), schema["n_words"]]))
    return counted.join(found, "row", "left").select("doc_id", "n_words", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def covered(spans: Column) -> Column:
    """How many words lie in at least one span."""
    bounds = F.array_sort(F.transform(spans, lambda s: F.struct(s["first"].alias("a"), s["last"].alias("b"))))
    step = lambda acc, s: F.struct(F.greatest(acc["upto"], s["b"]).alias("upto"), (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["upto"], s["a"])).cast("long")).alias("n"))
    return F.aggregate(bounds, F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")), step, lambda acc: acc["n"])


def report(docs: DataFrame, benchmark: DataFrame, span: int = 10, max_broadcast: int = 2_000_000) -> DataFrame:
    items = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item"])))
    found = contaminated_spans(docs, benchmark, span, max_broadcast).select("doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), items.alias("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def oracle() -> str:
    """The report in DuckDB, by whole windows as text."""
    words = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
WITH d AS (SELECT doc_id, {words("text")} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words("text")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[g : g + least(len(w), 10) - 1], ' ') AS span
  FROM (SELECT *, unnest(range(1, CAST(len(w) - least(len(w), 10) + 2 AS BIGINT))) AS g FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, g, n, array_to_string(w[g : g + n - 1], ' ') AS span FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS g FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, g, n, item FROM dw JOIN iw USING (n, span)),
per AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(CAST(g AS BIGINT), CAST(g + n AS BIGINT))) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN its USING (doc_id)"""
