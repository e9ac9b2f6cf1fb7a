"""Operator 4, line de-duplication over levelled sorted runs of line hashes.

Each batch of documents is reduced to one row per line key (128-bit hash, documents that have it, largest doc_id). A run is
such a table, in a fixed number of buckets by key, each sorted. A new batch is merge-joined with the runs there are: keys
that no run has (the anti-join) are new, those known take over what the runs say of them, so a run's rows hold totals up to
its batch; both form the batch's own run. When a level holds ``fan_in`` runs, they are merged into one run of the next. As
runs share their buckets, neither joins nor merges shuffle them again; only a batch's own keys are shuffled. Of a key's
rows the one with the highest total is the last, and says at the end whether it is in ``min_docs`` documents and where the
kept copy is.

While the keys to drop are few (``max_broadcast``, counted first) they are sent to all tasks, which drop lines in one pass
over the texts; beyond that, each document's keys to drop are joined to it.

Defined results: a null or empty text has one empty line, which is never long enough to be dropped; doc_id null counts as
one document below all others; rows that repeat a doc_id count as one document, and all of them keep the line if it is the
largest; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, partitions_for, steps, written

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
NO_ID = -(1 << 63)


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line that is long enough, else None."""
    line = line.strip(BLANKS)
    if len(line) < min_chars:
        return None
    if not line.isascii() and len(line.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.md5(line.translate(_LOWER), usedforsecurity=False).digest()


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, key): each key of a document once. A null doc_id becomes the smallest number."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, "text"):
            ids, keys = [], []
            for i, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                own = {k for line in t.split(b"\n") if (k := line_key(line, min_chars))}
                ids += [i] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "key"])

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text").mapInArrow(scan, "doc_id long, key binary")


ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class Runs:
    """Levelled runs of (key, n_docs, top_doc), each a bucketed and sorted table whose files lie in the shared folder."""

    def __init__(self, spark: SparkSession, fan_in: int = 2, buckets: int | None = None):
        self.spark, self.fan_in = spark, fan_in
        #: As many as the shuffle has partitions, unless told: a batch's last shuffle is then by bucket.
        self.usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = buckets or self.usual
        self.levels: list[list[str]] = [[]]
        self.made: list[str] = []

    @contextmanager
    def _in_order(self) -> Iterator[None]:
        """While it lasts, scans of runs count on the order of their buckets, of which each is one file: tasks write a bucket
        each, or some whole ones. So merges sort nothing."""
        usual = self.spark.conf.get(ORDERED)
        self.spark.conf.set(ORDERED, "true")
        try:
            yield
        finally:
            self.spark.conf.set(ORDERED, usual)

    def _write(self, rows: DataFrame) -> str:
        name, path = f"lines_run_{uuid.uuid4().hex}", new_path(self.spark, "lines-run")
        self.made.append(name)
        with self._in_order():
            rows.write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        return name

    def drop(self) -> None:
        """Takes the runs' names out of the session's catalog; what was read from them before can still be used."""
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.made, self.levels = [], [[]]

    def _read(self, name: str, tag: str = "") -> DataFrame:
        table = self.spark.table(name)
        return table.withColumnsRenamed({"n_docs": f"n_docs{tag}", "top_doc": f"top_doc{tag}"})

    def names(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def add(self, keys: DataFrame) -> DataFrame:
        """Adds a batch of (doc_id, key), whose doc_ids no earlier batch had. Returns its keys that no run had before."""
        # Counted in two steps, so a key that a third of all rows have is summed before it is shuffled.
        batch = keys.distinct().groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("top_doc"))
        rows = self._read(self._write(batch if self.buckets == self.usual else batch.repartition(self.buckets, "key")))
        before, top = [], [F.col("top_doc")]
        for n, run in enumerate(self.names()):
            rows = rows.join(self._read(run, str(n)).hint("merge"), "key", "left")
            before.append(F.col(f"n_docs{n}"))
            top.append(F.col(f"top_doc{n}"))
        # Of an older run's total and a newer one's, the newer is the higher. Without any, the key is new.
        known = F.greatest(F.lit(None).cast("long"), F.lit(None).cast("long"), *before)
        rows = rows.select("key", F.coalesce(known, F.lit(0)).alias("known"), F.col("n_docs"), (F.greatest(*top) if before else top[0]).alias("top_doc"))
        run = self._write(rows.select("key", (F.col("n_docs") + F.col("known")).alias("n_docs"), "top_doc"))
        self.levels[0] = [*self.levels[0], run]
        self._compact()
        return rows.where("known = 0").select("key")

    def _merged(self, one: str, two: str) -> str:
        """Both runs' keys with their last totals: a merge of sorted buckets, which shuffles nothing."""
        both = self._read(one, "1").join(self._read(two, "2").hint("merge"), "key", "full")
        return self._write(both.select("key", F.greatest("n_docs1", "n_docs2").alias("n_docs"), F.greatest("top_doc1", "top_doc2").alias("top_doc")))

    def _compact(self) -> None:
        for at in range(100):
            if at >= len(self.levels) or len(self.levels[at]) < self.fan_in:
                return
            run = reduce(self._merged, self.levels[at])
            self.levels[at] = []
            self.levels += [[]] * (len(self.levels) == at + 1)
            self.levels[at + 1] = [*self.levels[at + 1], run]

    def repeated(self, min_docs: int) -> DataFrame:
        """(key, top_doc) of the keys in ``min_docs`` documents or more: only those rows of the runs are brought together."""
        hot = reduce(DataFrame.unionAll, [self._read(n).where(F.col("n_docs") >= min_docs) for n in self.names()])
        return hot.groupBy("key").agg(F.max("top_doc").alias("top_doc"))


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int | None = None, fan_in: int = 2, batch_keys: int = 200_000_000) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of all long lines, and (key, top_doc) of those in ``min_docs`` documents or more. Without ``batches``
    there are as many as ``batch_keys`` lines each make, three at least."""
    spark = docs.sparkSession
    lines = written(line_keys(docs, min_chars), "lines")
    batches = batches or max(3, -(-lines.count() // batch_keys))
    runs = Runs(spark, fan_in, partitions_for(lines))
    try:
        for b in range(batches):
            runs.add(lines.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b))
        return lines, written(runs.repeated(min_docs), "lines-hot")
    finally:
        runs.drop()


def _rebuilt(rows: DataFrame, min_chars: int, away: Callable[[], Callable[[int | None, list | None], object]]) -> DataFrame:
    """Rows (doc_id, text, others) without the lines whose keys are in what ``away`` says of the row's doc_id and others."""

    def rebuild(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone_of = away()
        for batch, texts in steps(parts, "text"):
            more = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * len(texts)
            counts, dropped, kept = [], [], []
            for i, gone, t in zip(batch.column(0).to_pylist(), more, texts, strict=True):
                old = t.split(b"\n")
                is_gone = gone_of(i, gone)
                new = old if is_gone is None else [x for x in old if not is_gone(line_key(x, min_chars))]
                counts.append(len(old))
                dropped.append(len(old) - len(new))
                kept.append(b"\n".join(new))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    return rows.mapInArrow(rebuild, T.StructType([rows.schema["doc_id"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())]))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int | None = None, fan_in: int = 2, max_broadcast: int = 200_000) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_dropped, kept (the text that stays)."""
    docs = docs.select("doc_id", "text")
    lines, hot = repeated_lines(docs, min_chars, min_docs, batches, fan_in)
    few = hot.limit(max_broadcast + 1).toArrow()
    if few.num_rows <= max_broadcast:
        sent = docs.sparkSession.sparkContext.broadcast((few.column("key").to_pylist(), few.column("top_doc").to_pylist()))

        def of_table() -> Callable:
            top = dict(zip(*sent.value, strict=True))
            return lambda i, _: lambda k: k is not None and k in top and top[k] != (NO_ID if i is None else i)

        return _rebuilt(docs, min_chars, of_table)
    # A very common key may have a third of all rows here: adaptive execution splits such partitions of a plain join.
    gone = lines.join(hot, "key").where(F.col("doc_id") != F.col("top_doc")).groupBy("doc_id").agg(F.collect_set("key").alias("gone")).select(F.col("doc_id").alias("own_id"), "gone")
    joined = docs.join(gone, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col("own_id"), "left").select("doc_id", "text", "gone")
    return _rebuilt(joined, min_chars, lambda: lambda _, keys: set(keys).__contains__ if keys else None)


def report(docs: DataFrame) -> DataFrame:
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def oracle() -> str:
    """The report in DuckDB. Keys are stripped and lower-cased in ASCII only."""
    key = "translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH cut AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
keyed AS (SELECT *, {key} AS key FROM cut),
hot AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id <> h.top AS gone FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
