"""Helpers shared by the operators of this subpackage: tables, shared folder, word splitting on byte arrays."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# A new path in the shared folder, and the rows as a table there: cuts lineage and outlives lost executors.
from parley.sources.store import materialised as written  # noqa: F401
from parley.sources.store import shared_path as new_path  # noqa: F401

#: Bytes of text that one numpy step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(df: DataFrame, bytes_each: int = 256 << 20) -> int:
    """How many partitions a shuffle of a written table's rows needs: as many as the session's shuffles have, or more where
    its files' size would make them larger than ``bytes_each``."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, min(-(-size // bytes_each), 1_000_000))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """While it lasts, queries that run send Arrow batches of fewer rows: for rows that hold long lists or texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def unique_column(df: DataFrame, stem: str) -> str:
    """A column name that the frame doesn't have yet."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name in taken:
        name += "_"
    return name


def steps(batches: Iterator[pa.RecordBatch], text: str, limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cuts Arrow batches into slices of about ``limit`` bytes of text; yields the slice and its texts (null: empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        first, held, texts = 0, 0, []
        for i in range(batch.num_rows):
            x = column[i].as_py() or b""
            if texts and held + len(x) > limit:
                yield batch.slice(first, i - first), texts
                first, held, texts = i, 0, []
            texts.append(x)
            held += len(x) + 1
        if texts:
            yield batch.slice(first), texts


def byte_table(is_word: bytes, lower: bool = True) -> bytes:
    """A translation table: bytes of ``is_word`` stay (A-Z lower-cased first), others become a space."""
    table = bytearray(b" " * 256)
    for b in is_word:
        table[b] = b
    if lower:
        for b in range(65, 91):
            table[b] = table[b + 32]
    return bytes(table)


_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, STEP_BYTES + 4096)
        made = []
        for base in (_ODD, _ODD_INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        if n > 4 * STEP_BYTES:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that low and high bits of a sum are both usable."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts: one buffer, the words' bounds in it, a 64-bit hash and the text's number of each."""

    def __init__(self, texts: list[bytes], table: bytes):
        self.buffer = b" ".join(texts).translate(table) + b" "
        a = np.frombuffer(self.buffer, np.uint8)
        inside = np.zeros(len(a) + 1, np.int8)
        inside[1:] = a != 32
        change = np.diff(inside)
        self.start = np.flatnonzero(change == 1)
        self.end = np.flatnonzero(change == -1)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        at = np.cumsum(lengths) - lengths
        #: Where each text's words begin and end.
        self.first = np.searchsorted(self.start, at)
        self.last = np.append(self.first[1:], len(self.start))[: len(texts)]
        self.text = np.repeat(np.arange(len(texts)), self.last - self.first)
        power, inverse = _power_tables(len(a))
        total = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
        self.hash = mixed((total[self.end] - total[self.start]) * inverse[self.start]) if len(self.start) else np.zeros(0, np.uint64)

    def word(self, i: int) -> bytes:
        return self.buffer[self.start[i] : self.end[i]]

    def __len__(self) -> int:
        return len(self.start)
