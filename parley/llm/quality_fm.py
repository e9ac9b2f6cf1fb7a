"""Operator 7, a quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): the pairwise part takes one pass over
a text's features. Features: hashed words with damped counts, at unit length; shares of character classes, line and word
statistics; the table's n_chars as metadata. Labels, language, source and doc_id are never features.

It is fitted on at most about ``max_rows`` labelled rows (chosen by hash of doc_id, so by no order); their features are
made by tasks, and only those rows' features reach the driver. Scores of all documents are made by tasks.

Defined results: a null or empty text gets the score of the empty text; a null n_chars counts as the text's own length;
labels that are null, and those of a
doc_id with two different labels, aren't used; without any usable label every score is 0.5; repeated rows each get a row; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, byte_table, steps

WORD_BYTES = byte_table(bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256)))
CELLS = 1 << 13
_CLASS = np.zeros(256, np.uint8)
for _c, _bytes in enumerate((bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b" \t\r\x0b\x0c", b"\n", b"#*$%&|<>", b".,;:!?'\"()-", bytes(range(128, 256))), 1):
    _CLASS[list(_bytes)] = _c
N_CLASSES = 9
N_STATS = N_CLASSES + 8


def features(texts: list[bytes], declared: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each entry, its cell, its value, statistics of each text)."""
    n = len(texts)
    words = Words(texts, WORD_BYTES)
    cell = (words.hash >> np.uint64(51)).astype(np.int64)
    both, counts = np.unique(words.text * CELLS + cell, return_counts=True)
    owner, cell = both // CELLS, both % CELLS
    value = np.log1p(counts)
    norm = np.sqrt(np.bincount(owner, value * value, minlength=n))
    value = value / norm[owner]
    sizes = np.fromiter((len(t) for t in texts), np.int64, n)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    shares = np.bincount(np.repeat(np.arange(n), sizes) * N_CLASSES + _CLASS[raw], minlength=n * N_CLASSES).reshape(n, N_CLASSES) / np.maximum(sizes, 1)[:, None]
    n_words = words.last - words.first
    distinct = np.bincount(owner, minlength=n) / np.maximum(np.minimum(n_words, CELLS), 1)
    length = np.bincount(words.text, words.end - words.start, minlength=n) / np.maximum(n_words, 1)
    lines = np.array([(len(x), len(set(x))) for x in ([y for y in t.split(b"\n") if y] for t in texts)], float).reshape(n, 2)
    said = np.array([len(t) if d is None else d for t, d in zip(texts, declared, strict=True)], float)
    stats = np.column_stack([shares, np.log1p(n_words), distinct, length, np.log1p(lines[:, 0]), 1 - lines[:, 1] / np.maximum(lines[:, 0], 1), np.log1p(sizes / np.maximum(lines[:, 0], 1)), np.log1p(np.maximum(said, 0)), (sizes == 0).astype(float)])
    return owner, cell, value.astype(np.float32), stats.astype(np.float32)


class Machine:
    """Weights over CELLS hashed words and N_STATS statistics, which are centred, scaled and held within +-4."""

    def __init__(self, rank: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.b = 0.0
        self.w = np.zeros(CELLS + N_STATS, np.float32)
        self.v = rng.normal(0, 0.02, (CELLS + N_STATS, rank)).astype(np.float32)
        self.mean, self.scale = np.zeros(N_STATS, np.float32), np.ones(N_STATS, np.float32)

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4) / np.float32(np.sqrt(N_STATS))

    def raw(self, owner: np.ndarray, cell: np.ndarray, value: np.ndarray, stats: np.ndarray) -> np.ndarray:
        n, s = len(stats), self.scaled(stats)
        out = self.b + np.bincount(owner, self.w[cell] * value, minlength=n) + s @ self.w[CELLS:]
        for f in range(self.v.shape[1]):
            part = self.v[cell, f] * value
            own = self.v[CELLS:, f]
            total = np.bincount(owner, part, minlength=n) + s @ own
            squares = np.bincount(owner, part * part, minlength=n) + (s * s) @ (own * own)
            out += 0.5 * (total * total - squares)
        return out

    def score(self, *x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*x), -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, label: np.ndarray, epochs: int = 14, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> None:
        """Adam on the log loss. rows: (cells, values) of each text."""
        self.mean, self.scale = stats.mean(0), np.maximum(stats.std(0), 1e-3)
        s = self.scaled(stats)
        rng = np.random.default_rng(seed)
        share = np.clip(label.mean(), 0.01, 0.99)
        self.b = float(np.log(share / (1 - share)))
        slots = [np.zeros_like(self.w), np.zeros_like(self.w), np.zeros_like(self.v), np.zeros_like(self.v), 0.0, 0.0]
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for a in range(0, len(order), batch):
                own = order[a : a + batch]
                x = np.zeros((len(own), CELLS + N_STATS), np.float32)
                for i, r in enumerate(own):
                    x[i, rows[r][0]] = rows[r][1]
                x[:, CELLS:] = s[own]
                total = x @ self.v
                raw = self.b + x @ self.w + 0.5 * ((total * total).sum(1) - (x * x) @ (self.v * self.v).sum(1))
                g = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[own]) / len(own)).astype(np.float32)
                grad_w = x.T @ g + decay * self.w
                grad_v = x.T @ (g[:, None] * total) - self.v * ((x * x).T @ g)[:, None] + decay * self.v
                t += 1
                fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                for value, grad, k in ((self.w, grad_w, 0), (self.v, grad_v, 2)):
                    slots[k] = 0.9 * slots[k] + 0.1 * grad
                    slots[k + 1] = 0.999 * slots[k + 1] + 0.001 * grad * grad
                    value -= (rate * fix * slots[k] / (np.sqrt(slots[k + 1]) + 1e-8)).astype(np.float32)
                self.b -= rate * float(g.sum())


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of doc_id as text, mod 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> Machine | None:
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("label_id"))
    usable = usable.agg(F.min("quality").cast("double").alias("label"), F.max("quality").cast("double").alias("other")).where("label = other").drop("other")
    n = usable.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64("label_id"), F.lit(1_000_003)) / 1_000_003.0
    sample = usable.where(draw < min(1.0, max_rows / n))
    # About max_rows rows of two numbers, whatever the size of the tables.
    rows = docs.select("doc_id", "text", "n_chars").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("text", "n_chars", "label", "label_id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, "text"):
            owner, cell, value, stats = features(texts, batch.column(1).to_pylist())
            cut = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(2), pa.ListArray.from_arrays(pa.array(cut), pa.array(cell.astype(np.int32))), pa.ListArray.from_arrays(pa.array(cut), pa.array(value)), pa.array(list(stats), pa.list_(pa.float32()))], ["id", "label", "cell", "value", "stats"])

    kind = T.StructType([rows.schema["label_id"], T.StructField("label", T.DoubleType()), T.StructField("cell", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.FloatType())), T.StructField("stats", T.ArrayType(T.FloatType()))])
    kind.fields[0] = T.StructField("id", kind.fields[0].dataType)
    kind = T.StructType(kind.fields)
    got = rows.mapInArrow(make, kind).toArrow().sort_by("id")
    if not got.num_rows:
        return None
    cells, values = got.column("cell").combine_chunks(), got.column("value").combine_chunks()
    machine = Machine()
    machine.fit([(cells[i].values.to_numpy(), values[i].values.to_numpy()) for i in range(got.num_rows)], np.array(got.column("stats").to_pylist(), np.float32), got.column("label").to_numpy())
    return machine


def scores(docs: DataFrame, machine: Machine | None, threshold: float = 0.7) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # (CELLS + N_STATS) x (rank + 1) numbers
    rows = docs.select("doc_id", "text", "n_chars")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch, texts in steps(batches, "text"):
            made = np.full(len(texts), 0.5) if own is None else own.score(*features(texts, batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.asarray(made, np.float64))], ["doc_id", "score"])

    found = rows.mapInArrow(make, T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(docs, fit(docs, labels))
