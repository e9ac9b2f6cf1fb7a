"""Operator 12, packing: documents' ids in a row, cut into sequences of a fixed length.

Two passes and no shuffle of ids. The first encodes each partition's documents as they come, each with its end id, and writes
(doc_id, part, before, n_tokens, ids): ``part`` is the partition's number and ``before`` the ids ahead in it. Sums over the
partitions' totals, one row a partition, then say where each begins in the row of all ids; so every id has a global
offset, and sequence k holds the ids from k * length on. The second pass reads the files and cuts at those offsets.
A task emits the windows that it holds whole, with a record for each piece of a document in them; where two tasks meet, each
emits its part of the window, and ``sequences`` joins these parts. Only the very last sequence is padded, and it isn't
where its length is a power of two.

The byte-level split never takes a piece over white space that follows other characters, so a worker encodes each kind of
chunk once (``chunks``). Tokenizer files with a normaliser, another split or words beside the vocabulary that hold white
space are given whole texts.

Defined results: a null or empty text is its end id alone; null and repeated doc_ids are rows like others; an empty table
gives no rows; other columns are ignored. The order of documents is that of the table's partitions, so it can change
with them; within one call it is fixed, as the second pass reads what the first has written.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import KEEP, ByteLevel, cut
from .common import new_path, steps, written

LENGTH = 2048
#: Up to so many partitions (three numbers each) their table is sent to all tasks; beyond, it is joined by shuffle.
MAX_BROADCAST_PARTS = 1_000_000
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of texts as bytes of little-endian 32-bit numbers."""

    def __init__(self, path: str):
        self.level = ByteLevel(path, special=True)
        self.kept: dict[str, bytes] = {}

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        plain = [t.decode("utf-8", "replace") for t in texts]
        if not self.level.by_chunks:
            return [self.level.ids(t) for t in plain]
        cuts = [cut(t) for t in plain]
        if len(self.kept) > KEEP:
            self.kept.clear()
        new = list(set().union(*cuts).difference(self.kept))
        self.kept.update(zip(new, self.level.of_chunks(new), strict=True))
        return [b"".join(map(self.kept.__getitem__, c)) for c in cuts]


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """First pass: (doc_id, part, before, n_tokens, ids) as files in the shared folder."""
    docs = docs.select("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, part, total = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for rows, texts in steps(batches, "text"):
            made = [x + end for x in one(texts)]
            sizes = np.fromiter((len(x) // 4 for x in made), np.int64, len(made))
            ends = np.cumsum(sizes)
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(np.frombuffer(b"".join(made), np.int32)))
            columns = [rows.column(0), pa.array(np.full(len(made), part, np.int32)), pa.array(total + ends - sizes), pa.array(sizes), ids]
            total += int(ends[-1])
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "before", "n_tokens", "ids"])

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("part int, before long, n_tokens long, ids array<int>").fields])
    out = new_path(docs.sparkSession, "packing")
    docs.mapInArrow(run, schema).write.option("compression", "zstd").parquet(out)
    return docs.sparkSession.read.schema(schema).parquet(out)


def placed(tokens: DataFrame, max_broadcast: int = MAX_BROADCAST_PARTS) -> DataFrame:
    """(doc_id, n_tokens, ids, spot): ``spot`` is the number of ids of all documents before."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row a partition goes through this window.
    spots = written(totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("first")), "packing-parts")
    if spots.count() <= max_broadcast:
        spots = F.broadcast(spots)
    return tokens.join(spots, "part").select("doc_id", "n_tokens", "ids", (F.col("first") + F.col("before")).alias("spot"))


def window_parts(spotted: DataFrame, length: int = LENGTH) -> DataFrame:
    """Second pass: (sequence_id, offset, length, ids, pieces). A row is what one task holds of a window: all of it, or where
    tasks meet a part from ``offset`` on. ``ids`` are little-endian 32-bit numbers, ``pieces`` say which documents they are of."""
    piece = T.StructType([spotted.schema["doc_id"], *T.StructType.fromDDL("start long, length long, offset long, doc_tokens long").fields])
    schema = T.StructType([*T.StructType.fromDDL("sequence_id long, offset long, length long, ids binary").fields, T.StructField("pieces", T.ArrayType(piece))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = first = at = None
        held: list[bytes] = []
        pieces: list[tuple] = []
        rows: list[tuple] = []
        kind = None

        def close() -> None:
            nonlocal held, pieces
            if held:
                rows.append((sequence, first, at - first, b"".join(held), [dict(zip(("doc_id", "start", "length", "offset", "doc_tokens"), p, strict=True)) for p in pieces]))
            held, pieces = [], []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), kind), strict=True)], ["sequence_id", "offset", "length", "ids", "pieces"])
            rows.clear()
            return made

        for batch in batches:
            names = ("doc_id", "start", "length", "offset", "doc_tokens")
            kind = pa.list_(pa.struct([pa.field(n, batch.schema.field("doc_id").type if n == "doc_id" else pa.int64()) for n in names]))
            lists = batch.column(2)
            for doc, n, ids, spot in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), lists, batch.column(3).to_pylist(), strict=True):
                raw = ids.values.to_numpy().astype("<u4", copy=False).tobytes()
                done = 0
                while done < n:
                    k, offset = divmod(spot + done, length)
                    if (k, offset) != (sequence, at):
                        close()
                        sequence, first = k, offset
                    take = min(length - offset, n - done)
                    held.append(raw[4 * done : 4 * (done + take)])
                    pieces.append((doc, done, take, offset, n))
                    done, at = done + take, offset + take
                    if at == length:
                        close()
                        sequence = None
                        if len(rows) >= 1024:
                            yield out()
        close()
        if rows:
            yield out()

    return spotted.mapInArrow(run, schema)


def sequences(parts: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, length, ids, pieces) from window parts: whole windows as they are, the others joined by sequence_id. The
    last one is padded with ``pad_id``, but for a power of two; its ``length`` counts what isn't padding."""
    whole = F.col("length") == length
    ends = parts.where(~whole).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "pieces"))).alias("parts"))
    n: Column = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + F.shiftright(F.length(p["ids"]), 2))
    joined = ends.select("sequence_id", n.alias("length"), F.concat_ws("", F.transform("parts", lambda p: F.hex(p["ids"]))).alias("hex"), F.flatten(F.transform("parts", lambda p: p["pieces"])).alias("pieces"))
    power = F.bit_count("length") == 1
    pad = F.when(power, "").otherwise(F.expr(f"repeat('{struct.pack('<I', pad_id).hex()}', cast({int(length)} - length as int))"))
    joined = joined.select("sequence_id", "length", F.unhex(F.concat("hex", pad)).alias("ids"), "pieces")
    return parts.where(whole).select("sequence_id", "length", "ids", "pieces").unionByName(joined)


def packed(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """The window parts of ``docs`` (doc_id, text)."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return window_parts(placed(encoded(docs, tokenizer, end_id)), length)


def report(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Per piece: where it stands in its document and sequence, and the checksum of the sequence's ids there."""
    parts = packed(docs, tokenizer, end_id, length).select("sequence_id", F.col("offset").alias("first"), "ids", F.explode("pieces").alias("p"))
    own = F.substring(F.col("ids"), ((F.col("p.offset") - F.col("first")) * 4 + 1).cast("int"), (F.col("p.length") * 4).cast("int"))
    return parts.select("p.doc_id", "p.start", "p.length", F.crc32(own).alias("ids_crc32"), "p.doc_tokens", "sequence_id", "p.offset")
