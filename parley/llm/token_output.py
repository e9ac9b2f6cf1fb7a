"""Operator 6, token-ID files: Parquet list columns with chosen encodings, row groups and page indexes.

Documents are range-partitioned by doc_id and encoded where they land; each document ends with the end id. The files hold
doc_id, n_tokens and the list ``ids``: numbers of documents ascend, so they are delta-encoded (format version 2 pages),
and ids go through a dictionary as far as it fits a page. Row groups and pages have set sizes and Spark's writer adds
column and offset indexes, so a read of doc_id and n_tokens, or of a range of documents, skips the lists' pages.

Words are encoded by the tokenizers library. The vocabulary lower-cases, drops white space and never merges over it, nor over
the bound between a letter and the signs behind it, so a text's ids are those of its white-space-separated chunks in a row,
with such signs as chunks of their own. Each worker keeps what chunks it has encoded, up to ``KEEP`` of them, and starts
afresh beyond. This is so for the normaliser and the split of PLAIN; with a tokenizer file that has others, texts are encoded
whole.

Defined results: a null or empty text is the end id alone; null doc_ids come first; rows that repeat a doc_id all stay and
are laid in the order of their texts' hashes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, partitions_for, steps, written

KEEP = 500_000
# The normaliser and the split that chunks may be taken by.
PLAIN = (["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Signs behind a letter of ASCII, up to the chunk's end: a piece of their own. (A set first, which is looked for fast.)
SIGNS = re.compile(rb"[.,!?;:%*$#&](?<=[A-Za-z].)[.,!?;:%*$#&]*(?=[\x09-\x0d ]|\Z)", re.S)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_encoders: dict[str, "ChunkEncoder"] = {}


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class ChunkEncoder:
    """Ids of a text by its chunks, as bytes of little-endian 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.chunks: dict[bytes, bytes] = {}
        self.plain = self._is_plain()

    def _is_plain(self) -> bool:
        told = json.loads(self.tokenizer.to_str())
        steps_of = lambda k, inner: (told[k] or {}).get(inner, [told[k] or {}])
        names = [x.get("type") for x in steps_of("normalizer", "normalizers")]
        splits = [x for x in steps_of("pre_tokenizer", "pretokenizers")]
        pattern = splits[0].get("pattern", {}).get("Regex") if [x.get("type") for x in splits] == ["Split", "ByteLevel"] else None
        # Special tokens are found in the text as it is: those that white space or signs could cut, or case could hide, have a "<".
        return (names, pattern) == PLAIN and told["model"]["type"] == "BPE" and all(t["content"].startswith("<") and not set(t["content"]) & set(" .,!?;:%*$#&") for t in told["added_tokens"])

    def _whole(self, text: str) -> bytes:
        return pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _miss(self, raw: bytes) -> bytes:
        spelled = None
        if raw.isalpha():  # of ASCII
            spelled = raw.decode().lower()
        else:
            chunk = raw.decode("utf-8", "replace")
            if chunk.isalpha() and max(chunk) <= "\xff":
                spelled = self.spell(chunk.lower())[0][0]
        # Letters of ASCII or Latin-1 are one piece, so the model can have it as it is.
        ids = self._whole(chunk) if spelled is None else pack([t.id for t in self.model.tokenize(spelled)])
        if len(self.chunks) >= KEEP:
            self.chunks.clear()
        self.chunks[raw] = ids
        return ids

    def __call__(self, text: bytes) -> bytes:
        if not self.plain:
            return self._whole(text.decode("utf-8", "replace"))
        # Case is folded early, for fewer kinds of chunks, but where a special token may stand, or a mark that the letter
        # before it is composed with (U+0300 to U+036F).
        if b"<" not in text and b"\xcc" not in text and b"\xcd" not in text:
            text = text.translate(_LOWER)
        get, miss = self.chunks.get, self._miss
        # bytes.split() cuts at ASCII white space only; the rest is the tokenizer's to see.
        return b"".join([get(c) or miss(c) for c in SIGNS.sub(rb" \g<0>", text).split()])


def encoder(path: str) -> ChunkEncoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Writes ``docs`` (doc_id, text) to ``out`` in doc_id order; files ascend with their names."""
    docs = docs.select("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(tokenizer)
        for part, texts in steps(batches, "text"):
            made = [one(x) + end for x in texts]
            sizes = np.fromiter((len(x) // 4 for x in made), np.int32, len(made))
            values = pa.array(np.frombuffer(b"".join(made), np.int32))
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), ids], ["doc_id", "n_tokens", "ids"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    # Texts of equal (or no) doc_ids go by their hash and length: no range has all of them, and files are the same on every run.
    order = [F.col("doc_id"), F.xxhash64("text"), F.length("text")]
    n = partitions_for(docs)
    many = n > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.repartitionByRange(n, *order) if many else docs.repartitionByRange(*order)).sortWithinPartitions(*order)
    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false", "compression": "zstd", "parquet.page.write-checksum.enabled": "true"}
    ordered.mapInArrow(encode, schema).write.options(**{k: str(v) for k, v in options.items()}).parquet(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files, with ``start``: ids of all documents before."""
    files = spark.read.parquet(path)  # its schema is in every file, that of an empty table too
    spots = files.select("n_tokens", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    # One row a file: the sum of those before it. Within a file, the running sum is over that file alone.
    sums = written(spots.groupBy("file").agg(F.sum("n_tokens").cast("long").alias("n")), "tokens-files")
    # Part numbers have five digits or, from the 100,000th file on, more: longer names come later.
    before = sums.select("file", (F.sum("n").over(W.orderBy(F.length("file"), "file")) - F.col("n")).alias("before"))
    rows = files.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.join(before, "file")


def checked(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows read from the files, in one pass over each file's rows."""
    base = tokens.select("doc_id", "n_tokens", "ids", "file", "row", "before")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            crcs = [zlib.crc32(ids[i].values.to_numpy().astype("<u4", copy=False).tobytes()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array(crcs, pa.int64()), batch.column(3), batch.column(4), batch.column(5)], ["doc_id", "n_tokens", "ids_crc32", "file", "row", "before"])

    schema = T.StructType([base.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), base.schema["file"], base.schema["row"], base.schema["before"]])
    running = F.sum("n_tokens").over(W.partitionBy("file").orderBy("row")) - F.col("n_tokens")
    return base.mapInArrow(scan, schema).select("doc_id", (F.col("before") + running).cast("long").alias("start"), "n_tokens", "ids_crc32")


def report(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    out = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, out, tokenizer, end_id)
    return checked(read_tokens(docs.sparkSession, out))
