"""Operator 11, cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes of a text.

Each text, with a space before it, is encoded by both. A token's row in its incidence matrix has a one for each of its bytes;
matrices are kept as compressed sparse rows built by hand. Row by row (Gustavson), A times the transpose of B counts the bytes
that two tokens share: its entries are the overlap links. Offsets where tokens of both end cut all tokens into groups, and the
product of the tokens' group incidences has an entry for each pair of one group: the shared-group links. The report's
links are overlap links whose ends meet. Products are made for the texts of a step together, as no group goes over a text's end.
Long texts are encoded in parts, cut where neither tokenizer looks over the cut (``chunks``).

How often two ids are linked in all texts is counted per task and summed. Of two tokens that end together one is the end of the
other, so no more kinds of pairs can come than the vocabularies' tokens have bytes (some hundred thousand), whatever the corpus;
the counts' table is sent to the tasks while it has ``MAX_PAIRS`` rows at most, and joined by shuffle beyond.

Defined results: a null or empty text, one that isn't valid UTF-8, or one whose tokens' bytes aren't the text's (a "▁" in it, for
one) has no tokens, all numbers 0 and groups ''; null and repeated doc_ids are rows like others; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import CUT, ByteLevel, pieces_allow
from .common import small_batches, steps, written

MAX_PAIRS = 2_000_000
#: Bytes of text that are aligned together; a longer text is a step of its own, and goes part by part.
STEP = 1 << 18
#: Characters that are encoded together.
PART = 1 << 16
#: Ones of a matrix that one step of a product goes through.
BLOCK = 1 << 21
_aligners: dict[tuple[str, str], "Aligner"] = {}


class Csr(NamedTuple):
    """A sparse matrix: row i has values ``data`` at columns ``indices``, from indptr[i] to indptr[i + 1]."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    width: int

    @classmethod
    def of(cls, per_row: np.ndarray, indices: np.ndarray, width: int) -> "Csr":
        return cls(np.r_[0, np.cumsum(per_row)], indices, np.ones(len(indices), np.int64), width)


def product(a: Csr, b: Csr) -> Csr:
    """a times b: each row is the sum of the rows of b that the row's ones name."""
    sizes, columns, values = [], [], []
    n, first = len(a.indptr) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(a.indptr, a.indptr[first] + BLOCK, "right")) - 1)
        own = slice(a.indptr[first], a.indptr[last])
        named = a.indices[own]
        per = np.diff(b.indptr)[named]
        row = np.repeat(np.arange(last - first), np.diff(a.indptr[first : last + 1]))
        at = np.repeat(b.indptr[named] - np.cumsum(per) + per, per) + np.arange(per.sum())
        key = np.repeat(row, per) * b.width + b.indices[at]
        made = np.repeat(a.data[own], per) * b.data[at]
        if len(key) and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, made = key[order], made[order]
        new = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        sizes.append(np.bincount(key[new] // b.width, minlength=last - first))
        columns.append(key[new] % b.width)
        values.append(np.add.reduceat(made, new) if len(new) else made)
        first = last
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return Csr(np.r_[0, np.cumsum(join(sizes))], join(columns), join(values), b.width)


class Alignment:
    """Tokens of two tokenizers over the same bytes, given by their lengths."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.end_a, self.end_b = np.cumsum(a), np.cumsum(b)
        n = int(self.end_a[-1]) if len(a) else 0
        every = np.arange(n)
        #: Tokens of A by bytes, and bytes by tokens of B.
        self.bytes_a = Csr.of(a, every, n)
        self.bytes_b = Csr.of(np.ones(n, np.int64), np.repeat(np.arange(len(b)), b), len(b))
        # Where both end, by offset; and how many such offsets there are up to each.
        both = np.zeros(n + 1, bool)
        both[self.end_a] = True
        meet = both[self.end_b]
        self.ends = self.end_b[meet]
        self.n_groups = len(self.ends)
        both[self.end_a] = False
        both[self.ends] = True
        upto = np.cumsum(both, dtype=np.int32)
        self.group_a, self.group_b = upto[self.end_a - 1], upto[self.end_b - 1]

    def overlaps(self) -> Csr:
        """Tokens of A by tokens of B: the bytes that they share."""
        return product(self.bytes_a, self.bytes_b)

    def ending_together(self) -> tuple[np.ndarray, np.ndarray]:
        """Token of A and token of B for each overlap link whose ends meet."""
        links = self.overlaps()
        row = np.repeat(np.arange(len(self.end_a)), np.diff(links.indptr))
        meet = self.end_a[row] == self.end_b[links.indices]
        return row[meet], links.indices[meet]

    def shared_groups(self) -> Csr:
        """Tokens of A by tokens of B: one where they are of the same group."""
        own = Csr.of(np.ones(len(self.end_a), np.int64), self.group_a, self.n_groups)
        members = Csr.of(np.bincount(self.group_b, minlength=self.n_groups), np.arange(len(self.end_b)), len(self.end_b))
        return product(own, members)


class Aligner:
    """Two tokenizers, and the alignment of what they make of texts."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = ByteLevel(a_path, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = [self.a.lengths, np.array([len(x) for x in b_bytes], np.int64)]
        #: All tokens' bytes in a row, and where each token's begin.
        self.spelled = [np.frombuffer(b"".join(x), np.uint8) for x in (self.a.bytes_of, b_bytes)]
        self.spots = [np.cumsum(n) - n for n in self.lengths]
        # Ids as decimal texts with what may stand behind them.
        self.names = [{end: np.array([f"{i}{end}" for i in range(len(n))], object) for end in ends} for n, ends in zip(self.lengths, (",|", ",;\n"), strict=True)]
        self.by_parts = self.a.by_chunks and len(self.b.encode("a")) == 1 and pieces_allow(pieces)

    def parts(self, text: str) -> list[str]:
        """A text in parts of about PART characters, cut where neither tokenizer's ids depend on the other side."""
        made, first = [], 0
        while self.by_parts and len(text) - first > 2 * PART and (m := CUT.search(text, first + PART)):
            made.append(text[first : m.start()])
            first = m.start()
        return [*made, text[first:]]

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids of A and of B of each text; of one that has no tokens, none."""
        cuts = [self.parts(t.decode()) if t and _valid(t) else [] for t in texts]
        # B puts a space before each text that isn't empty; behind an "a", a part has none.
        of_b = iter(self.b.encode([p if i == 0 else "a" + p for parts in cuts for i, p in enumerate(parts)], num_threads=1))
        made = []
        for parts in cuts:
            a = b"".join(self.a.latin(p if i else " " + p) for i, p in enumerate(parts))
            b = b"".join(np.array(ids[1:] if i else ids, "<i4").tobytes() for i, ids in zip(range(len(parts)), of_b))  # noqa: B905
            made.append((a, b))
        return self._right(texts, made)

    def _right(self, texts: list[bytes], encoded: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
        """``encoded``, with none for texts whose tokens' bytes aren't theirs."""
        whole = np.frombuffer(b"".join(b" " + t for t in texts), np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        right = np.array([len(x) > 0 and len(y) > 0 for x, y in encoded], bool)
        for side in (0, 1):
            ids = np.frombuffer(b"".join(x[side] for x in encoded), "<i4")
            per = np.array([len(x[side]) // 4 for x in encoded], np.int64)
            right &= np.diff(np.r_[0, np.cumsum(self.lengths[side][ids])][np.cumsum(per)], prepend=0) == sizes
            here = np.repeat(right, sizes)
            differ = self.bytes_of(side, ids[np.repeat(right, per)]) != whole[here]
            right[np.repeat(np.arange(len(texts)), sizes)[here][differ]] = False
        return [x if ok else (b"", b"") for x, ok in zip(encoded, right, strict=True)]

    def bytes_of(self, side: int, ids: np.ndarray) -> np.ndarray:
        n = self.lengths[side][ids]
        return self.spelled[side][np.repeat(self.spots[side][ids] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def align(self, texts: list[bytes]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups and n_links of each text, groups_sha256 of each; and all links' ids in a row."""
        if len(texts) == 1 and len(texts[0]) > 2 * PART and self.by_parts and _valid(texts[0]):
            return self._align_long(texts[0].decode())
        numbers, names, a, b = self._aligned(self.encode(texts))
        groups = np.full(len(texts), "", object)
        groups[numbers[:, 0] > 0] = [hashlib.sha256(x.encode()).hexdigest() for x in names]
        return numbers, groups.tolist(), a, b

    def _align_long(self, text: str) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """One text, part by part: no group goes over the end of one."""
        total, groups, links = np.zeros((1, 4), np.int64), hashlib.sha256(), []
        for i, part in enumerate(self.parts(text)):
            pair = self._ids_of(i, part)
            if any(self.bytes_of(side, np.frombuffer(x, "<i4")).tobytes() != ("" if i else " ").encode() + part.encode() for side, x in enumerate(pair)):
                return np.zeros((1, 4), np.int64), [""], np.zeros(0, np.int32), np.zeros(0, np.int32)
            numbers, names, *own = self._aligned([pair])
            total += numbers
            groups.update((";" if i else "").encode() + names[0].encode())
            links.append(own)
        return total, [groups.hexdigest()], *(np.concatenate(x) for x in zip(*links, strict=True))

    def _ids_of(self, i: int, part: str) -> tuple[bytes, bytes]:
        """Ids of A and of B of a text's part number ``i``."""
        ids = self.b.encode("a" + part)[1:] if i else self.b.encode(part)
        return self.a.latin(part if i else " " + part), np.array(ids, "<i4").tobytes()

    def _aligned(self, encoded: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups and n_links of each text; the groups of those that have tokens; all links' ids in a row."""
        ids = [np.frombuffer(b"".join(x[side] for x in encoded), "<i4") for side in (0, 1)]
        found = Alignment(*(n[x] for n, x in zip(self.lengths, ids, strict=True)))
        # A text's end is a common one, so groups and links are of one text.
        sizes = np.array([(len(x) // 4, len(y) // 4) for x, y in encoded], np.int64).reshape(-1, 2)
        ends = np.r_[0, found.end_a][np.cumsum(sizes[:, 0])]
        row, column = found.ending_together()
        upto = np.c_[np.searchsorted(found.ends, ends, "right"), np.searchsorted(found.end_a[row], ends, "right")]
        numbers = np.c_[sizes, np.diff(upto, axis=0, prepend=0)]
        return numbers, self._groups(found, ids, ends), ids[0][row], ids[1][column]

    def _groups(self, found: Alignment, ids: list[np.ndarray], ends: np.ndarray) -> list[str]:
        """The groups of each text that has tokens: those of A and of B in turn, each id with the sign behind it."""
        if not len(ids[0]):
            return []
        a_sign, b_sign = self.names
        last_a, last_b = (np.diff(g, append=-1) != 0 for g in (found.group_a, found.group_b))
        of_a = np.where(last_a, a_sign["|"][ids[0]], a_sign[","][ids[0]])
        of_b = np.where(last_b, b_sign[";"][ids[1]], b_sign[","][ids[1]])
        closing = np.searchsorted(found.end_b, np.unique(ends[ends > 0]))
        of_b[closing] = b_sign["\n"][ids[1][closing]]
        row = np.empty(len(of_a) + len(of_b), object)
        # Before a token of A stand the B tokens of earlier groups, before one of B the A tokens up to its own.
        row[np.arange(len(of_a)) + np.searchsorted(found.group_b, found.group_a, "left")] = of_a
        row[np.arange(len(of_b)) + np.searchsorted(found.group_a, found.group_b, "right")] = of_b
        return "".join(row.tolist()).split("\n")[:-1]


def _valid(text: bytes) -> bool:
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return True


def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def paths(a: str | None, b: str | None) -> tuple[str, str]:
    if a and b:
        return a, b
    import public_tokenizers

    return a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")


def aligned(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """(doc_id, row, n_a, n_b, n_groups, groups_sha256, link_a, link_b): ids of the linked tokens in a row; ``row`` is unique."""
    a_path, b_path = paths(a, b)
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("row long, n_a long, n_b long, n_groups long, groups_sha256 string, link_a array<int>, link_b array<int>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = aligner(a_path, b_path)
        for part, texts in steps(batches, "text", STEP):
            numbers, groups, *links = one.align(texts)
            cuts = pa.array(np.r_[0, np.cumsum(numbers[:, 3])].astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in links]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(numbers[:, i]) for i in range(3)), pa.array(groups, pa.string()), *lists], schema.names)

    return rows.mapInArrow(run, schema)


def all_links(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """(doc_id, a_ids, b_ids, overlaps, shared): overlap links (place of the token in A, in B, bytes shared) and shared-group
    links (place in A, in B) of each text. A group's links are the product of its sizes."""
    a_path, b_path = paths(a, b)
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("a_ids array<int>, b_ids array<int>, overlaps array<struct<a: int, b: int, bytes: int>>, shared array<struct<a: int, b: int>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = aligner(a_path, b_path)
        for part, texts in steps(batches, "text", STEP):
            for i, pair in enumerate(one.encode(texts)):
                x, y = (np.frombuffer(ids, "<i4") for ids in pair)
                found = Alignment(one.lengths[0][x], one.lengths[1][y])
                made = []
                for links, names in ((found.overlaps(), ("a", "b", "bytes")), (found.shared_groups(), ("a", "b"))):
                    row = np.repeat(np.arange(len(x)), np.diff(links.indptr))
                    fields = [pa.array(v.astype(np.int32)) for v in (row, links.indices, links.data)[: len(names)]]
                    made.append(pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), pa.StructArray.from_arrays(fields, names)))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(i, 1), pa.array([x], pa.list_(pa.int32())), pa.array([y], pa.list_(pa.int32())), *made], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` links."""
    for batch in batches:
        total = np.cumsum(batch.column(batch.schema.get_field_index("link_a")).value_lengths().to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + most, "right")))
            yield batch.slice(first, last - first)
            first = last


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, n, best): how often two ids are linked in all texts, and whether no id of A is linked with b more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

        def merge() -> None:
            nonlocal held
            found, place = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(place, np.concatenate(counts), len(found)).astype(np.int64)
            keys[:], counts[:], held = [found], [total], 0

        for batch in _slices(batches):
            flat = [batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (0, 1)]
            found, n = np.unique(flat[0].astype(np.int64) << 32 | flat[1], return_counts=True)
            keys.append(found)
            counts.append(n)
            held += len(found)
            if held > 1 << 20:
                merge()
        merge()
        if len(keys[0]):
            yield pa.RecordBatch.from_arrays([pa.array((keys[0] >> 32).astype(np.int32)), pa.array((keys[0] & 0xFFFFFFFF).astype(np.int32)), pa.array(counts[0])], ["a", "b", "n"])

    summed = links.select("link_a", "link_b").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return summed.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy("b")))


def scored(links: DataFrame, counts: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """``links`` with n_links, n_best and count_sum in place of the lists."""
    if counts.count() > max_pairs:
        each = links.select("row", F.explode(F.arrays_zip(F.col("link_a").alias("a"), F.col("link_b").alias("b"))).alias("l")).select("row", "l.a", "l.b")
        sums = each.join(counts, ["a", "b"]).groupBy("row").agg(F.count("*").alias("n_links"), F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum"))
        zero = {c: 0 for c in ("n_links", "n_best", "count_sum")}
        return links.drop("link_a", "link_b").join(sums, "row", "left").fillna(zero).drop("row")
    table = counts.toArrow().sort_by([("a", "ascending"), ("b", "ascending")])
    key, n, best = (table.column(c).to_numpy() for c in ("b", "n", "best"))
    key = table.column("a").to_numpy().astype(np.int64) << 32 | key.astype(np.int64)
    sent = links.sparkSession.sparkContext.broadcast((key, n, best.astype(np.int64)))
    names = [c for c in links.columns if c not in ("link_a", "link_b", "row")]
    schema = T.StructType([*(links.schema[c] for c in names), *T.StructType.fromDDL("n_links long, n_best long, count_sum long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, best = sent.value
        for batch in _slices(batches):
            of = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            flat = [of(c).flatten().to_numpy(zero_copy_only=False) for c in ("link_a", "link_b")]
            at = np.searchsorted(key, flat[0].astype(np.int64) << 32 | flat[1])
            ends = np.cumsum(of("link_a").value_lengths().to_numpy(zero_copy_only=False))
            made = []
            for values in (np.ones(len(at), np.int64), best[at], n[at]):
                made.append(pa.array(np.diff(np.r_[0, np.r_[0, np.cumsum(values)][ends]]), pa.int64()))
            yield pa.RecordBatch.from_arrays([*(of(c) for c in names), *made], schema.names)

    return links.mapInArrow(run, schema)


def report(docs: DataFrame, a: str | None = None, b: str | None = None, max_pairs: int = MAX_PAIRS) -> DataFrame:
    with small_batches(docs.sparkSession):
        links = written(aligned(docs, a, b), "token-links")
        counts = written(pair_counts(links), "token-link-counts")
        return written(scored(links, counts, max_pairs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "token-links-report")
