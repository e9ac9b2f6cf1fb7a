"""Operator 5, SimHash near-duplicates over a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two fingerprints with at most three differing bits agree in at least five of the eight
positions. The index has a posting list for each (three positions, their three bytes), for the eight triples that lie
within positions 0-3 or within 4-7: of any five equal positions, three lie in one half, so each such pair meets in a
list. (Lists of single positional bytes would each hold a 256th of all fingerprints.) In a list, the shared positional
bytes of each pair are tallied, pairs with five or more are retained, and their differing bits are counted.

Equal fingerprints are one entry of the index. A list longer than ``block`` is keyed anew by two more positions: linked
fingerprints that share its three bytes share two of the other five, so they meet again in one of ten lists, which are a
65536th as long. One that is still long is cut into blocks by hash, and each pair of blocks is a unit of work of its own, so
no task holds a whole long list; nothing is capped. From a unit, only a spanning forest of its links leaves, never all its
pairs. Components come from alternating star steps.

Defined results: a null or empty text has fingerprint zero and is linked like any other; rows that repeat a doc_id each
get a row; doc_id null counts as the smallest id and is given back as null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import steps, written
from .components import components

NO_ID = -(1 << 63)
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: A list's number: triple, its three bytes, and for a list keyed anew the number of the further pair (from 1) and its bytes.
TRIPLE_AT, BYTES_AT = 44, 20
MAX_BITS, MIN_SHARED = 3, 5
SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> bytes:
    """Eight bytes, most significant first."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        return digest(joined, SEED)
    hashes = b"".join([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)])
    n = len(hashes) // 8
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).view(np.uint64).reshape(n, 8)
    # Byte lanes hold counts up to 255, so so many rows can be added as 64-bit numbers.
    counts = np.add.reduceat(bits, np.arange(0, n, 255), axis=0).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, bits): the fingerprint as a signed long."""
    docs = docs.select("doc_id", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, "text"):
            made = np.frombuffer(b"".join(fingerprint(t, shingle) for t in texts), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], ["doc_id", "bits"])

    return docs.mapInArrow(scan, T.StructType([docs.schema["doc_id"], T.StructField("bits", T.LongType())]))


def _byte(position: int) -> F.Column:
    return F.shiftrightunsigned("bits", 56 - 8 * position).bitwiseAND(F.lit(255))


def postings(entries: DataFrame) -> DataFrame:
    """(list, bits, node): eight rows an entry; the list's number has the triple and its bytes."""
    keys = [F.lit(t).cast("long") * (1 << TRIPLE_AT) + (_byte(a) * (1 << 16) + _byte(b) * (1 << 8) + _byte(c)) * (1 << BYTES_AT) for t, (a, b, c) in enumerate(TRIPLES)]
    return entries.select(F.explode(F.array(*keys)).alias("list"), "bits", "node")


def rekeyed(long_postings: DataFrame) -> DataFrame:
    """(list, bits, node) of long lists: ten rows each, by the pairs of positions that the list's triple leaves."""
    pairs = [list(combinations([p for p in range(8) if p not in t], 2)) for t in TRIPLES]
    of = lambda n: F.array(*[F.array(*[F.lit(x[n]) for x in own]) for own in pairs])
    triple = F.shiftright("list", TRIPLE_AT).cast("int") + 1
    byte = lambda p: F.call_function("shiftrightunsigned", F.col("bits"), 56 - 8 * p).bitwiseAND(F.lit(255))
    both = F.arrays_zip(F.element_at(of(0), triple).alias("a"), F.element_at(of(1), triple).alias("b"))
    further = F.transform(both, lambda x, i: F.col("list") + (i + 1).cast("long") * (1 << 16) + byte(x["a"]) * (1 << 8) + byte(x["b"]))
    return long_postings.select(F.explode(further).alias("list"), "bits", "node")


def _first_triple(differing: np.ndarray) -> np.ndarray:
    """The number of the first triple whose three bytes are all equal; differing: bytes of the XOR, most significant first."""
    equal = differing == 0
    hit = np.stack([equal[..., list(t)].all(-1) for t in TRIPLES], -1)
    return hit.argmax(-1)


def _linked(x: np.ndarray, triple: int) -> np.ndarray:
    """Of XORs: tally the shared positional bytes, retain, verify, and leave the pair to the first list it meets in."""
    differing = np.ascontiguousarray(x.astype(">u8")).view(np.uint8).reshape(*x.shape, 8)
    kept = (differing == 0).sum(-1) >= MIN_SHARED
    kept &= np.bitwise_count(x) <= MAX_BITS
    some = np.nonzero(kept)
    kept[some] = _first_triple(differing[some]) == triple
    return kept


def _forest(bits: np.ndarray, node: np.ndarray, triple: int) -> list[tuple[int, int]]:
    """Links that join what the unit's pairs join, one less than a component has entries."""
    n = len(bits)
    if n == 2:
        return [(int(node[0]), int(node[1]))] if _linked(bits[:1] ^ bits[1:], triple)[0] else []
    out, left = [], np.ones(n, bool)
    near = np.zeros((n, n), bool)
    for a in range(0, n, 64):
        near[a : a + 64] = _linked(bits[a : a + 64, None] ^ bits[None, :], triple)
    for s in range(n):
        if not left[s]:
            continue
        left[s] = False
        front = np.array([s])
        while len(front):
            found = near[front].any(0) & left
            front = np.flatnonzero(found)
            left[front] = False
            out += [(int(node[s]), int(i)) for i in node[front]]
    return out


def _links_of_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (list, one, two, bits, node) come sorted by unit; a unit may go over the end of a batch."""
    held: list[np.ndarray] | None = None
    kind = ["u", "v"]

    def done(columns: list[np.ndarray], upto: int) -> pa.RecordBatch:
        lists, one, two, bits, node = (c[:upto] for c in columns)
        new = np.flatnonzero(np.r_[True, (lists[1:] != lists[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if upto else np.zeros(0, np.int64)
        size = np.diff(np.r_[new, upto])
        out: list[tuple[int, int]] = []
        pair = new[size == 2]
        x = bits[pair] ^ bits[pair + 1] if len(pair) else np.zeros(0, np.uint64)
        for t in np.unique(lists[pair] >> TRIPLE_AT).tolist():
            own = (lists[pair] >> TRIPLE_AT) == t
            at = pair[own][_linked(x[own], t)]
            out += zip(node[at].tolist(), node[at + 1].tolist(), strict=True)
        for a, n in zip(new[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            out += _forest(bits[a : a + n], node[a : a + n], int(lists[a] >> TRIPLE_AT))
        u, v = zip(*out, strict=True) if out else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], kind)

    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        new[3] = new[3].view(np.uint64)
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        if not len(held[0]):
            continue
        last = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[2] == held[2][-1])
        upto = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        yield done(held, upto)
        held = [c[upto:].copy() for c in held]
    if held is not None:
        yield done(held, len(held[0]))


def links(entries: DataFrame, block: int = 512) -> DataFrame:
    """(u, v) of nodes: enough links for the components. Entries: bits (each once), node."""
    long_of = lambda posted, what: written(posted.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > block), what)
    posted = postings(entries)
    long_lists = long_of(posted, "simhash-long")
    if not long_lists.isEmpty():
        # Postings of long lists are few lists' rows; they are written, as they are counted and then dealt.
        again = written(rekeyed(posted.join(long_lists, "list", "left_semi")), "simhash-again")
        posted = posted.join(long_lists, "list", "left_anti").unionByName(again)
        long_lists = long_of(again, "simhash-longer")
    units = posted.select("list", F.lit(0).alias("one"), F.lit(0).alias("two"), "bits", "node")
    if not long_lists.isEmpty():
        dealt = posted.join(long_lists, "list", "left").select("list", "bits", "node", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("bits"), F.col("blocks")).cast("int")
        dealt = dealt.select("list", "bits", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        units = dealt.select("list", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "bits", "node")
    return units.repartition("list", "one", "two").sortWithinPartitions("list", "one", "two").mapInArrow(_links_of_units, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, block: int = 512) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint, component_id."""
    prints = written(fingerprints(docs, shingle).withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))), "simhash")
    # The fingerprint is the node, as texts that only repeat a doc_id have nothing in common.
    entries = written(prints.groupBy("bits").agg(F.min("id").alias("id")).withColumn("node", F.col("bits")), "simhash-entries")
    found = components(links(entries.select("bits", "node"), block))
    named = entries.join(found, "node", "left").select(F.col("bits").alias("own_bits"), "id", F.coalesce("component", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("id").alias("component"))
    named = named.join(smallest, "root").select("own_bits", "component")
    component = F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id")
    return prints.join(named, F.col("bits") == F.col("own_bits")).select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), component)
