"""Near copies by Jaccard similarity, for the pipeline's stage: operator 5 with longer fingerprints, verified on shingles.

A text is the set of its shingles of ``shingle`` words. At Jaccard 0.8 some 15 % of SimHash bits differ, so of eight-byte
fingerprints no byte is sure to be equal. Here 1024 bits are voted on. A shingle votes for or against each by a Walsh
pattern and a sign that its hash picks, so all votes of a text are one fast Hadamard transform. A vote's sign is a bit of
the fingerprint; the strongest vote in each of 16 blocks of 64, with its sign, is the byte of that position. Strong votes
are those that a few other shingles don't turn: at Jaccard 0.8 a byte is equal with probability 0.44, of unlike texts with
1/128, and 97 % of such pairs share four bytes or more (0.85: 99 %).

Three steps join nodes; in each, pairs of nodes that are joined already are left out, and only pairs whose sets of shingles
are compared and are alike count. Neighbours in two orders of the fingerprints (``neighbours``) join most of a large group by
a few pairs a node. The SimHash index (``candidates``) has a list for each (two positions, their bytes), for the 35 pairs of
positions that lie in the same of three parts: of any four equal positions two lie in one part, so every pair of texts with
MIN_SHARED = 4 shared bytes meets in a list. There the shared bytes are tallied, and pairs with four or more that are near by
128 bits are retained. A list longer than ``block`` is keyed anew by a third position (13 of the other 14, so four shared
bytes still meet), and one that is still long is cut into pairs of blocks. Only spanning forests of its pairs leave a task,
nearest first.

The bytes miss some pairs that are alike, and a forest's pair that is refused may have stood for one that isn't. So the last
step (``missed``) is exact: in any common order of shingles, sets that are alike share one among their first n - ceil(0.8 n) + 1.
Rare ones come first, by counts over a bounded sample (an order only: every set is indexed, and any order is exact). Large
sets are dealt over ``pieces`` by their shingles' hashes; if sets are alike, so are the two sets' shares of some piece, as the
whole ratio is a mean of the pieces'. Only lists that join groups get their pieces' 1024 parity bits. A pair is refused in
its task if sizes, places in the list or these bits, which differ no more often than the sets, leave it no way to be alike;
all others are compared. Where a list has too many the nearest leave first, and the step is repeated on those lists with more
until a round left none behind.

Defined results: texts with equal sets of shingles are one node; texts that are null or have no words are one group; rows
that share a key must have one text; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, byte_table, mixed, steps, written
from .components import components

#: Words are runs of anything but ASCII white space, A-Z lower-cased.
WORD_BYTES = byte_table(bytes(b for b in range(256) if b not in b"\x20\x09\x0a\x0b\x0c\x0d"))
VOTES, CELLS, POSITIONS = 1024, 2048, 16
PARTS = (range(6), range(6, 11), range(11, 16))
PAIRS = [p for part in PARTS for p in combinations(part, 2)]
FIRST, SECOND = (np.array(x) for x in zip(*PAIRS, strict=True))
MIN_SHARED = 4
#: Up to so many nodes their keys are sent to all tasks to find their texts; beyond, texts are joined by shuffle.
MAX_BROADCAST_NODES = 500_000
SYMBOLS, WORDS = ["s0", "s1"], [f"w{i}" for i in range(VOTES // 64)]
#: Of the fingerprint, what a posting carries.
CARRIED = WORDS[:2]
#: Parity bits: bit b says whether an odd number of the set's shingles fall to b.
PARITY = [f"k{i}" for i in range(16)]
#: Shingles that LEAST_COUNT of about SAMPLE texts hold are frequent; of those the MAX_FREQUENT most frequent are known.
SAMPLE, LEAST_COUNT, MAX_FREQUENT = 20_000, 8, 200_000
#: A hash of a shingle has so many bits; the next one marks it as frequent, those above are a level.
HASH_BITS = 44
#: Sets of more shingles are dealt over pieces of 256 to 1024, which the parity bits suffice for.
PIECE = 1024
_LOW, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def shingles(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(where each text's shingles begin, one more than texts; hashes, each text's sorted and distinct).

    A text of fewer words is one shingle. Hashes have 44 bits beside the text's number, which a step has below 2^20."""
    words = Words(texts, WORD_BYTES)
    n_words = words.last - words.first
    count = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), count)
    at = np.repeat(words.first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    made = np.zeros(len(at), np.uint64)
    for j in range(shingle):
        there = at + j < words.last[owner]
        # A place that the text doesn't reach counts as 1, which no word's hash is.
        made = made * np.uint64(0xD6E8FEB86659FD93) + np.where(there, words.hash[np.minimum(at + j, max(0, len(words) - 1))], np.uint64(1)) if len(at) else made
    both = np.unique((owner.astype(np.uint64) << np.uint64(44)) | (mixed(made) >> np.uint64(20)))
    owner, hashes = (both >> np.uint64(44)).astype(np.int64), both & np.uint64((1 << 44) - 1)
    return np.searchsorted(owner, np.arange(len(texts) + 1)), hashes


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the length is a power of two."""
    n, size = x.shape
    h = 1
    while h < size:
        x = x.reshape(n, size // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2)
        h *= 2
    return x.reshape(n, size)


def prints(first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: a hash of its set, the set's size, its 16 symbols as two words, its fingerprint as 16 words."""
    n, sizes = len(first) - 1, np.diff(first)
    owner = np.repeat(np.arange(n), sizes)
    spread = mixed(hashes * np.uint64(0x9E3779B97F4A7C15))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(spread, out=total[1:])
    node = mixed(total[first[1:]] - total[first[:-1]] + sizes.astype(np.uint64))
    cell = (spread % np.uint64(CELLS)).astype(np.int64)
    sign = 1.0 - 2.0 * ((spread >> np.uint64(40)) & np.uint64(1))
    votes = np.empty((n, VOTES), np.float32)
    for a in range(0, n, 256):  # so many texts' votes are held at once
        b = min(n, a + 256)
        own = slice(first[a], first[b])
        sketch = np.bincount((owner[own] - a) * CELLS + cell[own], sign[own], minlength=(b - a) * CELLS)
        votes[a:b] = hadamard(sketch.reshape(b - a, CELLS).astype(np.float32))[:, :VOTES]
    bits = np.packbits(votes > 0, axis=1, bitorder="little").view(np.uint64)
    # Votes of a short text are often equal: ties go by a draw that its least shingle seeds, which near copies mostly share.
    least = np.where(sizes > 0, hashes[np.minimum(first[:-1], max(0, len(hashes) - 1))] if len(hashes) else np.uint64(0), np.uint64(0))
    for a in range(0, n, 256):
        tie = mixed(least[a : a + 256, None] + np.arange(VOTES, dtype=np.uint64)) >> np.uint64(40)
        strength = np.abs(votes[a : a + 256]) + tie.astype(np.float32) * np.float32(0.5 / (1 << 24))
        best = strength.reshape(-1, POSITIONS, VOTES // POSITIONS).argmax(2)
        against = np.take_along_axis(votes[a : a + 256].reshape(-1, POSITIONS, VOTES // POSITIONS), best[..., None], 2)[..., 0] < 0
        part = (best * 2 + against).astype(np.uint8)
        symbols = part if a == 0 else np.concatenate([symbols, part])
    symbols = symbols if n else np.zeros((0, POSITIONS), np.uint8)
    return node, sizes, np.ascontiguousarray(symbols).view(np.uint64), bits


def parity(first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Of each text 1024 parity bits as 16 words: two sets' differ in no more bits than there are shingles in one of them only."""
    n, bits = len(first) - 1, 64 * len(PARITY)
    owner, bit = np.repeat(np.arange(n), np.diff(first)), (mixed(hashes) >> np.uint64(54)).astype(np.int64)
    made = np.zeros((n, len(PARITY)), np.uint64)
    for a in range(0, n, 1024):  # so many texts' counts are held at once
        b = min(n, a + 1024)
        own = slice(first[a], first[b])
        odd = np.bincount((owner[own] - a) * bits + bit[own], minlength=(b - a) * bits) & 1
        made[a:b] = np.packbits(odd.astype(np.uint8).reshape(b - a, bits), axis=1, bitorder="little").view(np.uint64)
    return made


def pieces(first: np.ndarray, hashes: np.ndarray, ratio: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each piece, its level and number, where it begins, one more than pieces; hashes, each piece's in order).

    At level k a set is dealt over 4^k pieces by its shingles' hashes. A set has the levels of all sizes from its own to that
    of the largest set that may be alike, so two alike have one in common: that of the larger."""
    sizes = np.diff(first)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    level = lambda n: np.searchsorted(PIECE * 4 ** np.arange(16), n)
    low, high = level(sizes), level(sizes * ratio.denominator // ratio.numerator)
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for k in range(high.max(initial=-1) + 1):
        at = np.flatnonzero(((low <= k) & (k <= high))[owner])
        number = ((mixed(hashes[at]) >> np.uint64(20)) & np.uint64(4**k - 1)).astype(np.int64)
        held.append((owner[at], k << 32 | number, hashes[at]))
    owner, piece, dealt = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((dealt, piece, owner))
    owner, piece, dealt = owner[order], piece[order], dealt[order]
    begin = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (piece[1:] != piece[:-1])][: len(owner)])
    return owner[begin], piece[begin], np.r_[begin, len(owner)], dealt


def prefixes(first: np.ndarray, hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray, ratio: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(where each text's begin, one more than texts; its rarest shingles in the common order, frequent ones marked): sets
    alike by ``ratio`` share one of them."""
    sizes = np.diff(first)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.minimum(np.searchsorted(frequent, hashes), max(0, len(frequent) - 1))
    known = frequent[at] == hashes if len(frequent) else np.zeros(len(hashes), bool)
    count = np.where(known, counts[at], 0) if len(frequent) else np.zeros(len(hashes), np.int64)
    order = np.lexsort((hashes, count, owner))
    length = np.where(sizes > 0, sizes - -(-sizes * ratio.numerator // ratio.denominator) + 1, 0)
    taken = order[np.arange(len(hashes)) - first[:-1][owner] < length[owner]]
    return np.r_[0, np.cumsum(length)], hashes[taken] | (known[taken].astype(np.uint64) << np.uint64(HASH_BITS))


def frequent_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of shingles that are frequent in a sample of rows. They only order a set's shingles."""
    every = max(1, docs.count() // SAMPLE)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in steps(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(shingles(texts, shingle)[1].view(np.int64))], ["hash"])

    held = docs.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("text").mapInArrow(scan, "hash long")
    counted = held.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)
    rows = counted.orderBy(F.desc("n"), "hash").limit(MAX_FREQUENT).toArrow().sort_by("hash")
    return rows["hash"].to_numpy().view(np.uint64), rows["n"].to_numpy()


def fingerprints(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(key, node, size, symbols, carried words, parity bits, pieces, their parity bits) of each row."""
    names = ["node", "size", *SYMBOLS, *CARRIED, *PARITY]
    ratio = _ratio(similarity)
    known = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, shingle))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in steps(batches, "text"):
            first, hashes = shingles(texts, shingle)
            node, size, symbols, bits = prints(first, hashes)
            made = [node, size, *symbols.T, *bits.T[: len(CARRIED)], *parity(first, hashes).T]
            made = [batch.column(0), *(_longs(x) for x in made)]
            text, piece, first, hashes = pieces(first, hashes, ratio)
            begin, prefix = prefixes(first, hashes, *known.value, ratio)
            # A level's lists are its own.
            prefix |= np.repeat((piece >> 32).astype(np.uint64) << np.uint64(HASH_BITS + 1), np.diff(begin))
            lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), _longs(prefix))
            of_texts = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32))
            for columns in ({"piece": _longs(piece), "size": _longs(np.diff(first)), "prefix": lists}, dict(zip(["piece", *PARITY], map(_longs, [piece, *parity(first, hashes).T]), strict=True))):
                made.append(pa.ListArray.from_arrays(of_texts, pa.StructArray.from_arrays([*columns.values()], [*columns])))
            yield pa.RecordBatch.from_arrays(made, ["key", *names, "pieces", "bits"])

    longs = lambda names: ", ".join(f"{c}: long" for c in names)
    schema = f"{longs(['key', *names])}, pieces: array<struct<piece: long, size: long, prefix: array<long>>>, bits: array<struct<{longs(['piece', *PARITY])}>>"
    return docs.select("key", "text").mapInArrow(scan, schema)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).astype(np.int64, copy=False) if x.dtype != np.uint64 else np.ascontiguousarray(x).view(np.int64))


def _ratio(similarity: float) -> Fraction:
    return Fraction(similarity).limit_denominator(1000)


def tally(x: np.ndarray) -> np.ndarray:
    """How many bytes are equal, of XORs of symbols (two words each): a byte of them is below 128."""
    return POSITIONS - np.bitwise_count((x + _LOW) & _HIGH).sum(-1, dtype=np.int64)


def forest(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Which of the pairs span what all of them join, beyond what ``label`` has joined; updates ``label``."""
    kept = np.zeros(len(i), bool)
    while True:
        one, two = label[i], label[j]
        some = np.flatnonzero(one != two)
        if not len(some):
            return kept
        high, first = np.unique(np.maximum(one, two)[some], return_index=True)
        kept[some[first]] = True
        up = np.arange(len(label))
        up[high] = np.minimum(one, two)[some[first]]
        while (up[up] != up).any():
            up = up[up]
        label[:] = up[label]


def _own(lists: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Whether the list is the first that the pair meets in, so that each pair is some unit's own."""
    pair, third = (lists >> 32).astype(np.int64), (lists >> 24) & 0xFF
    mine = (equal[:, FIRST] & equal[:, SECOND]).argmax(1) == pair
    others = equal.copy()
    rows = np.arange(len(lists))
    others[rows, FIRST[pair]] = others[rows, SECOND[pair]] = False
    return mine & ((third == 0) | (others.argmax(1) == third - 1))


def _by_units(done):
    """Hands ``done`` the rows of whole units, which the first three columns tell apart."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit; a unit may go over the end of a batch."""
        held = None
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            held = rows if held is None else np.concatenate([held, rows])
            if not len(held):
                continue
            other = np.flatnonzero((held[:, :3] != held[-1, :3]).any(1))
            upto = int(other[-1]) + 1 if len(other) else 0
            if upto:
                yield done(held[:upto])
                held = held[upto:].copy()
        if held is not None and len(held):
            yield done(held)

    return scan


def _ends(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its unit's number, and where that unit ends."""
    new = np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1)]
    unit = np.cumsum(new) - 1
    return unit, np.r_[np.flatnonzero(new)[1:], len(rows)][unit]


def _nearest_forest(i: np.ndarray, j: np.ndarray, differ: np.ndarray, groups_: np.ndarray) -> np.ndarray:
    """Which of the pairs span what all of them join beyond the rows' groups, nearest first."""
    chosen, label = np.zeros(len(i), bool), np.unique(groups_, return_inverse=True)[1]
    for d in np.unique(differ):
        left = np.flatnonzero(differ == d)
        chosen[left[forest(i[left], j[left], label)]] = True
    return chosen


def _pair_arrays(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[pa.Array]:
    u, v = rows[i, 3], rows[j, 3]
    return [pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))]


def _pairs_of_units(max_bits: int):
    def done(rows: np.ndarray) -> pa.RecordBatch:
        """Rows (list, one, two, node, group, symbols, words) of whole units."""
        end = _ends(rows)[1]
        symbols, words = (np.ascontiguousarray(rows[:, a:b]).view(np.uint64) for a, b in ((5, 7), (7, 9)))
        found, at, off = [], np.arange(len(rows)), 1
        while len(at := at[at + off < end[at]]):
            near = at[tally(symbols[at] ^ symbols[at + off]) >= MIN_SHARED]
            near = near[rows[near, 4] != rows[near + off, 4]]
            differ = np.bitwise_count(words[near] ^ words[near + off]).sum(1, dtype=np.int64)
            close = differ <= max_bits
            found.append(np.stack([near[close], near[close] + off, differ[close]]))
            off += 1
        i, j, differ = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int64)
        equal = np.ascontiguousarray(symbols[i] ^ symbols[j]).view(np.uint8).reshape(-1, POSITIONS) == 0
        own = _own(rows[i, 0], equal)
        i, j, differ = i[own], j[own], differ[own]
        chosen = _nearest_forest(i, j, differ, rows[:, 4])
        return pa.RecordBatch.from_arrays(_pair_arrays(rows, i[chosen], j[chosen]), ["u", "v"])

    return _by_units(done)


def _missed_of_units(ratio: Fraction, again: int):
    """In round ``again`` a unit of n rows gives 8 n pairs or fewer, or a forest of them and the nearest n 16^again."""
    num, den = ratio.numerator, ratio.denominator

    def done(rows: np.ndarray) -> pa.RecordBatch:
        """Rows (list, one, two, node, group, own, size, place, parity bits) of whole units, by size."""
        unit, end = _ends(rows)
        group, own, size, place = rows[:, 4:8].T
        bits = np.ascontiguousarray(rows[:, 8:]).view(np.uint64)
        found, at, off = [], np.arange(len(rows)), 1
        while len(at := at[at + off < end[at]]):
            at = at[size[at] * den >= size[at + off] * num]  # sizes rise
            a, b = at, at + off
            share = -(-(size[a] + size[b]) * num // (num + den))  # what they must share
            left = (group[a] != group[b]) & (place[a] <= size[a] - share) & (place[b] <= size[b] - share)
            left &= (own[a] != own[b]) | (rows[a, 1] == rows[a, 2])
            a, b, most = a[left], b[left], (size[a] + size[b] - 2 * share)[left]
            differ = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)
            close = differ <= most
            found.append(np.stack([a[close], b[close], differ[close]]).astype(np.int32))
            off += 1
        i, j, differ = np.concatenate(found, 1) if found else np.zeros((3, 0), np.int32)
        rows_of, pairs_of = np.bincount(unit), np.bincount(unit[i], minlength=unit[-1] + 1)
        by = np.lexsort((differ, unit[i]))
        rank = np.empty(len(i), np.int64)
        rank[by] = np.arange(len(i)) - (np.cumsum(pairs_of) - pairs_of)[unit[i[by]]]
        few = (pairs_of <= 8 * rows_of)[unit[i]]
        chosen = few | ((rank < rows_of[unit[i]] * 16**again) if again else False)
        chosen[~few] |= _nearest_forest(i[~few], j[~few], differ[~few], group)
        # A unit that leaves pairs behind gives its nearest one at least, which says so.
        chosen |= rank == 0
        behind = np.bincount(unit[i[~chosen]], minlength=unit[-1] + 1) > 0
        i, j = i[chosen], j[chosen]
        return pa.RecordBatch.from_arrays([*_pair_arrays(rows, i, j), pa.array(rows[i, 0], mask=~behind[unit[i]])], ["u", "v", "behind"])

    return _by_units(done)


def _symbol(p: int) -> Column:
    return F.shiftrightunsigned(SYMBOLS[p // 8], 8 * (p % 8)).bitwiseAND(F.lit(255))


def _further(pair: Column) -> Column:
    """The third parts of the keys that a list of this pair is split by: position + 1 and its byte."""
    of = lambda ps: F.element_at(F.array(*[F.lit(int(p)) for p in ps]), pair + 1)
    rest = F.filter(F.sequence(F.lit(0), F.lit(POSITIONS - 1)), lambda p: (p != of(FIRST)) & (p != of(SECOND)))
    byte = lambda p: F.call_function("shiftrightunsigned", F.when(p < 8, F.col("s0")).otherwise(F.col("s1")), p % 8 * 8).bitwiseAND(F.lit(255))
    return F.transform(F.slice(rest, 1, POSITIONS - 3), lambda p: (p + 1) * (1 << 8) + byte(p))


def _small(joined: DataFrame | None) -> DataFrame | None:
    """To be sent to all tasks where it has few rows, so the other side of a join isn't shuffled."""
    return F.broadcast(joined) if joined is not None and joined.count() <= MAX_BROADCAST_NODES else joined


def _grouped(entries: DataFrame, joined: DataFrame | None) -> DataFrame:
    """Entries with the group (node, component) that they are in so far."""
    if joined is None:
        return entries.withColumn("group", F.col("node"))
    return entries.join(joined, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")


def neighbours(entries: DataFrame, max_bits: int = 34) -> DataFrame:
    """(u, v), u < v, once each: nodes that follow one another in one of two orders of the symbols, share MIN_SHARED bytes and
    differ in at most ``max_bits`` of the first 128."""
    turned = F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.col(x).alias("x"), F.col(y).alias("y")) for i, (x, y) in enumerate([SYMBOLS, SYMBOLS[::-1]])]))
    orders = entries.select(turned, "node", *CARRIED).repartitionByRange("turn", "x", "y").sortWithinPartitions("turn", "x", "y", "node")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4 + len(CARRIED)), np.int64)
        for batch in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)])
            a, b, held = rows[:-1], rows[1:], rows[-1:].copy()
            differ = lambda c: np.ascontiguousarray(a[:, c] ^ b[:, c]).view(np.uint64)
            near = (a[:, 0] == b[:, 0]) & (tally(differ(slice(1, 3))) >= MIN_SHARED)
            near &= np.bitwise_count(differ(slice(4, None))).sum(1, dtype=np.int64) <= max_bits
            u, v = a[near, 3], b[near, 3]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    return orders.select("turn", "x", "y", "node", *CARRIED).mapInArrow(scan, "u long, v long").distinct()


def candidates(entries: DataFrame, max_bits: int = 34, block: int = 1024, joined: DataFrame | None = None) -> DataFrame:
    """(u, v), u < v, once each: they join all pairs of nodes that share MIN_SHARED bytes and differ in at most ``max_bits`` of
    the first 128 and aren't ``joined`` (node, component). Entries: node, symbols, words."""
    # Pair of positions, a byte for the third position and 16 bits below: list = pair << 32 | third << 16 | the two bytes.
    keys = F.array(*[F.struct(F.lit(t).alias("pair"), (_symbol(a) * (1 << 8) + _symbol(b)).alias("bytes")) for t, (a, b) in enumerate(PAIRS)])
    columns = ["node", "group", *SYMBOLS, *CARRIED]
    posted = _grouped(entries, _small(joined)).select(F.inline(keys), *columns)
    # There are 35 x 16384 such lists at most, so this table is small whatever the corpus.
    sizes = written(posted.groupBy("pair", "bytes").agg(F.count("*").alias("n")).where(F.col("n") > block).select("pair", "bytes", F.lit(True).alias("long")), "near-long")
    marked = posted.join(F.broadcast(sizes), ["pair", "bytes"], "left")
    third = F.explode(F.when(F.col("long"), _further(F.col("pair"))).otherwise(F.array(F.lit(0).cast("long"))))
    split = marked.select(third.alias("third"), "pair", "bytes", "long", *columns)
    split = split.select((F.col("pair").cast("long") * (1 << 32) + F.col("third") * (1 << 16) + F.col("bytes")).alias("list"), "long", *columns)
    still = written(split.where("long").groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > block).select(F.col("list").alias("of_list"), F.ceil(F.col("n") / block).cast("int").alias("blocks")), "near-longer")
    if still.isEmpty():
        units = split.select("list", F.lit(0).alias("one"), F.lit(0).alias("two"), *columns)
    else:
        dealt = split.join(still, F.col("long") & (F.col("list") == F.col("of_list")), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        units = dealt.select("list", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), *columns)
    units = units.select(*(F.col(c).cast("long").alias(c) for c in ("list", "one", "two", *columns)))
    units = units.repartition("list", "one", "two").sortWithinPartitions("list", "one", "two", "node")
    return units.mapInArrow(_pairs_of_units(max_bits), "u long, v long").distinct()


def missed(rows: DataFrame, joined: DataFrame, similarity: float, block: int, again: int, lists: DataFrame | None = None) -> DataFrame:
    """(u, v, behind), u < v: pairs of nodes that aren't joined and may be alike; ``behind`` is their list if that has more, of
    all lists or of ``lists`` (behind). Rows: node, size, pieces, their parity bits; rows of one node are equal."""
    mark, rows, exploded = 1 << HASH_BITS, rows.where("size > 0"), F.posexplode("prefix").alias("place", "shingle")
    often, list_ = F.col("shingle").bitwiseAND(F.lit(mark)) != 0, F.col("shingle").bitwiseAND(F.lit(~mark))
    joined = _small(joined)
    placed = rows.select("node", F.inline("pieces")).select("node", "piece", "size", exploded)
    if lists is not None:
        placed = placed.withColumn("behind", list_).join(lists, "behind", "left_semi")
    known = _grouped(placed.where(often).dropDuplicates(["node", "shingle"]), joined)
    if lists is None:
        held = _grouped(rows.select("node", "pieces"), joined).select("node", "group", F.inline("pieces"))
        others = held.select("node", "group", "piece", "size", exploded).where(~often)
    else:
        others = _grouped(placed.where(~often), joined)
    posted = lambda found: found.select(list_.alias("list"), "node", "group", "piece", "size", F.col("place").cast("long"))
    # Lists of one group give no pairs; they are nearly all. Of frequent shingles there are MAX_FREQUENT lists a level at most.
    blocks, several = F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.min("group") < F.max("group")
    sizes = written(posted(known).groupBy("list").agg(blocks, several.alias("several")).where("several").select("list", "blocks"), "near-frequent")
    # Nor do sets of which none in the list is within the ratio: the next in size would be.
    ratio, within = _ratio(similarity), W.partitionBy("list")
    by_size = within.orderBy("size", "node")
    near = lambda less, more: less * ratio.denominator >= more * ratio.numerator
    shared = posted(others).withColumn("before", F.lag("node").over(by_size)).where("before IS NULL OR before <> node")
    shared = shared.withColumns({"low": F.min("group").over(within), "high": F.max("group").over(within), "less": F.lag("size").over(by_size), "more": F.lead("size").over(by_size)})
    shared = shared.where((F.col("low") < F.col("high")) & (near(F.col("less"), F.col("size")) | near(F.col("size"), F.col("more")))).drop("before", "low", "high", "less", "more")
    shared = posted(known).join(F.broadcast(sizes), "list").unionByName(shared.withColumn("blocks", F.lit(1)))
    bits = rows.groupBy("node").agg(F.first("bits").alias("bits")).select("node", F.inline("bits"))
    dealt = shared.join(bits, ["node", "piece"])
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = dealt.select("list", F.least("own", "other").cast("long").alias("one"), F.greatest("own", "other").cast("long").alias("two"), "node", "group", F.col("own").cast("long"), "size", "place", *PARITY)
    units = units.repartition("list", "one", "two").sortWithinPartitions("list", "one", "two", "size", "node")
    return units.mapInArrow(_missed_of_units(ratio, again), "u long, v long, behind long")


def _possible(pairs: DataFrame, entries: DataFrame, similarity: float) -> DataFrame:
    """Of (u, v) those whose parity bits leave it possible that they are alike."""
    ratio = _ratio(similarity)
    side = lambda c: entries.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), *(F.col(k).alias(f"{c}_{k}") for k in PARITY))
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"u_{k}").bitwiseXOR(F.col(f"v_{k}"))) for k in PARITY])
    both = F.col("u_size") + F.col("v_size")
    most = both - 2 * F.ceil(both * ratio.numerator / (ratio.numerator + ratio.denominator))
    return pairs.join(side("u"), "u").join(side("v"), "v").where(differ <= most).select("u", "v")


def _alike(pairs: DataFrame, entries: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Of (u, v) those whose sets of shingles are alike by ``similarity``."""
    nodes = written(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(entries.select("node", "first_key"), "node"), "near-nodes")
    wanted = nodes.withColumnRenamed("first_key", "key")
    texts = docs.select("key", "text").join(F.broadcast(wanted) if nodes.count() <= MAX_BROADCAST_NODES else wanted, "key").select("node", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, held in steps(batches, "text"):
            first, hashes = shingles(held, shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))], ["node", "hashes"])

    # Rows that share a key share a text, so any of them will do.
    sets = texts.mapInArrow(scan, T.StructType([T.StructField("node", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType()))]))
    sets = written(sets.dropDuplicates(["node"]), "near-sets")
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")
    ratio, shared = _ratio(similarity), F.size(F.array_intersect("a", "b")).cast("long")
    return both.where(shared * (ratio.numerator + ratio.denominator) >= (F.size("a") + F.size("b")) * ratio.numerator).select("u", "v")


def groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, block: int = 1024) -> DataFrame:
    """Per row of ``docs`` (key, text): key, group."""
    prints_ = written(fingerprints(docs, shingle, similarity), "near-prints")
    carried = ("size", *SYMBOLS, *CARRIED, *PARITY)
    entries = written(prints_.where("size > 0").groupBy("node").agg(F.min("key").alias("first_key"), *(F.first(c).alias(c) for c in carried)), "near-entries")
    possible = lambda pairs: written(_possible(pairs, entries, similarity), "near-pairs")
    alike = lambda pairs: _alike(pairs, entries, docs, shingle, similarity)
    found = written(alike(possible(neighbours(entries))), "near-links")
    joined = components(found)
    found = written(found.unionByName(alike(possible(candidates(entries, block=block, joined=joined)))), "near-links")
    joined, lists, tested, again = components(found), None, None, 0
    while True:
        pairs = written(missed(prints_, joined, similarity, max(2, block // 2), again, lists), "near-missed")
        once = pairs.select("u", "v").distinct()
        new = possible(once if tested is None else once.join(tested, ["u", "v"], "left_anti"))
        more = written(alike(new), "near-links")
        if not more.isEmpty():
            found = written(found.unionByName(more), "near-links")
            joined = components(found)
        lists = written(pairs.where("behind IS NOT NULL").select("behind").distinct(), "near-behind")
        if lists.isEmpty():
            break
        tested = new if tested is None else written(tested.unionByName(new), "near-tested")
        again += 1
    return prints_.select("key", "node").join(joined, "node", "left").select("key", F.coalesce("component", "node").alias("group"))
