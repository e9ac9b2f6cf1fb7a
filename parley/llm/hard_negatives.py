"""Operator 13, hard negatives: for an anchor and each of its nearest rows of the same label, the rows of other labels whose
score, the inner product with the anchor, lies in a window below the positive's score. Exact.

A further component sqrt(M - |x|^2), M the largest squared norm, gives all candidates the same norm; with a 0 there in the
anchor, the larger inner product is the smaller distance, and a ball around a node bounds the scores of what is in it from
both sides. The index has two stages. Rows go to the nearest of some pivots (a bounded sample, by hash), the nodes of the top
level; each pivot's rows are cut into blocks of a bounded size, by hash where they are more, and a task builds a block's cover
tree: from a node's rows, centres further apart than the level's radius take what is in it, the centre of the node first,
and the radius shrinks by ``BASE`` from level to level. Where rows lie so far from each other that a level would
fall apart into crumbs, the node stays a leaf.

Anchors go only to cells whose bounds can hold something for them, along with what they look for (goals): the best
rows of their label, first in their own cell and then, above the score reached there, in others; and the best in each window.
In a tree nodes are taken by their upper bound; those outside all windows, or below what is found already, are left out,
and leaves are scored in whole. Task's best are merged by rank. A task gets one block's tree and streams anchors by it, at
most ``ANCHORS`` of them, so no group is held; anchors and blocks meet by an equi-join on the block.

Work grows with anchors times the rows of cells that bounds can't leave out, and these are nearly all where data have no
clusters: a stated query set against all rows, in blocks.

Defined results: rows with a null id or label, a null vector, or a null or non-finite component take no part; shorter vectors are
as if zeros followed; rows that repeat an id are rows of their own (an anchor's copy can be its positive); of equal scores the
smaller id comes first; scores beyond 64 bits are cut to the limits; no other rows of a label, or none in a window, give no
rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Rows and bytes of a block at most; pivots and bytes of them at most; anchors that go by one copy of a tree.
BLOCK_ROWS, BLOCK_BYTES = 8192, 8 << 20
MAX_CELLS, CELL_BYTES = 4096, 8 << 20
ANCHORS = 65_536
BASE, LEAF, CRUMB = 1.3, 128, 48
_MOST = (1 << 63) - 1
TREE = "ids array<long>, labels array<long>, rows array<long>, points array<long>, starts array<int>, ends array<int>, centers array<int>, radii array<double>, firsts array<int>, counts array<int>"


def quantised(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> Column:
    """floor(scale * x) of each component, as whole numbers."""
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    real = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & real)


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Lists of whole numbers as rows, with zeros behind."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    made = np.zeros((len(lists), dim), np.int64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    made[np.arange(dim) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return made


class Space:
    """Scores and bounds of vectors whose squared norms are ``most`` at most."""

    def __init__(self, dim: int, most: float):
        self.dim, self.most = dim, most
        # Sums of products stay below the squared norm, so doubles are exact up to 2^53.
        self.exact = most < 2.0**53

    def of(self, points: np.ndarray) -> np.ndarray:
        return points.astype(np.float64) if self.exact else points.astype(object)

    def scores(self, points: np.ndarray, q: np.ndarray) -> np.ndarray:
        made = points @ q
        return made.astype(np.int64) if self.exact else np.array([max(-_MOST - 1, min(_MOST, int(x))) for x in made], np.int64)

    def lifted(self, points: np.ndarray) -> np.ndarray:
        """The points with the component that makes their norms equal."""
        plain = points.astype(np.float64)
        return np.c_[plain, np.sqrt(np.maximum(0, self.most - (plain * plain).sum(axis=1)))]

    def bounds(self, q: np.ndarray, centers: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score of ``q`` with any point in each ball of lifted points."""
        both = q @ q + self.most
        away = np.sqrt(np.maximum(0, both - 2 * (centers[:, : self.dim] @ q)))
        slack = 1e-9 * both + 1e-6
        return (both - (away + radii) ** 2) / 2 - slack, (both - np.maximum(0, away - radii) ** 2) / 2 + slack


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, float, int, int]]]:
    """(order of the points, nodes) of lifted points: a node has its points' places from start to end, its centre's number
    in the points, the largest distance from it, and the number of its first child and how many there are."""
    order = np.arange(len(points))
    away = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    nodes: list = [[0, len(points), 0, float(away.max()), 0, 0]]
    # (number of the node, distances of its points from its centre, in their order)
    todo = [(0, away)]
    while todo:
        at, away = todo.pop()
        start, end, center, radius = nodes[at][:4]
        if end - start <= LEAF or radius == 0:
            continue
        members, reach = order[start:end], radius / BASE
        near = away <= reach
        found, rest = [(center, members[near], away[near])], members[~near]
        while len(rest) and len(found) * CRUMB <= end - start:
            d = np.sqrt(((points[rest] - points[rest[0]]) ** 2).sum(axis=1))
            near = d <= reach
            found.append((int(rest[0]), rest[near], d[near]))
            rest = rest[~near]
        if len(rest):
            continue
        nodes[at][4:] = len(nodes), len(found)
        order[start:end] = np.concatenate([m for _, m, _ in found])
        for c, own, d in found:
            todo.append((len(nodes), d))
            nodes.append([start, start + len(own), c, float(d.max()), 0, 0])
            start += len(own)
    return order, nodes


class Block:
    """A block's tree as it is read from the index."""

    def __init__(self, batch: pa.RecordBatch, i: int, space: Space):
        of = lambda name: batch.column(batch.schema.get_field_index(name))[i].values.to_numpy(zero_copy_only=False)
        self.space = space
        self.ids, self.labels, self.rows = of("ids"), of("labels"), of("rows")
        whole = of("points").reshape(len(self.ids), space.dim)
        self.points = space.of(whole)
        self.starts, self.ends, self.firsts, self.counts = (of(c).tolist() for c in ("starts", "ends", "firsts", "counts"))
        self.centers, self.radii = space.lifted(whole[of("centers")]), of("radii")

    def search(self, vector: np.ndarray, label: int, row: int, lows: list[int], highs: list[int], same: bool, k: int) -> list[list[tuple[int, int]]]:
        """Per goal the first k (-score, id) of scores from low to high, of the same label (but the row itself) or of others."""
        q, lows = self.space.of(vector), list(lows)
        found: list[list[tuple[int, int]]] = [[] for _ in lows]
        plain = vector.astype(np.float64)
        open_to = lambda least, most: any(most >= lo and least <= hi for lo, hi in zip(lows, highs, strict=True))
        heap = [(-float("inf"), 0, -float("inf"))]
        while heap:
            most, node, least = heapq.heappop(heap)
            if -most < min(lows):
                break
            if not open_to(least, -most):
                continue
            if n := self.counts[node]:
                first = self.firsts[node]
                low, high = self.space.bounds(plain, self.centers[first : first + n], self.radii[first : first + n])
                for i, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True), first):
                    if open_to(a, b):
                        heapq.heappush(heap, (-b, i, a))
                continue
            own = slice(self.starts[node], self.ends[node])
            scores = self.space.scores(self.points[own], q)
            fits = (self.labels[own] == label) == same
            if same:
                fits &= self.rows[own] != row
            for g, high in enumerate(highs):
                at = np.flatnonzero(fits & (scores >= lows[g]) & (scores <= high))
                if len(at) > 4 * k:
                    at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
                if len(at):
                    found[g] = heapq.nsmallest(k, [*found[g], *zip((-scores[at]).tolist(), self.ids[own][at].tolist(), strict=True)])
                    if len(found[g]) == k:
                        lows[g] = max(lows[g], -found[g][-1][0])
        return found


class Index:
    """Cells, blocks and their trees over ``base`` (row, vec_id, label, v)."""

    def __init__(self, base: DataFrame, block_rows: int | None = None, max_cells: int = MAX_CELLS):
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        told = base.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(square).alias("most")).first()
        self.n, dim = told.n, max(1, told.dim or 0)
        self.space = space = Space(dim, told.most or 0.0)
        self.block_rows = block_rows or max(64, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))
        n_cells = max(1, min(-(-self.n // self.block_rows), max_cells, CELL_BYTES // (8 * dim) + 1))
        # A bounded sample: MAX_CELLS rows of CELL_BYTES at most.
        pivots = base.select("row", "v").orderBy(F.xxhash64("row"), "row").limit(n_cells).toArrow()
        self.pivots = pivots = space.lifted(_matrix(pivots.column("v"), dim)) if self.n else np.zeros((1, dim + 1))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            norms = (pivots * pivots).sum(axis=1)
            for batch in batches:
                points = space.lifted(_matrix(batch.column(3), dim))
                cell = (norms - 2 * points @ pivots.T).argmin(axis=1)
                away = np.sqrt(((points - pivots[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], ["row", "vec_id", "label", "v", "cell", "away"])

        self.rows = written(base.select("row", "vec_id", "label", "v").mapInArrow(assign, "row long, vec_id long, label long, v array<long>, cell int, away double"), "negatives-cells")
        cells = self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).orderBy("cell").toArrow()  # max_cells rows at most
        self.cells, self.radii = cells.column("cell").to_numpy(), cells.column("radius").to_numpy()
        self.splits = -(-cells.column("n").to_numpy() // self.block_rows)
        self.trees = written(self._trees(), "negatives-trees")

    def _trees(self) -> DataFrame:
        space, dim = self.space, self.space.dim
        per_cell = self.rows.sparkSession.createDataFrame([(int(c), int(n)) for c, n in zip(self.cells, self.splits, strict=True)], "cell int, splits int")  # max_cells rows
        keyed = self.rows.join(F.broadcast(per_cell), "cell").withColumn("split", F.pmod(F.xxhash64("row", F.lit(1)), "splits").cast("int"))
        names = ["cell", "split", *(x.split()[0] for x in TREE.split(", "))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _by_key(batches, 2):
                points = _matrix(batch.column(5), dim)
                order, nodes = cover_tree(space.lifted(points))
                place = np.argsort(order)
                of = lambda i: np.array([x[i] for x in nodes])  # noqa: B023, E731
                rows, ids, labels = (batch.column(i).to_numpy()[order] for i in (2, 3, 4))
                values = [ids, labels, rows, points[order].ravel(), of(0), of(1), place[of(2)], of(3), of(4), of(5)]
                kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.float64()] + [pa.int32()] * 2
                lists = [pa.array([x], pa.list_(t)) for x, t in zip(values, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(0, 1), batch.column(1).slice(0, 1), *lists], names)

        blocks = int(self.splits.sum()) or 1
        dealt = keyed.select("cell", "split", "row", "vec_id", "label", "v").repartition(self._partitions(blocks), "cell", "split")
        return dealt.sortWithinPartitions("cell", "split", "row").mapInArrow(run, f"cell int, split int, {TREE}")

    def _partitions(self, blocks: int) -> int:
        """A partition gets a few blocks at most."""
        return max(int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(blocks, 1_000_000))

    def search(self, goals: DataFrame, same: bool, k: int, own_cell: bool | None = None) -> DataFrame:
        """(row, goal, id, score) for ``goals`` (row, label, v, cell, keys, lows, highs): the first k of each goal in each block.

        ``own_cell``: only the anchor's own cell (True), only others (False), or all (None)."""
        space, dim, numbers, radii, splits = self.space, self.space.dim, self.cells, self.radii, self.splits
        centers = self.pivots[numbers] if len(numbers) else self.pivots[:0]
        chunks = -(-goals.count() // ANCHORS) or 1

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = []
                for vector, own, lows, highs in zip(_matrix(batch.column(2), dim).astype(np.float64), batch.column(3).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                    least, most = space.bounds(vector, centers, radii)
                    fits = np.zeros(len(numbers), bool)
                    for low, high in zip(lows, highs, strict=True):
                        fits |= (most >= low) & (least <= high)
                    if own_cell is not None:
                        fits &= (numbers == own) == own_cell
                    lists.append([{"to_cell": c, "to_split": s} for c, n in zip(numbers[fits].tolist(), splits[fits].tolist(), strict=True) for s in range(n)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.struct([("to_cell", pa.int32()), ("to_split", pa.int32())])))], [*batch.schema.names, "to"])

        fields = "row long, label long, v array<long>, cell int, keys array<long>, lows array<long>, highs array<long>, to array<struct<to_cell: int, to_split: int>>"
        routed = goals.select("row", "label", "v", "cell", "keys", "lows", "highs").mapInArrow(route, fields).withColumn("to", F.explode("to"))
        asked = routed.select(F.col("to.to_cell").alias("cell"), F.col("to.to_split").alias("split"), F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(1).alias("kind"), "row", "label", "v", "keys", "lows", "highs")
        trees = self.trees.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn("kind", F.lit(0))
        both = trees.unionByName(asked, allowMissingColumns=True)
        blocks = (int(splits.sum()) or 1) * chunks
        dealt = both.repartition(self._partitions(blocks), "cell", "split", "chunk").sortWithinPartitions("cell", "split", "chunk", "kind")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = None
            for batch in batches:
                of = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
                kinds, out = of("kind").to_pylist(), []
                asked = [i for i, kind in enumerate(kinds) if kind]
                take = pa.array(asked, pa.int64())
                vectors = _matrix(of("v").take(take), dim)
                told = {i: x for i, *x in zip(asked, vectors, *(of(c).take(take).to_pylist() for c in ("label", "row", "lows", "highs", "keys")), strict=True)}
                for i, kind in enumerate(kinds):
                    if not kind:
                        block = Block(batch, i, space)
                        continue
                    vector, label, row, lows, highs, keys = told[i]
                    for key, best in zip(keys, block.search(vector, label, row, lows, highs, same, k), strict=True):
                        out += [(row, key, number, -score) for score, number in best]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["row", "goal", "id", "score"])

        return dealt.mapInArrow(run, "row long, goal long, id long, score long")


def _by_key(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Runs of equal values in the first ``n`` columns, each as one batch."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = np.stack([batch.column(i).to_numpy() for i in range(n)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):  # noqa: B905
            if a == b:
                continue
            if held and tuple(keys[a]) != key:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            key = tuple(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _percent(score: Column, percent: int, up: bool) -> Column:
    """percent / 100 of a score that isn't negative, rounded; without products that overflow."""
    ones = score % 100
    return F.floor((score - ones) / 100) * percent + F.floor((ones * percent + (99 if up else 0)) / 100)


def mine(base: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block_rows: int | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over ``base`` (vec_id, label, v: whole numbers).

    ``anchors`` says which rows are anchors; the window is from ``low`` to ``high`` percent of the positive's score."""
    base = written(base.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v"), "negatives-base")
    index = Index(base, block_rows, max_cells)
    asking = index.rows.where(anchors)
    goal = lambda lows, highs, keys: asking_cols + [keys.alias("keys"), lows.alias("lows"), highs.alias("highs")]
    asking_cols = [F.col(c) for c in ("row", "label", "v", "cell")]
    all_of, nothing = F.array(F.lit(_MOST)), F.array(F.lit(-_MOST - 1))
    home = written(index.search(asking.select(goal(nothing, all_of, F.array(F.lit(0).cast("long")))), True, positives, True), "negatives-home")
    # What the anchor's own cell reached: others must reach it too.
    reached = _first(home, ["row"], positives).groupBy("row").agg(F.when(F.count("*") == positives, F.min("score")).alias("reached"))
    floor = F.array(F.coalesce("reached", F.lit(-_MOST - 1)))
    more = index.search(asking.join(reached, "row", "left").select(goal(floor, all_of, F.array(F.lit(0).cast("long")))), True, positives, False)
    near = written(_first(home.unionByName(more), ["row"], positives).select("row", F.col("id").alias("positive_id"), "score"), "negatives-positives")
    # One window for equal scores; a negative score has none.
    kinds = near.where("score >= 0").select("row", "score").distinct().select("row", "score", _percent(F.col("score"), low, True).alias("low"), _percent(F.col("score"), high, False).alias("high")).where("low <= high")
    windows = kinds.groupBy("row").agg(F.collect_list(F.struct("score", "low", "high")).alias("w"))
    asked = asking.join(windows, "row").select(*asking_cols, F.col("w.score").alias("keys"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    hard = _first(index.search(asked, False, negatives), ["row", "goal"], negatives)
    named = near.join(base.select("row", F.col("vec_id").alias("anchor_id")), "row")
    joined = named.join(hard.select("row", F.col("goal").alias("score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["row", "score"])
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("score").alias("positive_score"), "negative_score")


def report(embeddings: DataFrame, block_rows: int | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """Anchors are rows whose vec_id is divisible by 50; a label is moved up where it is divisible by 7."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(embeddings.select("vec_id", "label", "embedding"))
    return mine(rows.select("vec_id", label.alias("label"), quantised(rows).alias("v")), F.col("vec_id") % 50 == 0, block_rows=block_rows, max_cells=max_cells)


def oracle() -> str:
    """The report in DuckDB."""
    return """
WITH base AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.row, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM base a JOIN base b ON a.row <> b.row WHERE a.vec_id % 50 = 0),
near AS (SELECT row, anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, id) <= 5),
hard AS (SELECT n.row, n.anchor_id, n.positive_id, n.positive_score, s.id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY n.row, n.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM near n JOIN scored s ON s.row = n.row AND NOT s.same AND 50 * n.positive_score <= 100 * s.score AND 100 * s.score <= 95 * n.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM hard WHERE rank <= 3"""
