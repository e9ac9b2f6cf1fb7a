"""Operator 9, mixing sources to target weights. DataFrame functions only.

Sizes are summed per source, targets and repetition rates follow from one row a source, and each document is taken
floor(rate) times plus once more if a draw seeded by its doc_id and text falls below the rate's fraction. The words taken
with one seed spread around a source's target with variance f (1 - f) sum(size^2), f the fraction. So each source has
SEEDS seeds to choose from: one aggregation sums what it would take with each, and the seed that comes nearest its target
is its own. Only where a few documents have most of a source's words does it stay off its target.

Targets: sources in order of their names (code points, null last) weigh ``weights`` in turn and share the whole size by
weight. A target stops at ``cap`` times its source's size, and the excess goes to the others by weight until none is above.
With sources in order of cap * size / weight, the first whose ratio is not below the level that the rest would share is
where that ends, so it takes two sums over the source table (one row a source) and no loop.

Defined results: a null or empty text has size 0; a source without words has target 0 and rate 0; null is a source;
rows that repeat a doc_id and text are taken alike; an empty table gives no rows; other columns are ignored or passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import unique_column, written

WEIGHTS = (5.0, 2.0, 1.0)
SEEDS = 64
#: Up to so many sources (a name and two numbers each) their table is sent to all tasks; beyond, it is joined by shuffle.
MAX_BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target)."""
    # One row a source goes through these windows: the table of sources, not of documents.
    order = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * cap
    filled = W.orderBy((limit / F.col("weight")).asc(), F.col("source").isNull(), F.col("source"))
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    rest = filled.rowsBetween(0, W.unboundedFollowing)
    all_of = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(all_of)
    level = (total - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    found = weighed.withColumn("level", level).withColumn("limit", limit)
    # The level is right from the first source that it doesn't fill; with all filled there is none.
    settled = F.min(F.when(F.col("limit") / F.col("weight") >= F.col("level"), F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(all_of)["level"]
    return found.withColumn("settled", settled).select("source", "source_size", F.least("limit", F.coalesce(F.col("weight") * F.col("settled"), F.col("limit"))).alias("target"))


def named(seed: int) -> Column:
    """A row's own name for the draws: the same for equal doc_ids and texts."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))


def drawn(name: Column, k: Column) -> Column:
    """Draw number ``k`` of a row as eight hexadecimal digits, which compare as numbers do: a digest has eight draws."""
    return F.substr(F.sha2(F.concat(F.floor(k / 8).cast("string"), F.lit(":"), name), 256), (k % 8 * 8 + 1).cast("int"), F.lit(8))


def choices(sized: DataFrame, goal: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """``goal`` with each source's ``whole`` copies, ``below`` (what draws must be below) and ``seed``; sized (source, size, name)."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    below = F.lpad(F.lower(F.hex(F.floor((rate - F.floor(rate)) * float(1 << 32)))), 8, "0")
    told = goal.select("source", "source_size", "target", F.floor(rate).alias("whole"), below.alias("below"))
    rows = sized.join(told.select(F.col("source").alias("of"), "below"), F.col("source").eqNullSafe(F.col("of")))
    for j in range(-(-seeds // 8)):
        rows = rows.withColumn(f"digest{j}", F.sha2(F.concat(F.lit(f"{j}:"), F.col("name")), 256))
    sums = [F.sum(F.when(F.substring(f"digest{k // 8}", k % 8 * 8 + 1, 8) < F.col("below"), F.col("size")).otherwise(0)) for k in range(seeds)]
    tried = rows.groupBy(F.col("source").alias("of")).agg(F.array(*sums).alias("sums"))
    met = told.join(tried, F.col("source").eqNullSafe(F.col("of")), "left")
    off = F.transform("sums", lambda x, k: F.struct(F.abs(F.col("source_size") * F.col("whole") + x - F.col("target")).alias("off"), k.alias("k")))
    return met.select("source", "source_size", "target", "whole", "below", F.coalesce(F.array_min(off)["k"], F.lit(0)).alias("seed"))


def with_copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0, seed: int = 42, max_broadcast: int = MAX_BROADCAST_SOURCES, seeds: int = SEEDS) -> DataFrame:
    """``docs`` (doc_id, text, source and others) with mix_size, mix_source_size, mix_target and mix_copies."""
    names = {c: unique_column(docs, f"mix_{c}") for c in ("size", "source_size", "target", "copies", "of", "whole", "below", "seed")}
    # Three short columns a document: the texts are read for them once, whatever the number of seeds.
    sized = written(docs.select("source", n_words(F.col("text")).alias("size"), named(seed).alias("name")), "mix-sizes")
    goal = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "mix-sources")
    small = goal.count() <= max_broadcast
    chosen = written(choices(sized, F.broadcast(goal) if small else goal, seeds), "mix-seeds")
    chosen = chosen.select(*(F.col(c).alias(names["of" if c == "source" else c]) for c in chosen.columns))
    joined = docs.withColumn(names["size"], n_words(F.col("text"))).join(F.broadcast(chosen) if small else chosen, F.col("source").eqNullSafe(F.col(names["of"])), "left")
    copies = F.col(names["whole"]) + (drawn(named(seed), F.col(names["seed"])) < F.col(names["below"])).cast("long")
    return joined.withColumn(names["copies"], copies.cast("long")).drop(names["of"], names["whole"], names["below"], names["seed"])


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0, seed: int = 42) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken."""
    found = with_copies(docs, weights, cap, seed)
    copies = found.columns[-1]
    again = F.explode(F.when(F.col(copies) > 0, F.sequence(F.lit(1).cast("long"), F.col(copies))))
    number = unique_column(found, "mix_copy_number")
    return found.where(F.col(copies) > 0).select(*docs.columns, again.alias(number)).select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    found = with_copies(docs.select("doc_id", "text", "source"))
    return found.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def oracle(weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0, seed: int = 42, seeds: int = SEEDS) -> str:
    """The report in DuckDB."""
    weigh = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return rf"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS name FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1),
weighed AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {weigh} END AS DOUBLE) AS weight, source_size * {cap}::DOUBLE AS lim FROM sums),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
goal AS (SELECT source, source_size, least(lim, coalesce(weight * (SELECT min(level) FROM levels l WHERE l.lim / l.weight >= l.level AND l.lim / l.weight = (SELECT min(lim / weight) FROM levels WHERE lim / weight >= level)), lim)) AS target FROM levels),
rated AS (SELECT *, floor(rate) AS whole, lpad(lower(to_hex(CAST(floor((rate - floor(rate)) * {float(1 << 32)}) AS BIGINT))), 8, '0') AS below FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM goal)),
tried AS (SELECT s.source, k, sum(CASE WHEN substr(sha256((k // 8) || ':' || name), CAST(k % 8 * 8 + 1 AS BIGINT), 8) < below THEN size ELSE 0 END) AS extra FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source, range({seeds}) t(k) GROUP BY 1, 2),
chosen AS (SELECT t.source, t.k, row_number() OVER (PARTITION BY t.source ORDER BY abs(source_size * whole + extra - target), k) AS n FROM tried t JOIN rated r ON t.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN substr(sha256((k // 8) || ':' || name), CAST(k % 8 * 8 + 1 AS BIGINT), 8) < below THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source JOIN chosen c ON s.source IS NOT DISTINCT FROM c.source AND n = 1"""
