"""Connected components of a link table by alternating large-star and small-star steps.

Every step keeps one row per link at most. What a step needs twice is written to the shared folder, so both sides of each
join are shuffled anew and adaptive execution can split a hub's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(20,0)"))).first())


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link to another; the component is its smallest node. Links: u, v long."""
    links = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _signature(links)
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low")), "links-low")
        large = written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(), "links-large")
        low = written(large.groupBy("u").agg(F.min("v").alias("low")), "links-low")
        passed = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        links = written(low.select("u", F.col("low").alias("v")).unionByName(passed).distinct(), "links")
        now = _signature(links)
        if now == before:
            roots = links.select(F.col("v").alias("node")).distinct()
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
