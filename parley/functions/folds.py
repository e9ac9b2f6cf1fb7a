"""Folds over sorted rows: one pass of a partition's stream, whatever the number and length of its groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.sources.store import materialised


def fold_rows(rows: DataFrame, key: str, order: list[str], columns: list[str], start: Callable[[], Callable[[tuple], tuple]], added: str) -> DataFrame:
    """Adds columns to each row: ``start`` makes a group's step, which is given a row's ``columns`` and gives the new ones.

    Rows come by key, in order; a group may go over the end of a batch. Other columns pass as they are.
    """
    kind = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(added).fields])
    fields = kind.fields[len(rows.columns) :]
    new = [f.name for f in fields]
    types = [pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.int64() for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, last = None, None
        for batch in batches:
            made: list[tuple] = []
            of = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
            for k, *values in zip(of(key), *(of(c) for c in columns), strict=True):
                if step is None or k != last:
                    step, last = start(), k
                made.append(step(values))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([m[i] for m in made], t) for i, t in enumerate(types))], [*batch.schema.names, *new])

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, kind)


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the number of each row within its keys, from 1, and ``of``, how many there are.

    Rows are cut into ranges of (keys, order), numbered in each, and moved up by the counts of the ranges before: no task has
    all rows of a key. The ranges are written, as a sample chooses them anew whenever they are made."""
    ranged = materialised(rows.repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    # A row a key and range.
    upto = F.sum("n").over(W.partitionBy(*keys).orderBy("part")) - F.col("n")
    before = counts.select(*(F.col(k).alias(f"of_{k}") for k in keys), F.col("part").alias("of_part"), upto.alias("before"), F.sum("n").over(W.partitionBy(*keys)).alias("of"))
    match = F.col("part") == F.col("of_part")
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"of_{k}"))
    own = F.row_number().over(W.partitionBy(*keys, "part").orderBy(*order))
    made = ranged.withColumn("own", own).join(before, match)
    return made.withColumn(name, (F.col("own") + F.col("before")).cast("int")).drop("own", "before", "part", "of_part", *(f"of_{k}" for k in keys))
