"""Tables in the folder that driver and executors share: work tables, the transcript store, results and reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import safe_base_name

_local_dir: list[str] = []
HASH = "^[0-9a-f]{64}$"


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path under spark.checkpoint.dir; a local folder only where that is unset and the master is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local_dir:
            _local_dir.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        found = _local_dir[0]
    return f"{found.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, what: str) -> DataFrame:
    """The rows as a table in the shared folder: for frames that are used twice, and to cut lineage in loops."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    """(task_id, template_id, name, record, transcript): a partition per template; the transcript is a table of its own."""
    named = results.withColumn("result_name", F.concat(safe_base_name(F.col("name")), F.lit("_"), F.col("task_id").cast("string")))
    named.select("task_id", "template_id", "result_name", "record").write.mode("append").partitionBy("template_id").parquet(f"{path}/records")
    named.select("task_id", "result_name", "transcript").write.mode("append").parquet(f"{path}/transcripts")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/records").join(spark.read.parquet(f"{path}/transcripts"), ["task_id", "result_name"])


def split_cached(files: DataFrame, store: DataFrame, signature: str, unlabelled: str) -> DataFrame:
    """Files (file_id, hash) against a store (hash, signature, labelled, transcript): adds transcript and hit.

    A hash that isn't 64 hex digits never hits. A result without labels counts only under the unlabelled signature.
    """
    good = store.where(F.col("hash").rlike(HASH) & (F.col("signature") == signature) & (F.col("labelled") | (F.col("signature") == unlabelled)))
    known = good.groupBy("hash").agg(F.max("transcript").alias("transcript"))
    return files.join(known, "hash", "left").withColumn("hit", F.col("transcript").isNotNull())


def append_store(results: DataFrame, store: DataFrame) -> DataFrame:
    """The rows of ``results`` (hash, signature, labelled, transcript) that the store lacks, each key once."""
    new = results.where(F.col("hash").rlike(HASH)).groupBy("hash", "signature").agg(F.bool_or("labelled").alias("labelled"), F.min("transcript").alias("transcript"))
    return new.join(store.select("hash", "signature"), ["hash", "signature"], "left_anti")


#: How many hexadecimal digits of a hash name its bucket: 16 to that power at most.
BUCKET_DIGITS = 2
STORED = "hash string, signature string, labelled boolean, transcript string"


def bucket_of(value: Column) -> Column:
    return F.substring(value, 1, BUCKET_DIGITS)


def create_store(spark: SparkSession, path: str) -> None:
    """An empty store at ``path``, or nothing where one is."""
    spark.createDataFrame([], f"{STORED}, bucket string, batch string").write.mode("ignore").partitionBy("bucket", "batch").parquet(path)


def open_store(spark: SparkSession, path: str, buckets: list[str] | None = None) -> DataFrame:
    """The store's rows with their bucket and batch; of some buckets, only these folders are read."""
    rows = spark.read.schema(f"{STORED}, bucket string, batch string").parquet(path)
    return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))


def buckets_of(hashed: DataFrame) -> list[str]:
    """The buckets that the hashes fall in: 256 names at most."""
    return sorted(r[0] for r in hashed.where(F.col("hash").rlike(HASH)).select(bucket_of(F.col("hash"))).distinct().collect())


def append_batch(results: DataFrame, path: str, batch: str) -> None:
    """Adds what the store lacks of ``results`` (hash, signature, labelled, transcript) as files of their own.

    A batch's files lie in bucket=../batch=.. and no other batch's are touched. The same batch again, after a failure or
    by mistake, replaces its own files by the same rows, as it is compared with the other batches only."""
    spark = results.sparkSession
    create_store(spark, path)
    others = open_store(spark, path, buckets_of(results)).where(F.col("batch") != batch)
    new = append_store(results, others).withColumn("bucket", bucket_of(F.col("hash"))).withColumn("batch", F.lit(batch))
    # Each bucket's rows in one task: a file a bucket.
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)


def lookup(files: DataFrame, path: str, signature: str, unlabelled: str) -> DataFrame:
    """J6 on a laid-out store: as ``split_cached``, reading only the buckets of the files' hashes."""
    return split_cached(files, open_store(files.sparkSession, path, buckets_of(files)), signature, unlabelled)


def write_validation_report(report: DataFrame, path: str) -> None:
    """One JSON line per row."""
    report.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
