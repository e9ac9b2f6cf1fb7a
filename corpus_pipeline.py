"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and reread as the next one's docs. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import decontaminate, language_id, near_copies, source_mix, token_output
from parley.llm.common import load, unique_column, written

#: Fingerprints, hash draws and the tokenizer have no SQL form.
ORACLE_SQL = None


def row_key(docs: DataFrame) -> Column:
    """A 64-bit number that tells rows apart whatever their doc_id; only equal rows share one, but for chance. Maps have no
    hash, so columns with them go as JSON."""
    plain = lambda f: F.to_json(F.struct(F.col(f.name))) if any(k in f.dataType.simpleString() for k in ("map<", "variant")) else F.col(f.name)
    return F.xxhash64(*[x for f in docs.schema for x in (F.col(f.name).isNull(), plain(f))])


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """(rows with their row key, the key's name)."""
    key = unique_column(docs, "row_key")
    return docs.withColumn(key, row_key(docs)), key


def _as_documents(keyed: DataFrame, key: str) -> DataFrame:
    """The rows' own columns as operators want them, under their row key as doc_id: what a report says is then of the row."""
    return keyed.select(F.col(key).alias("doc_id"), "text", "lang", "source")


def _only(docs: DataFrame, keyed: DataFrame, key: str, kept: DataFrame) -> DataFrame:
    """Rows of ``keyed`` whose key is in ``kept`` (doc_id), with the columns of ``docs``."""
    return keyed.join(kept.select(F.col("doc_id").alias(key)), key, "left_semi").select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified stay."""
    keyed, key = _keyed(docs)
    return _only(docs, keyed, key, language_id.report(_as_documents(keyed, key)).where("accepted"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the smallest doc_id; near copies share 0.8 of their five-word shingles (Jaccard).
    Of rows that are equal in all columns one stays."""
    keyed, key = _keyed(docs)
    rows = keyed.select(F.col(key).alias("key"), "doc_id", "text")
    found = near_copies.groups(rows.select("key", "text")).distinct().join(rows.select("key", "doc_id"), "key")
    kept = found.groupBy("group").agg(F.min(F.struct("doc_id", "key")).alias("first")).select(F.col("first.key").alias(key))
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row with the benchmark stay."""
    keyed, key = _keyed(docs)
    found = decontaminate.report(_as_documents(keyed, key), load(spark, sf_dir, "benchmark"))
    return _only(docs, keyed, key, found.where(~F.col("contaminated")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate has it."""
    return source_mix.mixed(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document taken: what the files of token ids hold."""
    return token_output.report(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("token_output", write_token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
