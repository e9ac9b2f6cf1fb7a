"""Admission: which files and tasks are taken, with the first failing rule as the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.sources.readers import MEDIA, extension

MAX_BYTES = 500 * 1024 * 1024
MODES = ("local", "cloud")


def admit_files(catalog: DataFrame, max_bytes: int = MAX_BYTES, extensions: tuple[str, ...] = MEDIA) -> DataFrame:
    """Adds ``reason`` (null: accepted). Columns name, bytes."""
    name = F.col("name")
    rules = [
        (name.isNull() | (F.trim("name") == ""), "empty name"),
        (name.contains("..") | name.contains("/") | name.contains("\\") | name.contains("\x00"), "unsafe name"),
        (~extension(name).isin(*extensions), "type not supported"),
        (F.col("bytes").isNull() | (F.col("bytes") > max_bytes), "too large"),
    ]
    return catalog.withColumn("reason", F.coalesce(*[F.when(bad, F.lit(why)) for bad, why in rules]))


def enforce_mode_policy(tasks: DataFrame, templates: DataFrame) -> DataFrame:
    """Adds ``reason`` (null: accepted). tasks (mode, template_id), templates (template_id, local_only), a small rule table."""
    rules = templates.select("template_id", "local_only")
    joined = tasks.join(rules, "template_id", "left")
    reason = F.when(~F.coalesce(F.col("mode").isin(*MODES), F.lit(False)), "unknown mode").when(F.col("local_only").isNull(), "unknown template").when(F.col("local_only") & (F.col("mode") == "cloud"), "template is local only")
    return joined.withColumn("reason", reason).drop("local_only")


# What shared evidence of an upload may hold.
EVIDENCE_COLUMNS = ("task_id", "filename", "file_size", "queue_position", "estimated_wait_seconds", "message")


def redact_columns(df: DataFrame, keep: tuple[str, ...] = EVIDENCE_COLUMNS) -> DataFrame:
    """Of the listed columns those that are there, in the list's order."""
    return df.select(*[c for c in keep if c in df.columns])
