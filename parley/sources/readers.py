"""Readers: media catalog, ASR payloads, glossaries, logs, labelled transcripts, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions.folds import numbered

# The media types that are taken.
MEDIA = ("mp3", "wav", "m4a", "mp4", "flac", "ogg", "aac", "wma")
PAYLOAD = "schema string, language string, duration double, chunks array<struct<start:double,end:double,text:string>>"
ANSI = r"\x1B\[[0-9;]*m"


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def scan_media_catalog(spark: SparkSession, path: str, extensions: tuple[str, ...] = MEDIA) -> DataFrame:
    """Files of the folder with a wanted extension: path, name, bytes, modified. File contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return media_only(files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")), extensions)


def media_only(files: DataFrame, extensions: tuple[str, ...] = MEDIA) -> DataFrame:
    return files.withColumn("extension", extension(F.col("name"))).where(F.col("extension").isin(*extensions))


def parse_asr_payloads(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(meeting_id, payload JSON) to (segments, bad payloads).

    Texts are trimmed and empty ones dropped; a missing start is the end before it or 0, a missing end is the start; times
    become whole milliseconds. A payload that isn't such JSON goes to the second table with its reason.
    """
    read = payloads.withColumn("p", F.from_json("payload", PAYLOAD, {"mode": "PERMISSIVE"}))
    reason = F.when(F.col("payload").isNull() | (F.trim("payload") == ""), "empty").when(F.try_parse_json("payload").isNull(), "not json").when(F.col("p.chunks").isNull(), "no chunks")
    judged = read.withColumn("reason", reason)
    bad = judged.where(F.col("reason").isNotNull()).select("meeting_id", "reason")
    rows = judged.where(F.col("reason").isNull()).select("meeting_id", F.posexplode("p.chunks").alias("seg_no", "c"))
    before = F.lag("c.end").over(W.partitionBy("meeting_id").orderBy("seg_no"))
    start = F.coalesce("c.start", before, F.lit(0.0))
    ms = lambda c: F.round(c * 1000).cast("long")
    segments = rows.select("meeting_id", "seg_no", ms(start).alias("start_ms"), ms(F.coalesce("c.end", start)).alias("end_ms"), F.trim("c.text").alias("text")).where("text <> ''")
    return segments, bad


def read_asr_payloads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1).alias("meeting_id"), F.col("value").alias("payload"))
    return parse_asr_payloads(files)


def glossary_of(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: (scope, file, line_no, line) to terms (scope, ord, term) and pairs (scope, ord, wrong, right).

    "#" begins a comment line; "wrong=>right" is a pair whose right side is a term too; the first of equal ones stays, files
    in order of their names.
    """
    clean = lines.withColumn("line", F.trim("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    sides = F.split("line", "=>", 2)
    cut = clean.withColumn("wrong", F.when(F.size(sides) == 2, F.trim(F.get(sides, F.lit(0))))).withColumn("right", F.when(F.size(sides) == 2, F.trim(F.get(sides, F.lit(1)))).otherwise(F.col("line")))
    place = F.struct("file", "line_no")
    terms = cut.where("right <> ''").groupBy("scope", F.col("right").alias("term")).agg(F.min(place).alias("at"))
    pairs = cut.where("wrong <> '' and right <> ''").groupBy("scope", "wrong", "right").agg(F.min(place).alias("at"))
    in_order = lambda df: numbered(df, ["scope"], ["at"], "ord").drop("at", "of")
    return in_order(terms), in_order(pairs)


def read_glossary(spark: SparkSession, path: str, scope: str = "global") -> tuple[DataFrame, DataFrame]:
    files = spark.read.text(path, wholetext=True).select(F.lit(scope).alias("scope"), F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return glossary_of(files)


def pipeline_metrics(logs: DataFrame, marker: str = "pipeline metrics") -> DataFrame:
    """(line_no, line) to (line_no, metrics map) of lines with the marker: its key=int pairs, colours stripped."""
    plain = logs.select("line_no", F.regexp_replace("line", ANSI, "").alias("line")).where(F.col("line").contains(marker))
    keys = F.regexp_extract_all("line", F.lit(r"([A-Za-z_]+)=(\d+)"), 1)
    values = F.regexp_extract_all("line", F.lit(r"([A-Za-z_]+)=(\d+)"), 2)
    return plain.select("line_no", F.map_from_entries(F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x: F.struct(x["k"], x["v"].cast("long")))).alias("metrics")).where(F.size("metrics") > 0)


def upload_mappings(logs: DataFrame) -> DataFrame:
    """(run, upload, task_id) of lines "upload NAME -> task ID"."""
    plain = logs.withColumn("line", F.regexp_replace("line", ANSI, ""))
    found = plain.select("run", F.regexp_extract("line", r"upload (\S+) -> task (\S+)", 1).alias("upload"), F.regexp_extract("line", r"upload (\S+) -> task (\S+)", 2).alias("task_id"))
    return found.where("upload <> ''")


def parse_labelled_transcript(lines: DataFrame) -> DataFrame:
    """(meeting_id, line_no, line) to rows (meeting_id, line_no, start_s, end_s, label, text) of stamped lines."""
    form = r"^\[(\d+):(\d\d):(\d\d)-(\d+):(\d\d):(\d\d)\] ([^：]*)：([\s\S]*)$"
    part = lambda i: F.regexp_extract("line", form, i)
    seconds = lambda i: part(i).cast("long") * 3600 + part(i + 1).cast("long") * 60 + part(i + 2).cast("long")
    return lines.where(F.col("line").rlike(form)).select("meeting_id", "line_no", seconds(1).alias("start_s"), seconds(4).alias("end_s"), part(7).alias("label"), part(8).alias("text"))


MANIFEST = "array<struct<start:double,end:double,language:string,text:string,source:string>>"


def parse_manifest(files: DataFrame) -> DataFrame:
    """(meeting_id, payload JSON list) to (meeting_id, item_no, start_ms, end_ms, language, text, source)."""
    items = files.select("meeting_id", F.posexplode(F.from_json("payload", MANIFEST)).alias("item_no", "i"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return items.select("meeting_id", "item_no", ms("i.start").alias("start_ms"), ms("i.end").alias("end_ms"), "i.language", "i.text", "i.source")


def read_validation_manifest(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1).alias("meeting_id"), F.col("value").alias("payload"))
    return parse_manifest(files)
