"""What the entry file registers for this subpackage: queries and, where SQL expresses them, their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, hard_negatives, html_text, language_id, license_scan, line_dedup, packing, quality_fm, quality_rules, simhash, source_mix, token_links, token_output
from .common import load


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.report(load(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(load(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(load(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.report(load(spark, sf_dir, "documents"))


def op7_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(load(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.report(load(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.report(load(spark, sf_dir, "pages"))


def op11_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links.report(load(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(load(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.report(load(spark, sf_dir, "embeddings"))


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.pages_report(load(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_decontaminate, op3_license_scan, op4_line_dedup, op5_simhash, op6_token_output, op7_quality_fm, op8_quality_rules, op9_source_mix, op10_html_text, op11_token_links, op12_packing, op13_hard_negatives, page_language)
}
ORACLES: dict[str, str] = {
    "op2_decontaminate": decontaminate.oracle(),
    "op3_license_scan": license_scan.oracle(),
    "op4_line_dedup": line_dedup.oracle(),
    "op9_source_mix": source_mix.oracle(),
    "op13_hard_negatives": hard_negatives.oracle(),
}
