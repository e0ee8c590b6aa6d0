"""Registered corpus queries: each applies its operator to the whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boxlake.llm import (
    cover_tree, decontaminate, html_extract, language_id, licenses, line_quality, merkle, near_dup, packing, quality_rules, spelling,
    suffix_dedup, url_filter)
from boxlake.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": lambda spark, d: decontaminate.digest(read(spark, d, "documents"), read(spark, d, "benchmark")),
    "op2_suffix_dedup": lambda spark, d: suffix_dedup.digest(read(spark, d, "documents")),
    "op3_license_scan": lambda spark, d: licenses.digest(read(spark, d, "documents")),
    "op4_line_quality": lambda spark, d: line_quality.digest(read(spark, d, "documents"), read(spark, d, "labels")),
    "op5_quality_rules": lambda spark, d: quality_rules.digest(read(spark, d, "documents")),
    "op6_url_filter": lambda spark, d: url_filter.digest(read(spark, d, "pages")),
    "op7_near_dup": lambda spark, d: near_dup.digest(read(spark, d, "documents")),
    "op8_extract_html": lambda spark, d: html_extract.digest(read(spark, d, "pages")),
    "op9_pack": lambda spark, d: packing.digest(read(spark, d, "documents")),
    "op10_language_id": lambda spark, d: language_id.digest(read(spark, d, "documents")),
    "op11_embedding_near_dup": lambda spark, d: cover_tree.digest(read(spark, d, "embeddings")),
    "op12_merkle_manifest": lambda spark, d: merkle.digest(read(spark, d, "documents")),
    "op13_spelling_variants": lambda spark, d: spelling.digest(read(spark, d, "documents")),
}

ORACLES: dict[str, str] = {
    "op5_quality_rules": quality_rules.oracle(),
    "op6_url_filter": url_filter.oracle(),
}
