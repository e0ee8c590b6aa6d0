"""Corpus profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def geometry_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("geometry_type").agg(F.count("*").alias("n"))


def top_layers(features: DataFrame, k: int = 10) -> DataFrame:
    return features.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("name")).limit(k)


def profile(counts: DataFrame, value: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """count, mean, min, max, interpolated 95th percentile and sample deviation of a count column.

    The exact percentile keeps a map of distinct values; counts have few, so it stays small.
    """
    return counts.groupBy(*by).agg(
        F.count("*").alias("n_units"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.percentile(value, F.lit(0.95)).alias("p95"), F.stddev_samp(value).alias("std"))


def points_per_sheet(features: DataFrame, sheet: Sequence[str] = ("rid", "wid")) -> DataFrame:
    return features.where(F.col("geometry_type") == 1).groupBy(*sheet).agg(F.count("*").alias("n"))


def dominant_names(features: DataFrame, rid: str = "rid") -> DataFrame:
    """Per request the number of names that occur at least as often as its 95th percentile."""
    occ = features.groupBy(rid, "name").agg(F.count("*").alias("n"))
    lim = occ.groupBy(rid).agg(F.percentile("n", F.lit(0.95)).alias("_p"))
    return occ.join(lim, rid).where(F.col("n") >= F.col("_p")).groupBy(rid).agg(F.count("*").alias("n"))


def build_statistics(annotations: DataFrame, image: Sequence[str], category: str) -> DataFrame:
    return annotations.agg(F.count("*").alias("annotation_count"), F.count_distinct(*image).alias("image_count"),
                           F.count_distinct(category).alias("category_count"))


def category_distribution(annotations: DataFrame, category: str) -> DataFrame:
    return annotations.groupBy(category).agg(F.count("*").alias("n"))
