"""Writers and export layouts. Bulk data stays in partitioned tables; no document is built on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from boxlake.functions.geometry import Box, normalized_box
from boxlake.functions.text import fingerprint
from boxlake.operators.masks import mask, pack, unpack
from boxlake.operators.ranking import exact_rank


def write_candidates(rows: DataFrame, path: str) -> None:
    """Candidate manifest, one folder per split so a split reads only its own files."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def write_embeddings(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


# --- hits store ----------------------------------------------------------------------


def hits_key(*params: Column) -> Column:
    """Key of a scan: every parameter that changes its result."""
    return fingerprint(F.lit("segmasks_hits"), *params)


def write_hits(hits: DataFrame, path: str, scans: DataFrame | None = None) -> None:
    """Store scan results under their parameter key; other keys stay untouched. ``scans`` lists the keys that
    were scanned, so that one without hits is known to be done; by default those with hits."""
    hits.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_key").parquet(path)
    counts = hits.groupBy("scan_key").agg(F.count("*").alias("n_hits"))
    done = counts if scans is None else (scans.select("scan_key").distinct().join(counts, "scan_key", "left")
                                         .select("scan_key", F.coalesce("n_hits", F.lit(0)).alias("n_hits")))
    done.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{path}.scans")


def finished_scans(spark: SparkSession, path: str) -> DataFrame:
    """Keys that were scanned, with the number of hits of the last time."""
    rows = spark.read.parquet(f"{path}.scans")
    return rows.groupBy("scan_key").agg(F.max_by("n_hits", "at").alias("n_hits"))


def read_hits(spark: SparkSession, path: str, scan_key: str, min_score: float = 0.0) -> DataFrame:
    """Hits of one scan at or above a score: one partition, and the score reaches the scan. The key is read as
    text, whatever its folder's name looks like; it comes back empty for a scan without hits."""
    found = spark.read.parquet(path).schema
    typed = StructType([StructField(f.name, StringType() if f.name == "scan_key" else f.dataType) for f in found])
    return spark.read.schema(typed).parquet(path).where((F.col("scan_key") == scan_key) & (F.col("score") >= min_score))


def write_hit_masks(masks: DataFrame, path: str) -> None:
    """Masks of hits (scan_key, hit_id, mask) as a child table of the store, one row per run: an overlay filtered anew
    by score or size reads the runs of its hits and scans no image again. Other keys stay untouched."""
    runs = unpack(masks, ["scan_key", "hit_id"])
    runs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_key").parquet(f"{path}.masks")


def read_hit_masks(spark: SparkSession, path: str, hits: DataFrame) -> DataFrame:
    """``hits`` (scan_key, hit_id, ...) with their stored masks; a hit whose mask has no pixels has an empty one."""
    found = spark.read.parquet(f"{path}.masks").schema
    typed = StructType([StructField(f.name, StringType() if f.name == "scan_key" else f.dataType) for f in found])
    key = ["scan_key", "hit_id"]
    runs = spark.read.schema(typed).parquet(f"{path}.masks").join(hits.select(*key), key, "left_semi")
    empty = mask(F.lit(0), F.array().cast("array<array<struct<xa:int,xb:int>>>"))
    return hits.join(pack(runs, key), key, "left").withColumn("mask", F.coalesce("mask", empty))


def draw_order(hits: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Visible hits, weakest first; ``colour`` keeps the position in the stored order."""
    return hits.where(F.col("score") >= min_score).withColumn("colour", F.col("hit_id")).orderBy("score", "hit_id")


# --- split documents -----------------------------------------------------------------


def split_tables(split_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split document as tables: (path, split, label) and the class dimension (name, label)."""
    return split_rows.select("path", "split", "label"), split_rows.select("name", "label").distinct()


def write_split(split_rows: DataFrame, stats: DataFrame, root: str) -> None:
    assign, classes = split_tables(split_rows)
    assign.write.mode("overwrite").partitionBy("split").parquet(f"{root}/assignment")
    classes.orderBy("name").write.mode("overwrite").json(f"{root}/classes")
    stats.coalesce(1).write.mode("overwrite").json(f"{root}/stats")


def load_or_make_split(spark: SparkSession, root: str, manifest: DataFrame, ids: DataFrame | None, min_per_class: int = 5,
                       frac: float = 0.2, seed: int = 0) -> DataFrame:
    """A stored split is reused; else id holdout when the id table has both sides, else stratified."""
    from pyspark.sql.utils import AnalysisException

    from boxlake.operators.curation import holdout_split, stratified_split

    try:
        return spark.read.parquet(f"{root}/assignment")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    sides = set() if ids is None else {r.split for r in ids.select("split").distinct().limit(3).collect()}
    rows = holdout_split(manifest, ids, min_per_class) if {"train", "val"} <= sides else stratified_split(
        manifest, min_per_class, frac, seed)
    return rows.select("path", "split", "label")


# --- annotation exports --------------------------------------------------------------


def coco_tables(ann: DataFrame, image: Sequence[str] = ("sheet_id",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """COCO images, annotations and categories with dense ids by sorted key.

    ``ann`` has the image key, ann_key, name, x, y, w, h, width, height. Image and annotation
    ids start at 1, category ids at 0.
    """
    image = list(image)
    images = exact_rank(ann.groupBy(*image).agg(F.max("width").alias("width"), F.max("height").alias("height")),
                        [], [F.asc(c) for c in image], "id")
    cats = exact_rank(ann.select("name").distinct(), [], [F.asc("name")], "id").withColumn("id", F.col("id") - 1)
    rows = exact_rank(ann.select(*image, "ann_key", "name", "x", "y", "w", "h"), [],
                      [F.asc(c) for c in image] + [F.asc("ann_key")], "id")
    b = Box.cols()
    rows = (rows.join(images.select(*image, F.col("id").alias("image_id")), image)
            .join(cats.select("name", F.col("id").alias("category_id")), "name")
            .select("id", "image_id", "category_id", F.array(*b).alias("bbox"), (b.w * b.h).alias("area"),
                    F.lit(0).alias("iscrowd"),
                    F.array(F.array(b.x, b.y, b.x1, b.y, b.x1, b.y1, b.x, b.y1)).alias("segmentation")))
    names = F.format_string("image_%03d.png", F.col("id"))
    return (images.withColumn("file_name", names), rows, cats.withColumn("supercategory", F.lit("equipment")))


def write_coco(ann: DataFrame, root: str, image: Sequence[str] = ("sheet_id",)) -> None:
    """Three line-delimited tables; a reader that wants one file joins them, tasks never do."""
    for name, df in zip(("images", "annotations", "categories"), coco_tables(ann, image)):
        df.write.mode("overwrite").json(f"{root}/{name}")


def yolo_lines(ann: DataFrame, image: Sequence[str] = ("sheet_id",)) -> DataFrame:
    """Label lines: class id, centre and size as fractions with three decimals."""
    cats = exact_rank(ann.select("name").distinct(), [], [F.asc("name")], "class_id").withColumn("class_id", F.col("class_id") - 1)
    n = normalized_box(Box.cols(), F.col("width"), F.col("height"))
    line = F.format_string("%d %.3f %.3f %.3f %.3f", F.col("class_id"), *n)
    return ann.join(cats, "name").select(*image, "ann_key", line.alias("line"))


def write_yolo(ann: DataFrame, root: str, image: str = "sheet_id", buckets: int = 64) -> None:
    """Label lines with their image by hash bucket, and the class, statistics and image tables."""
    lines = yolo_lines(ann, [image]).select(image, F.col("line").alias("value"))
    # a folder per hash bucket, not per image: a few files however many images there are
    lines = lines.withColumn("bucket", F.pmod(F.xxhash64(image), F.lit(buckets)))
    lines.write.mode("overwrite").partitionBy("bucket").option("header", True).csv(f"{root}/labels")
    ann.select("name").distinct().orderBy("name").write.mode("overwrite").text(f"{root}/classes")
    ann.groupBy("name").agg(F.count("*").alias("n")).write.mode("overwrite").option("header", True).csv(f"{root}/category_statistics")
    ann.select(image).distinct().write.mode("overwrite").option("header", True).csv(f"{root}/image_metadata")


# --- names, tables, reports ----------------------------------------------------------


def feature_names(features: DataFrame, name: str = "name") -> DataFrame:
    """Distinct feature names, sorted."""
    return features.select(F.col(name).alias("value")).distinct().orderBy("value")


def write_feature_names(features: DataFrame, path: str, name: str = "name") -> None:
    feature_names(features, name).write.mode("overwrite").text(path)


def table_records(cells: DataFrame) -> DataFrame:
    """Flat cells back to nested records; a table's cells are bounded by one recognised page."""
    rows = cells.groupBy("index", "row").agg(F.array_sort(F.collect_list(F.struct("col", "bbox", "value"))).alias("c"))
    rows = rows.select("index", "row", F.transform("c", lambda x: F.struct(x["bbox"].alias("bbox"), x["value"].alias("value"))).alias("c"))
    t = rows.groupBy("index").agg(F.array_sort(F.collect_list(F.struct("row", "c"))).alias("r"))
    return t.select("index", F.transform("r", lambda x: x["c"]).alias("rows"))


def report_json(checks: DataFrame) -> DataFrame:
    """Verify report as one JSON document (a dozen checks)."""
    c = F.array_sort(F.collect_list(F.struct("pos", "name", "ok", "detail")))
    return checks.agg(F.to_json(F.struct(F.bool_and("ok").alias("ok"), c.alias("checks"))).alias("value"))


def write_report(checks: DataFrame, root: str) -> None:
    from boxlake.operators.quality import report_markdown

    report_json(checks).coalesce(1).write.mode("overwrite").text(f"{root}/verify_report_json")
    (report_markdown(checks).coalesce(1).sortWithinPartitions("pos").select(F.col("line").alias("value"))
     .write.mode("overwrite").text(f"{root}/verify_report_md"))
