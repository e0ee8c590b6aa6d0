"""Readers. Every one takes folder or file patterns, so a corpus is one scan, not a loop of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from boxlake import schemas
from boxlake.functions import geometry as geo
from boxlake.functions.text import is_wiring

FILE = "_metadata.file_path"


def _json(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    """One document per file. A broken document fails the job, so nothing is lost without a word."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", mode).json(path)


def parse_lines(lines: DataFrame, schema: str, line: str = "value") -> DataFrame:
    """One JSON document per line; blank lines do not count, a broken one fails the job."""
    return (lines.where(F.trim(line) != "")
            .select(F.from_json(line, schema, {"mode": "FAILFAST"}).alias("_r")).select("_r.*"))


def _or_empty(spark: SparkSession, read, schema: str) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _rid(marker: str) -> Column:
    """Request id: the folder above a marker file or folder."""
    return F.regexp_extract(FILE, f"([^/]+)/{marker}", 1)


def list_requests(spark: SparkSession, root: str) -> DataFrame:
    """Request ids that own a metadata file, sorted. Reads paths only."""
    return request_ids(spark.read.format("binaryFile").load(f"{root}/*/worksheets_metadata.json").select("path"))


def request_ids(paths: DataFrame) -> DataFrame:
    """Distinct request ids of metadata paths, sorted; other paths do not count."""
    rid = F.regexp_extract("path", "([^/]+)/worksheets_metadata[.]json$", 1)
    return paths.select(rid.alias("rid")).where("rid <> ''").distinct().orderBy("rid")


def worksheets(spark: SparkSession, root: str, rid: str = "*") -> DataFrame:
    """Worksheet metadata of one or all requests; a missing file is an error."""
    df = _json(spark, f"{root}/{rid}/worksheets_metadata.json", schemas.WORKSHEETS)
    return df.select(_rid("worksheets_metadata[.]json").alias("rid"), "*")


def compact_worksheets(sheets: DataFrame, with_geometry: DataFrame) -> DataFrame:
    """Sheets that have a raster, blanks for missing text, flagged when a geometry file exists."""
    url = F.coalesce("image.image_url", F.lit(""))
    has = with_geometry.select("rid", "wid").distinct().withColumn("_g", F.lit(True))
    return (sheets.where(url != "")
            .select("rid", F.col("id").alias("wid"), F.coalesce("name", F.lit("")).alias("name"),
                    F.coalesce("title", F.lit("")).alias("title"), "page_no",
                    F.col("image.width").alias("width"), F.col("image.height").alias("height"))
            .join(has, ["rid", "wid"], "left").withColumn("has_geometry", F.coalesce("_g", F.lit(False))).drop("_g"))


def worksheet_order(sheets: DataFrame) -> DataFrame:
    """Sheets with geometry first, then by page, unknown pages last."""
    return sheets.orderBy(F.desc("has_geometry"), F.asc_nulls_last("page_no"), "wid")


def geometry_documents(spark: SparkSession, path: str) -> DataFrame:
    """Geometry documents with rid and wid from their path."""
    df = _json(spark, path, schemas.GEOMETRIES)
    return df.select(_rid("[^/]*/?[^/]+_geometries[.]json").alias("rid"),
                     F.regexp_extract(FILE, "([^/]+)_geometries[.]json", 1).alias("wid"), "outputs")


def geometries(spark: SparkSession, root: str, rid: str = "*") -> DataFrame:
    df = _json(spark, f"{root}/{rid}/worksheet_geometries/*_geometries.json", schemas.GEOMETRIES)
    docs = df.select(_rid("worksheet_geometries").alias("rid"),
                     F.regexp_extract(FILE, "([^/]+)_geometries[.]json", 1).alias("wid"), "outputs")
    return flatten(docs)


def flatten(docs: DataFrame) -> DataFrame:
    """One row per feature; ``out_idx`` and ``feat_idx`` keep the document order."""
    outs = docs.select(*[c for c in docs.columns if c != "outputs"], F.posexplode("outputs").alias("out_idx", "o"))
    keep = [c for c in outs.columns if c != "o"]
    return (outs.select(*keep, F.col("o.feature.id").alias("feature_id"), F.coalesce("o.feature.name", F.lit("")).alias("layer"),
                        F.col("o.feature.geometry_type").alias("geometry_type"),
                        F.posexplode("o.output_geojson.features").alias("feat_idx", "f"))
            .select(*keep, "feature_id", "layer", "geometry_type", "feat_idx", F.col("f.geometry.type").alias("type"),
                    F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties.tags_info").alias("tags_info")))


def with_dimensions(features: DataFrame, sheets: DataFrame) -> DataFrame:
    """Canvas and raster size of each feature's sheet; a sheet without metadata is an error."""
    dims = sheets.select("rid", "wid", "fe_w", "fe_h", "img_w", "img_h", F.lit(True).alias("_known"))
    joined = features.join(dims, ["rid", "wid"], "left")
    known = F.when(F.col("_known").isNull(), F.raise_error(F.concat(
        F.lit("worksheet not found: "), F.col("wid").cast("string")))).otherwise(F.lit(True))
    return joined.where(known).drop("_known")


def reference_points(features: DataFrame) -> DataFrame:
    """Type 1 features as raster points inside the image, numbered in document order."""
    sx, sy = geo.axis_scale(F.col("img_w"), F.col("fe_w")), geo.axis_scale(F.col("img_h"), F.col("fe_h"))

    def place(c: Column) -> Column:
        x, y = geo.to_raster(F.get(c, F.lit(0)), F.get(c, F.lit(1)), sx, sy)
        p = F.struct(F.rint(x).cast("bigint").alias("x"), F.rint(y).cast("bigint").alias("y"))
        return F.when((F.size(c) == 2) & F.get(c, F.lit(0)).isNotNull(), p)

    # the generator keeps the parsed point a column of its own, so filters do not parse it again
    point = geo.let(F.from_json("coordinates", schemas.POINT), place)
    rows = features.where(F.col("geometry_type") == 1).select("*", F.explode(F.array(point)).alias("_p"))
    p = rows.where(F.col("_p").isNotNull()).withColumn("x", F.col("_p.x")).withColumn("y", F.col("_p.y")).drop("_p")
    return p.where(geo.in_image(F.col("x"), F.col("y"), F.col("img_w"), F.col("img_h")))


def layer_boxes(features: DataFrame, zoom: float = 4.0) -> DataFrame:
    """Boxes of prefixed polygon layers in zoomed pixels, labelled by layer."""
    from boxlake.functions.text import LAYER_PREFIX, label_from_layer

    sx, sy = geo.axis_scale(F.col("img_w"), F.col("fe_w")), geo.axis_scale(F.col("img_h"), F.col("fe_h"))
    rows = features.where(F.col("layer").startswith(LAYER_PREFIX) & (F.col("type") == "Polygon"))
    ring = F.get(F.from_json("coordinates", schemas.POLYGON), F.lit(0))
    return (rows.withColumn("box", geo.ring_box(ring, sx, sy, zoom)).where(F.col("box").isNotNull())
            .withColumn("name", label_from_layer(F.col("layer"))))


def reference_polygons(features: DataFrame, wiring_only: DataFrame | None = None) -> DataFrame:
    """Type 3 features as boxes cut to the image. ``wiring_only`` gives resolved tags to filter by."""
    sx, sy = geo.axis_scale(F.col("img_w"), F.col("fe_w")), geo.axis_scale(F.col("img_h"), F.col("fe_h"))
    rows = features.where(F.col("geometry_type") == 3)
    if wiring_only is not None:
        keep = wiring_only.where((F.col("tag_type") == "category") & is_wiring(F.col("tag")))
        keys = ["rid", "wid", "out_idx", "feat_idx"]
        rows = rows.join(keep.select(*keys).distinct(), keys, "left_semi")
    ring = F.get(F.from_json("coordinates", schemas.POLYGON), F.lit(0))
    box = geo.ring_box_clamped(ring, sx, sy, F.col("img_w"), F.col("img_h"))
    # a generator keeps the box a column of its own, so the filter does not parse the ring again
    return rows.select("*", F.explode(F.array(box)).alias("box")).where(F.col("box").isNotNull())


def sheets_with_patches(polygons: DataFrame) -> DataFrame:
    """Sheets that hold at least one kept polygon."""
    return polygons.select("rid", "wid").distinct()


def tag_library(spark: SparkSession, root: str, rid: str = "*") -> tuple[DataFrame, DataFrame]:
    """Tag and tag-type dimensions (per request); no file gives empty tables."""
    lib = _or_empty(spark, lambda: _json(spark, f"{root}/{rid}/tag_library.json", schemas.TAG_LIBRARY).select(
        _rid("tag_library[.]json").alias("rid"), "tag_types"), "rid string, " + schemas.TAG_LIBRARY)
    return tag_dimensions(lib)


def tag_dimensions(lib: DataFrame) -> tuple[DataFrame, DataFrame]:
    types = lib.select("rid", F.explode("tag_types").alias("t"))
    tags = types.select("rid", F.explode("t.tags").alias("g"))
    return (tags.select("rid", F.col("g.id").alias("tag_id"), F.col("g.name").alias("tag_name")).distinct(),
            types.select("rid", F.col("t.id").alias("type_id"), F.col("t.name").alias("type_name")).distinct())


def _last_of_name(pairs: DataFrame) -> DataFrame:
    """One tag per feature and type name: a later type id of the same name wins."""
    own = [c for c in pairs.columns if c not in ("type_id", "tag_id", "tag_name", "tag_pos")]
    return pairs.groupBy(*own).agg(F.max_by(F.struct("tag_name"), "tag_pos").alias("_t")).select(*own, F.col("_t.tag_name").alias("tag_name"))


def resolve_tags(features: DataFrame, tags: DataFrame, types: DataFrame) -> DataFrame:
    """One row per resolved tag of a feature: unknown types drop out, unknown tags become ''.

    The dimensions join without a hint: Spark broadcasts them while they are small.
    """
    keys = ["rid", "wid", "out_idx", "feat_idx"]
    pairs = (features.select(*keys, F.posexplode("tags_info").alias("tag_pos", "type_id", "v"))
             .select(*keys, "tag_pos", "type_id", F.col("v.tagId").alias("tag_id")))
    named = (pairs.join(types.where(F.coalesce("type_name", F.lit("")) != ""), ["rid", "type_id"])
             .join(tags, ["rid", "tag_id"], "left"))
    return (_last_of_name(named.withColumnRenamed("type_name", "tag_type"))
            .select(*keys, "tag_type", F.coalesce("tag_name", F.lit("")).alias("tag")))


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Crop manifest lines; a missing file is an error."""
    return parse_manifest(spark.read.text(path))


def parse_manifest(lines: DataFrame) -> DataFrame:
    """Manifest rows; blank lines do not count, a broken line or one without a path fails the job."""
    rows = parse_lines(lines, schemas.MANIFEST)
    given = F.when(F.col("path").isNull(), F.raise_error(F.lit("manifest line without a path"))).otherwise(F.col("path"))
    return rows.withColumn("path", given)


def load_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate table, or candidate lines; a broken line fails the job."""
    if path.endswith((".json", ".jsonl")):
        return parse_lines(spark.read.text(path), schemas.CANDIDATES)
    return spark.read.schema(schemas.CANDIDATES).parquet(path)


def load_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a text file, one per line."""
    return parse_ids(spark.read.text(path))


def parse_ids(lines: DataFrame, line: str = "value") -> DataFrame:
    """Trimmed ids; blank and # lines are skipped."""
    return lines.select(F.trim(line).alias("rid")).where((F.col("rid") != "") & ~F.col("rid").startswith("#"))


def load_request_csv(spark: SparkSession, path: str, request_col: str = "request_id", worksheet_col: str = "worksheet_id") -> DataFrame:
    df = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    return df.select(F.col(request_col).alias("rid"), F.col(worksheet_col).alias("wid"))


def parse_request_lines(lines: DataFrame, schema: str, request_col: str = "request_id", worksheet_col: str = "worksheet_id",
                        line: str = "value") -> DataFrame:
    """Request and sheet ids of CSV lines without header; a broken line fails the job."""
    rows = lines.where(F.trim(line) != "").select(F.from_csv(line, schema, {"mode": "FAILFAST"}).alias("_r"))
    return rows.select(F.col(f"_r.{request_col}").alias("rid"), F.col(f"_r.{worksheet_col}").alias("wid"))


def load_category_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CATEGORY_MAP).option("header", True).option("mode", "FAILFAST").csv(path)


def parse_category_map(lines: DataFrame, line: str = "value") -> DataFrame:
    """Category rules of CSV lines with their header; a broken line fails the job."""
    header = schemas.CATEGORY_MAP.replace(" string", "").replace(" int", "").replace(" ", "")
    rows = lines.where((F.trim(line) != "") & (F.trim(line) != header))
    return rows.select(F.from_csv(line, schemas.CATEGORY_MAP, {"mode": "FAILFAST"}).alias("_r")).select("_r.*")


def dryrun_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """File, sheet, box and layer counts of each dry run; an unreadable file keeps a row of nulls."""
    df = _json(spark, path, schemas.DRYRUN, "PERMISSIVE").select(F.regexp_extract(FILE, "([^/]+)$", 1).alias("file"), "*")
    return catalogue(df)


def catalogue(runs: DataFrame) -> DataFrame:
    ok = F.col("_corrupt_record").isNull()
    wid = F.coalesce(F.nullif("target_wid", F.lit("")), "source_wid")
    return runs.select("file", F.when(ok, wid).alias("wid"), F.when(ok, F.col("n_boxes")).alias("n_boxes"),
                       F.when(ok, F.coalesce(F.size("layers"), F.lit(0))).alias("n_layers")).orderBy("file")


def dryrun_layers(runs: DataFrame) -> DataFrame:
    """Polygons of each layer in raster pixels, layers in draw order."""
    fe = F.coalesce("target_fe_wh", "source_fe_wh", "raster_wh")
    sx, sy = geo.axis_scale(F.col("raster_wh")[0], fe[0]), geo.axis_scale(F.col("raster_wh")[1], fe[1])
    layers = runs.select("file", "raster_wh", "target_fe_wh", "source_fe_wh", "styles", "descriptions",
                         F.posexplode("layers").alias("idx", "l"))
    rows = layers.withColumn("f", F.explode("l.output_geojson.features")).where(F.col("f.geometry.type") == "Polygon")
    ring = F.get(F.from_json("f.geometry.coordinates", schemas.POLYGON), F.lit(0))
    order = F.coalesce(F.try_element_at("styles", F.col("l.name"))["layer_order"], F.lit(0))
    return rows.select("file", "idx", F.col("l.name").alias("name"), order.alias("layer_order"),
                       F.coalesce(F.try_element_at("descriptions", F.col("l.name")), F.lit("")).alias("description"),
                       geo.ring_pixels(ring, sx, sy).alias("polygon")).orderBy("file", "layer_order", "idx")


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EMBEDDINGS).parquet(path)


def table_cells(tables: DataFrame) -> DataFrame:
    """Recognised tables flattened to one row per cell (1-based table index as stored)."""
    rows = tables.select("index", F.posexplode("rows").alias("row", "cells"))
    return rows.select("index", "row", F.posexplode("cells").alias("col", "c")).select(
        "index", "row", "col", F.col("c.bbox").alias("bbox"), F.col("c.value").alias("value"))
