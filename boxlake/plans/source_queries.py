"""Nested documents derived from the tables, parsed and flattened; export layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from boxlake import schemas
from boxlake.functions.numeric import round_exact_sql
from boxlake.plans.registry import query
from boxlake.sources import readers as rd
from boxlake.sources import writers as wr


def documents(v):
    """One geometry document per order as JSON text, read back with the fixed schema.

    Output 0 is a boxed polygon layer with tags, output 1 a point layer with two points (the
    second is outside the image for most orders), output 2 a line layer.
    """
    x, y = F.col("o_orderkey") * 7919 % 1400, F.col("o_orderkey") * 104729 % 990
    w, h = 1 + F.col("o_orderkey") % 14, 18 + F.col("o_custkey") % 14

    def num(c):
        return c.cast("double")

    def pt(a, b):
        return F.array(num(a), -num(b))

    ring = F.array(pt(x, y), pt(x + w, y), pt(x + w, y + h), pt(x, y + h), pt(x, y))
    # kinds differ in depth, so coordinates enter as JSON text and are spliced into the document
    coords = [F.to_json(F.array(ring)), F.to_json(pt(x, y)), F.to_json(pt(x * 3, y * 2)), F.to_json(F.array(pt(x, y), pt(x + 50, y + 20)))]
    tags = F.concat(F.lit('{"t'), (F.col("o_orderkey") % 3).cast("string"), F.lit('":{"tagId":"g'), (F.col("o_custkey") % 4).cast("string"), F.lit('"}}'))

    def feature(kind, c, extra=F.lit("{}")):
        return F.concat(F.lit('{"geometry":{"type":"%s","coordinates":' % kind), c, F.lit('},"properties":{"tags_info":'), extra, F.lit("}}"))

    def output(name, code, *feats):
        return F.concat(F.lit('{"feature":{"id":"f%d","name":' % code), F.concat(F.lit('"'), name, F.lit('"')), F.lit(',"geometry_type":%d},"output_geojson":{"features":[' % code),
                        F.concat_ws(",", *feats), F.lit("]}}"))

    text = F.concat(F.lit('{"outputs":['), F.concat_ws(
        ",", output(F.concat(F.lit("bbox_"), "o_orderpriority"), 3, feature("Polygon", coords[0], tags)),
        output(F.col("o_orderstatus"), 1, feature("Point", coords[1]), feature("Point", coords[2])),
        output(F.lit("wire"), 2, feature("LineString", coords[3]))), F.lit("]}"))
    rid = F.concat(F.lit("r"), (F.col("o_custkey") % 7).cast("string"))
    # a generator keeps the parsed outputs a column of their own: the filter that Spark infers for exploding them would parse again
    return v("orders").select(rid.alias("rid"), F.col("o_orderkey").cast("string").alias("wid"),
                              F.explode(F.array(F.from_json(text, schemas.GEOMETRIES)["outputs"])).alias("outputs"))


DIMS = {"fe_w": 1400, "fe_h": 1000, "img_w": 1050, "img_h": 750}


def features(v):
    return rd.flatten(documents(v))


def placed(v):
    f = features(v)
    sheets = v("orders").select(F.concat(F.lit("r"), (F.col("o_custkey") % 7).cast("string")).alias("rid"), F.col("o_orderkey").cast("string").alias("wid"),
                                *[F.lit(n).cast("bigint").alias(c) for c, n in DIMS.items()])
    return rd.with_dimensions(f, sheets)


G = """g AS (SELECT concat('r', o_custkey % 7) AS rid, CAST(o_orderkey AS VARCHAR) AS wid, o_orderkey AS k, o_custkey AS c, o_orderkey * 7919 % 1400 AS x, o_orderkey * 104729 % 990 AS y,
 1 + o_orderkey % 14 AS w, 18 + o_custkey % 14 AS h, o_orderpriority AS pri, o_orderstatus AS st FROM orders)"""


@query("s3_geometries", f"""WITH {G} SELECT rid, wid, 0::INTEGER AS out_idx, 0::INTEGER AS feat_idx, concat('bbox_', pri) AS layer, 3::INTEGER AS geometry_type, 'Polygon' AS type FROM g
 UNION ALL SELECT rid, wid, 1, unnest([0, 1]), st, 1, 'Point' FROM g UNION ALL SELECT rid, wid, 2, 0, 'wire', 2, 'LineString' FROM g""")
def _(v):
    return features(v).select("rid", "wid", "out_idx", "feat_idx", "layer", "geometry_type", "type")


PTS = f"""{G}, p AS (SELECT rid, wid, 0 AS f, st, x * 0.75::DOUBLE AS px, y * 0.75::DOUBLE AS py FROM g UNION ALL SELECT rid, wid, 1, st, x * 3 * 0.75::DOUBLE, y * 2 * 0.75::DOUBLE FROM g)"""


@query("p5_p6_reference_points", f"""WITH {PTS} SELECT rid, wid, CAST(f AS INTEGER) AS feat_idx, st AS name, CAST(round_even(px, 0) AS BIGINT) AS x, CAST(round_even(py, 0) AS BIGINT) AS y FROM p WHERE round_even(px, 0) < 1050 AND round_even(py, 0) < 750""")
def _(v):
    return rd.reference_points(placed(v)).select("rid", "wid", "feat_idx", F.col("layer").alias("name"), "x", "y")


@query("p7a_layer_boxes", f"""WITH {G} SELECT rid, wid, pri AS name, CAST(round_even(x * 0.75::DOUBLE * 4, 0) AS BIGINT) AS x, CAST(round_even(y * 0.75::DOUBLE * 4, 0) AS BIGINT) AS y, CAST(round_even((x + w) * 0.75::DOUBLE * 4 - x * 0.75::DOUBLE * 4, 0) AS BIGINT) AS w,
 CAST(round_even((y + h) * 0.75::DOUBLE * 4 - y * 0.75::DOUBLE * 4, 0) AS BIGINT) AS h FROM g WHERE (x + w) * 3.0 - x * 3.0 >= 2""")
def _(v):
    return rd.layer_boxes(placed(v)).select("rid", "wid", "name", "box.*")


@query("p7a_layer_boxes_base_zoom", f"""WITH {G} SELECT rid, wid, CAST(round_even((x + w) * 0.75::DOUBLE - x * 0.75::DOUBLE, 0) AS BIGINT) AS w FROM g WHERE w * 0.75 >= 2 AND h * 0.75 >= 2""")
def _(v):
    return rd.layer_boxes(placed(v), 1.0).select("rid", "wid", "box.w")


@query("p7b_reference_polygons", f"""WITH {G} SELECT * FROM (SELECT rid, wid, CAST(greatest(0, round_even(x * 0.75::DOUBLE, 0)) AS BIGINT) AS x, CAST(greatest(0, round_even(y * 0.75::DOUBLE, 0)) AS BIGINT) AS y,
 CAST(least(1050, round_even((x + w) * 0.75::DOUBLE, 0)) - round_even(x * 0.75::DOUBLE, 0) AS BIGINT) AS w, CAST(least(750, round_even((y + h) * 0.75::DOUBLE, 0)) - round_even(y * 0.75::DOUBLE, 0) AS BIGINT) AS h FROM g) WHERE w > 0 AND h > 0""")
def _(v):
    return rd.reference_polygons(placed(v)).select("rid", "wid", "box.*")


def library(v):
    """Tag library per request; type t2 has no name, tag g3 is unknown."""
    rids = v("orders").select(F.concat(F.lit("r"), (F.col("o_custkey") % 7).cast("string")).alias("rid")).distinct()
    text = """{"tag_types":[{"id":"t0","name":"category","tags":[{"id":"g0","name":"WIRING_DEVICES"},{"id":"g1","name":"LIGHTING"}]},
     {"id":"t1","name":"source","tags":[{"id":"g2","name":"LEGEND"}]},{"id":"t2","name":"","tags":[]}]}"""
    return rids.select("rid", F.from_json(F.lit(text), schemas.TAG_LIBRARY)["tag_types"].alias("tag_types"))


TAGS = f"{G}, tg AS (SELECT rid, wid, k, CASE k % 3 WHEN 0 THEN 'category' WHEN 1 THEN 'source' END AS tag_type, CASE c % 4 WHEN 0 THEN 'WIRING_DEVICES' WHEN 1 THEN 'LIGHTING' WHEN 2 THEN 'LEGEND' ELSE '' END AS tag FROM g WHERE k % 3 < 2)"


@query("s4_tag_dimensions", "WITH r AS (SELECT DISTINCT concat('r', o_custkey % 7) AS rid FROM orders) SELECT rid, 'tag' AS dim, unnest(['g0', 'g1', 'g2']) AS id, unnest(['WIRING_DEVICES', 'LIGHTING', 'LEGEND']) AS name FROM r UNION ALL SELECT rid, 'type', unnest(['t0', 't1', 't2']), unnest(['category', 'source', '']) FROM r")
def _(v):
    tags, types = rd.tag_dimensions(library(v))
    return (tags.select("rid", F.lit("tag").alias("dim"), F.col("tag_id").alias("id"), F.col("tag_name").alias("name"))
            .unionByName(types.select("rid", F.lit("type").alias("dim"), F.col("type_id").alias("id"), F.col("type_name").alias("name"))))


@query("j1_resolve_tags", f"WITH {TAGS} SELECT rid, wid, tag_type, tag FROM tg")
def _(v):
    tags, types = rd.tag_dimensions(library(v))
    return rd.resolve_tags(features(v), tags, types).select("rid", "wid", "tag_type", "tag")


@query("p9_wiring_polygons", f"WITH {TAGS} SELECT tg.rid, tg.wid FROM tg JOIN g USING (rid, wid) WHERE tag_type = 'category' AND tag = 'WIRING_DEVICES' AND least(1050, round_even((x + w) * 0.75::DOUBLE, 0)) > round_even(x * 0.75::DOUBLE, 0) AND least(750, round_even((y + h) * 0.75::DOUBLE, 0)) > round_even(y * 0.75::DOUBLE, 0)")
def _(v):
    f = placed(v)
    tags, types = rd.tag_dimensions(library(v))
    return rd.sheets_with_patches(rd.reference_polygons(f, rd.resolve_tags(f, tags, types)))


@query("j2_sheet_dimensions", f"WITH {G} SELECT rid, count(*) * 4 AS n, CAST(1400 AS BIGINT) AS fe_w FROM g GROUP BY rid")
def _(v):
    return placed(v).groupBy("rid").agg(F.count("*").alias("n"), F.max("fe_w").alias("fe_w"))


def sheets(v):
    """Worksheet metadata from the customers: every fifth has no raster, pages are sometimes unknown."""
    c = v("customer")
    page = F.when(F.col("c_custkey") % 6 != 0, (F.col("c_custkey") % 40).cast("int"))
    url = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("http://x/"), F.col("c_custkey").cast("string"))).otherwise("")
    return c.select(F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("rid"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"),
                    F.lit(None).cast("string").alias("title"), page.alias("page_no"),
                    F.struct(F.lit(1400).alias("width"), F.lit(1000).alias("height"), url.alias("image_url")).alias("image"))


@query("s2_p1_compact_worksheets", """SELECT concat('r', c_nationkey) AS rid, CAST(c_custkey AS VARCHAR) AS wid, c_name AS name, '' AS title, CAST(CASE WHEN c_custkey % 6 <> 0 THEN c_custkey % 40 END AS INTEGER) AS page_no,
 CAST(1400 AS INTEGER) AS width, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 450000) AS has_geometry FROM customer WHERE c_custkey % 5 <> 0""")
def _(v):
    have = v("orders").where("o_orderstatus = 'P' AND o_totalprice > 450000").join(
        v("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("rid"), F.col("o_custkey").cast("string").alias("wid"))
    return rd.compact_worksheets(sheets(v), have).drop("height")


@query("w2_worksheet_order", """SELECT wid, page_no, row_number() OVER (ORDER BY g DESC, page_no NULLS LAST, wid) AS pos FROM (SELECT CAST(c_custkey AS VARCHAR) AS wid, CAST(CASE WHEN c_custkey % 6 <> 0 THEN c_custkey % 40 END AS INTEGER) AS page_no, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000) AS g FROM customer WHERE c_custkey % 5 <> 0)""")
def _(v):
    from boxlake.operators.ranking import exact_rank

    have = v("orders").where("o_totalprice > 490000").join(v("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("r"), F.col("c_nationkey").cast("string")).alias("rid"), F.col("o_custkey").cast("string").alias("wid"))
    s = rd.compact_worksheets(sheets(v), have)
    order = [F.desc("has_geometry"), F.asc_nulls_last("page_no"), F.asc("wid")]
    return exact_rank(s.select("wid", "page_no", "has_geometry"), [], order, "pos").select("wid", "page_no", "pos")


@query("s1_requests", "SELECT DISTINCT concat('r', c_nationkey) AS rid FROM customer")
def _(v):
    """Metadata paths, one per customer, beside paths that are none."""
    at = F.concat(F.lit("file:/lake/"), "rid", F.when(F.col("id").cast("long") % 3 == 0, "/other.json").otherwise("/worksheets_metadata.json"))
    both = sheets(v).select(F.explode(F.array(at, F.concat(F.lit("/lake/"), "rid", F.lit("/worksheets_metadata.json")))).alias("path"))
    return rd.request_ids(both)


@query("s5_u1_manifest", """SELECT concat('/lake/', rid, '/', path) AS path, name, score, zoom FROM (SELECT source AS rid, concat(lang, '/', doc_id, '.png') AS path, lang AS name, CAST(n_chars AS DOUBLE) AS score, 4.0::DOUBLE AS zoom FROM documents)""")
def _(v):
    """Manifest lines as JSON text, read with the manifest schema, paths made absolute."""
    from boxlake.functions.text import resolve_path

    line = F.to_json(F.struct(F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"), F.col("lang").alias("name"),
                              F.col("source").alias("rid"), F.col("n_chars").cast("double").alias("score"), F.lit(4.0).alias("zoom")))
    m = rd.parse_manifest(v("documents").select(F.explode(F.array(line, F.lit("  "))).alias("value")))
    return m.select(resolve_path(F.concat(F.lit("/lake/"), "rid"), F.col("path")).alias("path"), "name", "score", "zoom")


@query("s9_dryrun_catalogue", """SELECT concat(page_id, '.json') AS file, CASE WHEN page_id % 9 <> 0 THEN CASE WHEN page_id % 2 = 0 THEN concat('t', page_id) ELSE concat('s', page_id) END END AS wid,
 CASE WHEN page_id % 9 <> 0 THEN CAST(len(html) AS INTEGER) END AS n_boxes, CASE WHEN page_id % 9 <> 0 THEN CAST(page_id % 3 AS INTEGER) END AS n_layers FROM pages""")
def _(v):
    i = F.col("page_id").cast("string")
    target = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('"t'), i, F.lit('"'))).otherwise(F.lit("null"))
    layers = F.array_join(F.array_repeat(F.lit('{"name":"L"}'), (F.col("page_id") % 3).cast("int")), ",")
    text = F.concat(F.lit('{"source_wid":"s'), i, F.lit('","target_wid":'), target, F.lit(',"n_boxes":'), F.length("html").cast("string"), F.lit(',"layers":['), layers, F.lit("]}"))
    broken = F.when(F.col("page_id") % 9 == 0, F.concat(F.lit('{"source_wid": oops'), i)).otherwise(text)
    run = F.from_json(broken, schemas.DRYRUN, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return rd.catalogue(v("pages").select(F.concat(i, F.lit(".json")).alias("file"), run.alias("r")).select("file", "r.*"))


@query("p32_layer_polygons", f"""SELECT file, name, layer_order, {round_exact_sql('a', 1)} AS x0, {round_exact_sql('b', 1)} AS x1, n FROM (SELECT CAST(page_id AS VARCHAR) AS file, 'L' AS name,
 CAST(page_id % 5 AS INTEGER) AS layer_order, page_id * 0.75::DOUBLE AS a, (page_id + 7) * 0.75::DOUBLE AS b, 3::INTEGER AS n FROM pages)""")
def _(v):
    p = F.col("page_id").cast("string")
    q = (F.col("page_id") + 7).cast("string")
    ring = F.concat(F.lit("[[["), p, F.lit(",-10],["), q, F.lit(",-10],["), q, F.lit(",-30],["), p, F.lit(",-10]]]"))
    text = F.concat(F.lit('{"raster_wh":[1050,750],"target_fe_wh":[1400,1000],"styles":{"L":{"layer_order":'), (F.col("page_id") % 5).cast("string"),
                    F.lit('}},"layers":[{"name":"L","output_geojson":{"features":[{"geometry":{"type":"Polygon","coordinates":'), ring, F.lit("}}]}}]}"))
    runs = v("pages").select(p.alias("file"), F.from_json(text, schemas.DRYRUN).alias("r")).select("file", "r.*")
    poly = F.col("polygon")
    return rd.dryrun_layers(runs).select("file", "name", "layer_order", poly[0][0].alias("x0"), poly[1][0].alias("x1"), F.size(poly).alias("n"))


# --- exports -------------------------------------------------------------------------


def annotations(v):
    return v("v_gt").select("sheet_id", F.col("gt_id").alias("ann_key"), "name", "x", "y", "w", "h", F.lit(1740).alias("width"), F.lit(1040).alias("height"))


@query("s14_coco_annotations", """WITH c AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS cid FROM (SELECT DISTINCT name FROM v_gt)), i AS (SELECT sheet_id, row_number() OVER (ORDER BY sheet_id) AS iid FROM (SELECT DISTINCT sheet_id FROM v_gt))
 SELECT row_number() OVER (ORDER BY sheet_id, gt_id) AS id, iid AS image_id, cid AS category_id, x AS bx, w AS bw, w * h AS area, CAST(0 AS INTEGER) AS iscrowd, y + h AS seg_y2 FROM v_gt JOIN c USING (name) JOIN i USING (sheet_id)""", "v_gt")
def _(v):
    _, ann, _ = wr.coco_tables(annotations(v))
    return ann.select("id", "image_id", "category_id", F.col("bbox")[0].alias("bx"), F.col("bbox")[2].alias("bw"), "area", "iscrowd", F.col("segmentation")[0][5].alias("seg_y2"))


@query("s14_coco_images", "SELECT sheet_id, row_number() OVER (ORDER BY sheet_id) AS id, format('image_{:03d}.png', row_number() OVER (ORDER BY sheet_id)) AS file_name FROM (SELECT DISTINCT sheet_id FROM v_gt)", "v_gt")
def _(v):
    return wr.coco_tables(annotations(v))[0].select("sheet_id", "id", "file_name")


@query("s14_coco_categories", "SELECT name, row_number() OVER (ORDER BY name) - 1 AS id, 'equipment' AS supercategory FROM (SELECT DISTINCT name FROM v_gt)", "v_gt")
def _(v):
    return wr.coco_tables(annotations(v))[2]


@query("s15_yolo_lines", """WITH c AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS cid FROM (SELECT DISTINCT name FROM v_gt))
 SELECT sheet_id, gt_id AS ann_key, cid, abs(cx - (x + w / 2.0) / 1740) <= 0.00051 AND abs(hh - h / 1040.0) <= 0.00051 AS ok FROM (SELECT *, round((x + w / 2.0) / 1740, 3) AS cx, round(h / 1040.0, 3) AS hh FROM v_gt) JOIN c USING (name)""", "v_gt")
def _(v):
    a = annotations(v)
    part = F.split("line", " ")
    near = (F.abs(part[1].cast("double") - (F.col("x") + F.col("w") / 2) / 1740) <= 0.00051) & (F.abs(part[4].cast("double") - F.col("h") / 1040) <= 0.00051)
    return (wr.yolo_lines(a).join(a, ["sheet_id", "ann_key"])
            .select("sheet_id", "ann_key", part[0].cast("bigint").alias("cid"), near.alias("ok")))


def cells(v):
    return v("conversations").select((F.col("conv_id") + 1).alias("index"), F.col("turn").alias("row"),
                                     F.posexplode(F.array(F.col("role"), F.col("text"))).alias("col", "value")).withColumn(
        "bbox", F.array(F.col("col") * 100, F.col("row") * 20, F.col("col") * 100 + 99, F.col("row") * 20 + 19))


@query("s16_table_records", """SELECT conv_id + 1 AS "index", row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS "row", unnest([0, 1]) AS col, unnest([role, text]) AS value, turn * 20 AS y FROM conversations""")
def _(v):
    """Cells to nested table records and back."""
    return rd.table_cells(wr.table_records(cells(v))).select("index", F.col("row").cast("bigint").alias("row"), "col", "value", F.col("bbox")[1].alias("y"))


@query("s6_id_list", "SELECT DISTINCT trim(source) AS rid FROM documents WHERE source <> 'src3'")
def _(v):
    """Id lines with blanks and comments around them."""
    line = F.when(F.col("source") == "src3", F.concat(F.lit("# "), "source")).otherwise(F.concat(F.lit("  "), "source", F.lit(" ")))
    return rd.parse_ids(v("documents").select(F.explode(F.array(line, F.lit(" "))).alias("value"))).distinct()


@query("s7_request_csv", "SELECT concat('r', c_nationkey) AS rid, CAST(c_custkey AS VARCHAR) AS wid FROM customer")
def _(v):
    """Request and sheet columns of CSV lines, under other names."""
    line = F.to_csv(F.struct(F.concat(F.lit("r"), F.col("c_nationkey").cast("string")), F.col("c_name"), F.col("c_custkey")))
    lines = v("customer").select(line.alias("value"))
    return rd.parse_request_lines(lines, "req string, title string, sheet string", "req", "sheet")


@query("s11_candidates", """SELECT CASE WHEN sheet_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS n, CAST(sum(w * h) AS BIGINT) AS area, count(DISTINCT sheet_id) AS sheets FROM v_pred GROUP BY 1""", "v_pred")
def _(v):
    """Candidate lines as JSON, read with the candidate schema and tallied per split."""
    line = F.to_json(F.struct(F.col("sheet_id").cast("string").alias("wid"), F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), (F.col("w") * F.col("h")).cast("int").alias("area"),
                              F.when(F.col("sheet_id") % 5 == 0, "val").otherwise("train").alias("split")))
    c = rd.parse_lines(v("v_pred").select(line.alias("value")), schemas.CANDIDATES)
    return c.groupBy("split").agg(F.count("*").alias("n"), F.sum("area").alias("area"), F.count_distinct("wid").alias("sheets"))

