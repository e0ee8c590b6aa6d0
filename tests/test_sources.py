"""Files in, tables out, and back: small trees written to a temporary folder."""

import json
import os

import pytest
from pyspark.sql import functions as F

from boxlake.operators import quality as q
from boxlake.sources import readers as rd
from boxlake.sources import writers as wr
from boxlake.streaming import incremental as inc


def put(path, obj):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(obj if isinstance(obj, str) else json.dumps(obj))


def poly(*pts):
    return {"geometry": {"type": "Polygon", "coordinates": [[list(p) for p in pts]]}}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r = str(tmp_path_factory.mktemp("requests"))
    put(f"{r}/r1/worksheets_metadata.json", [
        {"id": "w1", "name": "A", "page_no": 3, "image": {"width": 200, "height": 100, "image_url": "http://x/1"}},
        {"id": "w2", "title": "T", "image": {"width": 0, "height": 0, "image_url": "http://x/2"}},
        {"id": "w3", "page_no": 1, "image": {"width": 10, "height": 10, "image_url": ""}},
        {"id": "w4", "page_no": 1, "image": {"image_url": "http://x/4"}}])
    put(f"{r}/r2/worksheets_metadata.json", [{"id": "w9", "image": {"image_url": "u"}}])
    os.makedirs(f"{r}/r3")
    tags = {"t0": {"tagId": "g0"}, "t1": {"tagId": "nope"}, "t9": {"tagId": "g0"}}
    put(f"{r}/r1/worksheet_geometries/w1_geometries.json", {"outputs": [
        {"feature": {"id": "f", "name": "bbox_ duct", "geometry_type": 3}, "output_geojson": {"features": [
            {**poly((10, -10), (50, -10), (50, -40), (10, -10)), "properties": {"tags_info": tags}},
            poly((0, 0), (1, 0), (1, -50))]}},
        {"feature": {"name": "pt", "geometry_type": 1}, "output_geojson": {"features": [
            {"geometry": {"type": "Point", "coordinates": [5, -5]}}, {"geometry": {"type": "Point", "coordinates": [500, -5]}},
            {"geometry": {"type": "Point", "coordinates": [1, 2, 3]}}]}},
        {"feature": {"name": None, "geometry_type": 2}, "output_geojson": {"features": [
            {"geometry": {"type": "LineString", "coordinates": [[0, 0], [1, -1]]}}]}}]})
    put(f"{r}/r1/tag_library.json", {"tag_types": [
        {"id": "t0", "name": "category", "tags": [{"id": "g0", "name": "WIRING_DEVICES"}]}, {"id": "t1", "name": "source", "tags": []}]})
    return r


def dims(spark, wid="w1"):
    return spark.createDataFrame([("r1", wid, 200, 100, 100, 50)], "rid string, wid string, fe_w long, fe_h long, img_w long, img_h long")


def test_requests_and_worksheets(spark, root):
    assert [r.rid for r in rd.list_requests(spark, root).collect()] == ["r1", "r2"]
    ws = rd.worksheets(spark, root)
    assert ws.groupBy("rid").count().count() == 2
    have = rd.geometries(spark, root).select("rid", "wid")
    got = rd.worksheet_order(rd.compact_worksheets(ws.where("rid = 'r1'"), have)).collect()
    assert [(r.wid, r.name, r.title, r.page_no, r.has_geometry) for r in got] == [
        ("w1", "A", "", 3, True), ("w4", "", "", 1, False), ("w2", "", "T", None, False)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        rd.worksheets(spark, root, "missing")


def test_geometry_flattening(spark, root):
    f = rd.geometries(spark, root)
    assert [(r.out_idx, r.feat_idx, r.layer, r.type) for r in f.orderBy("out_idx", "feat_idx").collect()] == [
        (0, 0, "bbox_ duct", "Polygon"), (0, 1, "bbox_ duct", "Polygon"), (1, 0, "pt", "Point"), (1, 1, "pt", "Point"),
        (1, 2, "pt", "Point"), (2, 0, "", "LineString")]
    p = rd.with_dimensions(f, dims(spark))
    assert [(r.x, r.y, r.layer) for r in rd.reference_points(p).collect()] == [(2, 2, "pt")]  # 2.5 rounds to even
    boxes = [(r.name, tuple(r.box)) for r in rd.layer_boxes(p, 4.0).orderBy("feat_idx").collect()]
    assert boxes == [("duct", (20, 20, 80, 60)), ("duct", (0, 0, 2, 100))]
    polys = rd.reference_polygons(p)
    assert [tuple(r.box) for r in polys.collect()] == [(5, 5, 20, 15)]  # the sliver rounds away
    with pytest.raises(Exception, match="worksheet not found"):
        rd.with_dimensions(f, dims(spark, "other")).collect()


def test_tags(spark, root):
    tags, types = rd.tag_library(spark, root)
    f = rd.geometries(spark, root)
    got = rd.resolve_tags(f, tags, types)
    assert {(r.tag_type, r.tag) for r in got.collect()} == {("category", "WIRING_DEVICES"), ("source", "")}
    p = rd.reference_polygons(rd.with_dimensions(f, dims(spark)), got)
    assert [r.wid for r in rd.sheets_with_patches(p).collect()] == ["w1"]
    empty = rd.tag_library(spark, root, "r2")
    assert [d.count() for d in empty] == [0, 0]


def test_manifest_ids_csv(spark, tmp_path):
    put(f"{tmp_path}/m.jsonl", '{"path":"a/1.png","name":"n","box":{"x":1,"y":2,"w":3,"h":4}}\n\n{"path":"b/2.png","zoom":4.0}\n')
    m = rd.load_manifest(spark, f"{tmp_path}/m.jsonl").orderBy("path").collect()
    assert [(r.path, r.zoom, r.box and r.box.w) for r in m] == [("a/1.png", None, 3), ("b/2.png", 4.0, None)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        rd.load_manifest(spark, f"{tmp_path}/none.jsonl")
    put(f"{tmp_path}/ids.txt", "# list\n a \n\nb\n  # no\n")
    assert [r.rid for r in rd.load_ids(spark, f"{tmp_path}/ids.txt").collect()] == ["a", "b"]
    put(f"{tmp_path}/r.csv", "req,sheet\n1,2\n")
    assert rd.load_request_csv(spark, f"{tmp_path}/r.csv", "req", "sheet").collect() == [("1", "2")]
    put(f"{tmp_path}/c.csv", "layer_name_regex,category_name,category_id\n.*DUCT.*,DUCT,0\n")
    assert rd.load_category_map(spark, f"{tmp_path}/c.csv").collect() == [(".*DUCT.*", "DUCT", 0)]


def test_dryruns(spark, tmp_path):
    layer = {"name": "L2", "output_geojson": {"features": [poly((0, 0), (7, 0), (7, -7), (0, 0)), {"geometry": {"type": "Point", "coordinates": [1, 2]}}]}}
    put(f"{tmp_path}/a_bbox_dryrun.json", {"source_wid": "s", "n_boxes": 3, "raster_wh": [50, 50], "source_fe_wh": [100, 100],
                                           "styles": {"L2": {"layer_order": 2}}, "layers": [layer, {**layer, "name": "L1"}]})
    put(f"{tmp_path}/b_bbox_dryrun.json", "{ broken")
    got = rd.dryrun_catalogue(spark, f"{tmp_path}/*_bbox_dryrun.json").collect()
    assert [tuple(r) for r in got] == [("a_bbox_dryrun.json", "s", 3, 2), ("b_bbox_dryrun.json", None, None, None)]
    from boxlake import schemas

    runs = spark.read.schema(schemas.DRYRUN).option("multiLine", True).json(f"{tmp_path}/a_*.json").withColumn("file", F.lit("a"))
    rows = rd.dryrun_layers(runs).collect()
    assert [(r.name, r.layer_order, [list(p) for p in r.polygon]) for r in rows] == [
        ("L1", 0, [[0.0, 0.0], [3.5, 0.0], [3.5, 3.5]]), ("L2", 2, [[0.0, 0.0], [3.5, 0.0], [3.5, 3.5]])]


def test_hits_store_pushes_down(spark, tmp_path):
    rows = [("k1", i, i / 10) for i in range(10)] + [("k2", i, i / 10) for i in range(10)]
    df = spark.createDataFrame(rows, "scan_key string, hit_id long, score double")
    path = f"{tmp_path}/hits"
    wr.write_hits(df, path)
    wr.write_hits(df.where("scan_key = 'k1' AND hit_id > 4"), path)  # rewriting one key keeps the other
    got = wr.read_hits(spark, path, "k1", 0.7)
    assert sorted(r.hit_id for r in got.collect()) == [7, 8, 9]
    assert wr.read_hits(spark, path, "k2", 0.0).count() == 10
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(score,0.7)" in plan and "scan_key" in plan.split("PartitionFilters")[1][:80]
    assert [r.hit_id for r in wr.draw_order(df.where("scan_key = 'k2'"), 0.75).collect()] == [8, 9]


def test_candidates_and_splits(spark, tmp_path):
    c = spark.createDataFrame([("r", "w", "a.npz", 1, "train"), ("r", "w", "b.npz", 0, "val")], "rid string, wid string, npz string, label int, split string")
    wr.write_candidates(c, f"{tmp_path}/cand")
    back = rd.load_candidates(spark, f"{tmp_path}/cand")
    assert back.where("split = 'val'").select("npz").collect() == [("b.npz",)]
    man = spark.createDataFrame([(f"p{i}", f"n{i % 2}", "ab"[i % 2]) for i in range(40)], "path string, name string, rid string")
    root = f"{tmp_path}/pool"
    strat = wr.load_or_make_split(spark, root, man, None)
    assert strat.where("split = 'val'").count() == 8
    ids = spark.createDataFrame([("a", "train"), ("b", "val")], "rid string, split string")
    hold = wr.load_or_make_split(spark, root, man, ids)
    assert {r.split for r in hold.collect()} == {"train"}  # class n1 is unknown to train
    from boxlake.operators.curation import stratified_split

    full = stratified_split(man)
    wr.write_split(full, full.groupBy("split").count(), root)
    again = wr.load_or_make_split(spark, root, man, ids)
    assert again.count() == 40 and again.where("split = 'val'").count() == 8
    assert spark.read.json(f"{root}/classes").count() == 2


def test_exports(spark, tmp_path):
    ann = spark.createDataFrame([(5, 1, "B", 10, 20, 30, 40, 100, 200), (5, 2, "A", 0, 0, 10, 10, 100, 200), (3, 1, "A", 1, 1, 2, 2, 100, 200)],
                                "sheet_id long, ann_key long, name string, x long, y long, w long, h long, width long, height long")
    wr.write_coco(ann, f"{tmp_path}/coco")
    a = {r.id: r for r in spark.read.json(f"{tmp_path}/coco/annotations").collect()}
    assert (a[2].image_id, a[2].category_id, a[2].bbox, a[2].area) == (2, 1, [10, 20, 30, 40], 1200)
    assert a[2].segmentation == [[10, 20, 40, 20, 40, 60, 10, 60]]
    assert {r.file_name for r in spark.read.json(f"{tmp_path}/coco/images").collect()} == {"image_001.png", "image_002.png"}
    wr.write_yolo(ann, f"{tmp_path}/yolo")
    lines = spark.read.option("header", True).csv(f"{tmp_path}/yolo/labels").where("sheet_id = 5")
    assert {r.value for r in lines.collect()} == {"1 0.250 0.200 0.300 0.200", "0 0.050 0.025 0.100 0.050"}
    assert [r.value for r in spark.read.text(f"{tmp_path}/yolo/classes").collect()] == ["A", "B"]
    wr.write_feature_names(ann, f"{tmp_path}/names")
    assert [r.value for r in spark.read.text(f"{tmp_path}/names").collect()] == ["A", "B"]


def test_embeddings_and_report(spark, tmp_path):
    e = spark.createDataFrame([(1, [0.5, 0.25], 3, "p")], "id bigint, vec array<float>, label int, path string")
    wr.write_embeddings(e, f"{tmp_path}/emb")
    assert rd.load_embeddings(spark, f"{tmp_path}/emb").collect() == e.collect()
    checks = spark.createDataFrame([(2, "b", False, "bad"), (1, "a", True, "fine")], "pos int, name string, ok boolean, detail string")
    wr.write_report(checks, f"{tmp_path}/rep")
    doc = json.loads(spark.read.text(f"{tmp_path}/rep/verify_report_json").first().value)
    assert doc["ok"] is False and [c["name"] for c in doc["checks"]] == ["a", "b"]
    assert [r.value for r in spark.read.text(f"{tmp_path}/rep/verify_report_md").collect()] == ["- **PASS** `a` — fine", "- **FAIL** `b` — bad"]
    assert q.report_status(checks).first().failed == ["b"]


def test_table_records_round_trip(spark):
    cells = spark.createDataFrame([(1, 0, 0, [0, 0, 1, 1], "a"), (1, 0, 1, [1, 0, 2, 1], "b"), (1, 1, 0, [0, 1, 1, 2], None)],
                                  "index int, row int, col int, bbox array<int>, value string")
    rec = wr.table_records(cells)
    assert [[c.value for c in row] for row in rec.first().rows] == [["a", "b"], [None]]
    assert rd.table_cells(rec).select(*cells.columns).orderBy("row", "col").collect() == cells.collect()


def test_incremental_runs_only_what_is_missing(spark, tmp_path):
    store, seen = f"{tmp_path}/store", []

    def detect(todo):
        seen.append(sorted((r.sheet_id, r.scan_key) for r in todo.select("sheet_id", "scan_key").collect()))
        return todo.withColumn("score", F.lit(0.5))

    req = spark.createDataFrame([("s1", "k"), ("s2", "k"), ("s1", "k")], "sheet_id string, scan_key string")
    inc.run_pending(req.limit(1), store, detect)
    inc.run_pending(req, store, detect)
    inc.run_pending(req, store, detect)
    inc.run_pending(req.where("sheet_id = 's2'"), store, detect, force=True)
    assert seen == [[("s1", "k")], [("s2", "k")], [("s2", "k")]]
    assert inc.read_store(spark, store).count() == 2
    put(f"{tmp_path}/in/a.json", '{"sheet_id":"s3","scan_key":"k"}\n{"sheet_id":"s1","scan_key":"k"}\n')
    stream = spark.readStream.schema("sheet_id string, scan_key string").json(f"{tmp_path}/in")
    inc.run_stream(stream, store, f"{tmp_path}/cp", detect).awaitTermination()
    assert seen[-1] == [("s3", "k")] and inc.read_store(spark, store).count() == 3
    assert inc.skip_existing(req.select(F.col("sheet_id").alias("rid")), spark.createDataFrame([("s1",)], "rid string")).collect() == [("s2",)]


def test_units_keep_their_spelling_and_finish_without_hits(spark, tmp_path):
    store, seen = f"{tmp_path}/units", []

    def detect(todo):
        seen.append(sorted(r.sheet_id for r in todo.collect()))
        return todo.where("sheet_id <> 'none'").withColumn("score", F.lit(0.5))

    req = spark.createDataFrame([("7", "1e3"), ("007", "1e3"), ("none", "1e3")], "sheet_id string, scan_key string")
    inc.run_pending(req.limit(1), store, detect)
    inc.run_pending(req, store, detect)
    inc.run_pending(req, store, detect)
    assert seen == [["7"], ["007", "none"]]
    assert sorted((r.sheet_id, r.n_hits) for r in inc.finished(spark, store).collect()) == [("007", 1), ("7", 1), ("none", 0)]
    assert sorted(r.sheet_id for r in inc.read_store(spark, store).collect()) == ["007", "7"]


def test_a_broken_run_leaves_nothing(spark, tmp_path):
    store = f"{tmp_path}/units"
    req = spark.createDataFrame([("a", "k")], "sheet_id string, scan_key string")

    def broken(todo):
        todo.withColumn("_run", F.lit(1).cast("long")).write.parquet(f"{store}/hits/run_1")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        inc.run_pending(req, store, broken)
    inc.run_pending(req, store, lambda t: t)
    assert inc.read_store(spark, store).count() == 1


def test_broken_input_is_an_error(spark, tmp_path):
    put(f"{tmp_path}/m.jsonl", '{"path":"a"}\n{"path": oops\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        rd.load_manifest(spark, f"{tmp_path}/m.jsonl").collect()
    put(f"{tmp_path}/n.jsonl", '{"path":"a"}\n{"name":"x"}\n')
    with pytest.raises(Exception, match="without a path"):
        rd.load_manifest(spark, f"{tmp_path}/n.jsonl").collect()
    put(f"{tmp_path}/c.jsonl", '{"rid":"a"}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        rd.load_candidates(spark, f"{tmp_path}/c.jsonl").collect()
    put(f"{tmp_path}/q/r1/worksheet_geometries/w1_geometries.json", '{"outputs": [')
    put(f"{tmp_path}/q/r1/worksheets_metadata.json", "[{")
    put(f"{tmp_path}/q/r1/tag_library.json", "{")
    for read in (rd.geometries, rd.worksheets, lambda s, p: rd.tag_library(s, p)[1]):
        with pytest.raises(Exception, match="(?i)malformed"):
            read(spark, f"{tmp_path}/q").collect()


def test_scans_without_hits_and_odd_keys(spark, tmp_path):
    path = f"{tmp_path}/hits"
    hits = spark.createDataFrame([("007", 1, 0.5), ("1e3", 2, 0.5)], "scan_key string, hit_id long, score double")
    wr.write_hits(hits, path, spark.createDataFrame([("007",), ("1e3",), ("empty",)], "scan_key string"))
    assert [r.hit_id for r in wr.read_hits(spark, path, "007").collect()] == [1]
    assert wr.read_hits(spark, path, "7").count() == 0 and wr.read_hits(spark, path, "empty").count() == 0
    assert {r.scan_key: r.n_hits for r in wr.finished_scans(spark, path).collect()} == {"007": 1, "1e3": 1, "empty": 0}


def test_later_type_of_a_name_wins(spark):
    f = spark.createDataFrame([("r", "w", 0, 0, {"t0": ("g0",), "t1": ("g1",)})],
                              "rid string, wid string, out_idx int, feat_idx int, tags_info map<string,struct<tagId:string>>")
    tags = spark.createDataFrame([("r", "g0", "A"), ("r", "g1", "B")], "rid string, tag_id string, tag_name string")
    types = spark.createDataFrame([("r", "t0", "category"), ("r", "t1", "category")], "rid string, type_id string, type_name string")
    assert [(r.tag_type, r.tag) for r in rd.resolve_tags(f, tags, types).collect()] == [("category", "B")]
