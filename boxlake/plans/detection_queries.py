"""Boxes, points, tiles, matching and candidate mining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.functions import geometry as geo
from boxlake.functions.geometry import Box
from boxlake.functions.numeric import round_exact, round_exact_sql
from boxlake.functions.text import fingerprint
from boxlake.operators import detection as det
from boxlake.operators import greedy, spatial
from boxlake.plans.registry import Views, query
from boxlake.session import cut

IOU = """CASE WHEN least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) AND least(a.y + a.h, b.y + b.h) > greatest(a.y, b.y)
 THEN CAST((least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS DOUBLE)
 / (a.w * a.h + b.w * b.h - (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)))
 ELSE 0.0::DOUBLE END"""
OVERLAP = """least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) AND least(a.y + a.h, b.y + b.h) > greatest(a.y, b.y)"""
SHEET = ["sheet_id"]
COMBO = ["model", "filt"]


def r4(c: str) -> str:
    return round_exact_sql(c, 4)


def ratio_sql(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / {d} ELSE 0.0::DOUBLE END"


# Pieces of DuckDB text: greedy matching as a walk over ranked pairs, one step per rank and group.
def matches_sql(group: str) -> str:
    g = [c.strip() for c in group.split(",")]
    gp = ", ".join("a." + c for c in g)
    on = " AND ".join(f"g.{c} = e.{c}" for c in g)
    gs = ", ".join("e." + c for c in g)
    return f"""pairs AS (SELECT {gp}, a.pred_id, b.gt_id, {IOU} AS iou FROM v_pred a JOIN v_gt b
   ON a.sheet_id = b.sheet_id AND {OVERLAP}),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY iou DESC, pred_id DESC, gt_id DESC) AS rn
   FROM pairs WHERE iou >= 0.5),
 walk AS (SELECT DISTINCT {group}, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS up, CAST([] AS BIGINT[]) AS ug,
   false AS took, CAST(NULL AS BIGINT) AS pred_id, CAST(NULL AS BIGINT) AS gt_id, CAST(NULL AS DOUBLE) AS iou FROM ranked
  UNION ALL
  SELECT {gs}, e.rn,
   CASE WHEN list_contains(g.up, e.pred_id) OR list_contains(g.ug, e.gt_id) THEN g.up ELSE list_append(g.up, e.pred_id) END,
   CASE WHEN list_contains(g.up, e.pred_id) OR list_contains(g.ug, e.gt_id) THEN g.ug ELSE list_append(g.ug, e.gt_id) END,
   NOT (list_contains(g.up, e.pred_id) OR list_contains(g.ug, e.gt_id)), e.pred_id, e.gt_id, e.iou
  FROM walk g JOIN ranked e ON {on} AND e.rn = g.rn + 1),
 matched AS (SELECT {group}, pred_id, gt_id, iou FROM walk WHERE took)"""


CENTER_SQL = """SELECT a.sheet_id, a.pred_id, b.gt_id FROM v_pred a JOIN v_gt b ON a.sheet_id = b.sheet_id
  AND b.x + b.w / 2.0::DOUBLE BETWEEN a.x AND a.x + a.w AND b.y + b.h / 2.0::DOUBLE BETWEEN a.y AND a.y + a.h"""


# --- flagship: sweep over detectors --------------------------------------------------


MODELS = ["click", "view", "purchase", "error", "signup"]
FILTERS = ["none", "median"]


def combos():
    return F.array(*[F.struct(F.lit(m).alias("model"), F.lit(f).alias("filt")) for m in MODELS for f in FILTERS])


def flagship(v: Views):
    pred, gt, keys = v("v_pred"), v("v_gt"), [*COMBO, "sheet_id"]
    counted = cut(greedy.box_classes(pred, keys))
    boxes = det.evaluate_sheets(pred, gt, keys, 0.5, SHEET, combos(), counted).withColumn("gt_mode", F.lit("bboxes"))
    pts = v("v_point").withColumnsRenamed({"x": "px", "y": "py"})
    points = det.evaluate_sheets_points(pred, pts, keys, SHEET, combos(), counted).withColumn("gt_mode", F.lit("points"))
    return det.sweep(boxes.unionByName(points), ["gt_mode", *COMBO])


_SWEEP = f"""WITH RECURSIVE {matches_sql('model, filt, sheet_id')},
 combos AS (SELECT m.model, f.filt FROM (VALUES ('click'), ('view'), ('purchase'), ('error'), ('signup')) m(model), (VALUES ('none'), ('median')) f(filt)),
 base AS (SELECT c.model, c.filt, s.sheet_id, s.n_gt, coalesce(p.n_pred, 0) AS n_pred FROM combos c CROSS JOIN v_sheet s
   LEFT JOIN (SELECT model, filt, sheet_id, count(*) AS n_pred FROM v_pred GROUP BY ALL) p
   ON p.model = c.model AND p.filt = c.filt AND p.sheet_id = s.sheet_id),
 chits AS (SELECT a.model, a.filt, a.sheet_id, count(DISTINCT a.pred_id) AS pred_hits, count(DISTINCT b.gt_id) AS gt_found
   FROM v_pred a JOIN v_gt b ON a.sheet_id = b.sheet_id AND b.x + b.w / 2.0::DOUBLE BETWEEN a.x AND a.x + a.w
   AND b.y + b.h / 2.0::DOUBLE BETWEEN a.y AND a.y + a.h GROUP BY ALL),
 phits AS (SELECT a.model, a.filt, a.sheet_id, count(DISTINCT a.pred_id) AS pred_hits, count(DISTINCT b.pt_idx) AS gt_found
   FROM v_pred a JOIN v_point b ON a.sheet_id = b.sheet_id AND b.x BETWEEN a.x AND a.x + a.w AND b.y BETWEEN a.y AND a.y + a.h GROUP BY ALL),
 ms AS (SELECT model, filt, sheet_id, count(*) AS matches, sum(iou) / count(*) AS mean FROM matched GROUP BY ALL),
 per AS (SELECT 'bboxes' AS gt_mode, b.*, coalesce(h.pred_hits, 0) AS pred_hits, coalesce(h.gt_found, 0) AS gt_found,
    coalesce(m.matches, 0) AS matches, coalesce({r4('m.mean')} * m.matches, 0.0) AS w
   FROM base b LEFT JOIN chits h USING (model, filt, sheet_id) LEFT JOIN ms m USING (model, filt, sheet_id)
  UNION ALL SELECT 'points', b.*, coalesce(h.pred_hits, 0), coalesce(h.gt_found, 0), 0, 0.0
   FROM base b LEFT JOIN phits h USING (model, filt, sheet_id)),
 tot AS (SELECT gt_mode, model, filt, count(*) AS n_sheets, CAST(sum(n_pred) AS BIGINT) AS n_pred, CAST(sum(n_gt) AS BIGINT) AS n_gt,
   CAST(sum(pred_hits) AS BIGINT) AS pred_hits, CAST(sum(gt_found) AS BIGINT) AS gt_found, CAST(sum(matches) AS BIGINT) AS matches,
   sum(w) AS w FROM per GROUP BY gt_mode, model, filt),
 r AS (SELECT *, {ratio_sql('pred_hits', 'n_pred')} AS cp, {ratio_sql('pred_hits', 'n_gt')} AS chr, {ratio_sql('gt_found', 'n_gt')} AS cr,
   {ratio_sql('matches', 'n_pred')} AS ip, {ratio_sql('matches', 'n_gt')} AS ir, {ratio_sql('w', 'matches')} AS mi FROM tot),
 f AS (SELECT *, CASE WHEN cp + chr > 0 THEN 2 * cp * chr / (cp + chr) ELSE 0.0 END AS cf,
   CASE WHEN ip + ir > 0 THEN 2 * ip * ir / (ip + ir) ELSE 0.0 END AS f FROM r)
 SELECT gt_mode, model, filt, n_sheets, n_pred, n_gt, pred_hits, gt_found, matches, {r4('cp')} AS center_precision,
  {r4('cr')} AS center_recall, {r4('cf')} AS center_f1, {r4('ip')} AS iou_precision, {r4('ir')} AS iou_recall,
  {r4('f')} AS iou_f1, {r4('mi')} AS mean_iou FROM f"""

query("a11_sweep", _SWEEP, "v_pred", "v_gt", "v_point", "v_sheet")(flagship)


@query("a11_sweep_per_sheet", _SWEEP[:_SWEEP.index(" per AS (")] + f""" t AS (SELECT b.*, coalesce(h.pred_hits, 0) AS pred_hits, coalesce(h.gt_found, 0) AS gt_found, coalesce(m.matches, 0) AS matches,
   coalesce(m.mean * m.matches, 0.0) AS s FROM base b LEFT JOIN chits h USING (model, filt, sheet_id) LEFT JOIN ms m USING (model, filt, sheet_id)),
 r AS (SELECT *, {ratio_sql('pred_hits', 'n_pred')} AS cp, {ratio_sql('pred_hits', 'n_gt')} AS cr, {ratio_sql('gt_found', 'n_gt')} AS cg,
  {ratio_sql('matches', 'n_pred')} AS ip, {ratio_sql('matches', 'n_gt')} AS ir, {ratio_sql('s', 'matches')} AS mi FROM t),
 f AS (SELECT *, CASE WHEN cp + cr > 0 THEN 2 * cp * cr / (cp + cr) ELSE 0.0 END AS cf, CASE WHEN ip + ir > 0 THEN 2 * ip * ir / (ip + ir) ELSE 0.0 END AS f FROM r)
 SELECT model, filt, sheet_id, n_pred, n_gt, pred_hits, gt_found, matches, {r4('cp')} AS center_precision, {r4('cr')} AS center_recall, {r4('cf')} AS center_f1,
  {r4('cg')} AS center_recall_gt, {r4('ip')} AS iou_precision, {r4('ir')} AS iou_recall, {r4('f')} AS iou_f1, {r4('mi')} AS mean_iou FROM f""", "v_pred", "v_gt", "v_point", "v_sheet")
def _(v):
    keys = [*COMBO, "sheet_id"]
    return det.sheet_metrics(det.evaluate_sheets(v("v_pred"), v("v_gt"), keys, 0.5, SHEET, combos()), keys)


@query("j19_sweep_grid", """WITH m AS (SELECT sheet_id, unnest(list_distinct(list(model))) AS model FROM v_pred GROUP BY sheet_id),
 f AS (SELECT sheet_id, unnest(CASE WHEN sheet_id % 3 = 0 THEN ['none'] ELSE list_distinct(list(filt)) END) AS filt FROM v_pred GROUP BY sheet_id)
 SELECT sheet_id, unnest(['bboxes', 'points']) AS gt_mode, model, filt FROM m JOIN f USING (sheet_id)""", "v_pred")
def _(v):
    """One sweep per sheet over the detectors and filters that ran on it; every third request names no filter."""
    listed = lambda c: F.concat(F.lit(" ,"), F.array_join(F.collect_set(c), " , "), F.lit(","))
    asked = v("v_pred").groupBy("sheet_id").agg(listed("model").alias("models"), listed("filt").alias("all"))
    return det.sweep_grids(asked.withColumn("filters", F.when(F.col("sheet_id") % 3 != 0, F.col("all")).otherwise(" "))
                           .withColumn("gts", F.lit("bboxes,points")), SHEET)


# --- containment and overlap joins ---------------------------------------------------


@query("j6_center_hits", f"""WITH h AS ({CENTER_SQL})
 SELECT 'pred' AS side, sheet_id, pred_id AS id, pred_id IN (SELECT pred_id FROM h) AS hit FROM v_pred
 UNION ALL SELECT 'gt', sheet_id, gt_id, gt_id IN (SELECT gt_id FROM h) FROM v_gt""", "v_pred", "v_gt")
def _(v):
    p, g = spatial.flag_hits(v("v_pred"), spatial.with_center(v("v_gt")), SHEET)
    return (p.select(F.lit("pred").alias("side"), "sheet_id", F.col("pred_id").alias("id"), "hit")
            .unionByName(g.select(F.lit("gt").alias("side"), "sheet_id", F.col("gt_id").alias("id"), "hit")))


@query("j7_point_hits", """WITH h AS (SELECT a.pred_id, b.pt_idx FROM v_pred a JOIN v_point b ON a.sheet_id = b.sheet_id
  AND b.x BETWEEN a.x AND a.x + a.w AND b.y BETWEEN a.y AND a.y + a.h)
 SELECT 'pred' AS side, pred_id AS id, CASE WHEN pred_id IN (SELECT pred_id FROM h) THEN 'tp' ELSE 'fp' END AS status FROM v_pred
 UNION ALL SELECT 'gt', pt_idx, CASE WHEN pt_idx IN (SELECT pt_idx FROM h) THEN 'matched' ELSE 'missed' END FROM v_point""", "v_pred", "v_point")
def _(v):
    pts = v("v_point").withColumnsRenamed({"x": "px", "y": "py"})
    p, g = spatial.flag_hits(v("v_pred"), pts, SHEET)
    return (p.select(F.lit("pred").alias("side"), F.col("pred_id").alias("id"), F.when(F.col("hit"), "tp").otherwise("fp").alias("status"))
            .unionByName(g.select(F.lit("gt").alias("side"), F.col("pt_idx").alias("id"),
                                  F.when(F.col("hit"), "matched").otherwise("missed").alias("status"))))


@query("j8_iou_pairs", f"""SELECT a.sheet_id, a.pred_id, b.gt_id, {IOU} AS iou FROM v_pred a JOIN v_gt b
 ON a.sheet_id = b.sheet_id AND {OVERLAP} WHERE {IOU} >= 0.5""", "v_pred", "v_gt")
def _(v):
    return spatial.iou_pairs(v("v_pred"), v("v_gt"), SHEET, 0.5).select(
        "sheet_id", F.col("a_pred_id").alias("pred_id"), F.col("b_gt_id").alias("gt_id"), "iou")


@query("p22_iou", f"""SELECT a.pred_id, {IOU} AS iou FROM v_pred a JOIN v_gt b
 ON a.sheet_id = b.sheet_id AND b.gt_id = CAST(floor(a.pred_id / 3) AS BIGINT) + CAST(floor(floor(a.pred_id / 3) / 2) AS BIGINT)""", "v_pred", "v_gt")
def _(v):
    g = spatial.prefixed(v("v_gt"), "b_", SHEET)
    e = F.floor(F.col("pred_id") / 3)
    return (v("v_pred").withColumn("b_gt_id", e + F.floor(e / 2)).join(g, ["sheet_id", "b_gt_id"])
            .select("pred_id", geo.iou(Box.cols(), Box.cols("b_")).alias("iou")))


@query("p23_center_contains", """SELECT gt_id, x + w / 2.0::DOUBLE AS cx, y + h / 2.0::DOUBLE AS cy,
 (700 BETWEEN x AND x + w) AND (495 BETWEEN y AND y + h) AS on_mid FROM v_gt""", "v_gt")
def _(v):
    b = Box.cols()
    cx, cy = geo.center(b)
    return v("v_gt").select("gt_id", cx.alias("cx"), cy.alias("cy"), geo.contains(b, F.lit(700), F.lit(495)).alias("on_mid"))


LABELLED = f"""best AS (SELECT a.sheet_id, a.pred_id, max({IOU}) AS m FROM v_pred a JOIN v_gt b
  ON a.sheet_id = b.sheet_id AND {OVERLAP} GROUP BY ALL),
 labelled AS (SELECT p.sheet_id, p.pred_id, coalesce(m, 0.0) AS iou, CASE WHEN coalesce(m, 0.0) >= 0.5 THEN 1 ELSE 0 END AS label
  FROM v_pred p LEFT JOIN best USING (sheet_id, pred_id) WHERE coalesce(m, 0.0) >= 0.5 OR coalesce(m, 0.0) < 0.1)"""


def labelled(v):
    return det.label_candidates(v("v_pred"), v("v_gt"), SHEET).select("sheet_id", "pred_id", "iou", "label")


query("j9_label_candidates", f"WITH {LABELLED} SELECT * FROM labelled", "v_pred", "v_gt")(labelled)

MINED = f"""{LABELLED}, c AS (SELECT *, sum(label) OVER s AS pos, sum(1 - label) OVER s AS neg FROM labelled WINDOW s AS (PARTITION BY sheet_id)),
 d AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, label ORDER BY iou DESC, pred_id) AS hard FROM c WHERE pos > 0),
 e AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, label, hard > floor(pos * 2) ORDER BY md5(concat('0|', pred_id))) AS draw FROM d),
 mined AS (SELECT sheet_id, pred_id, iou, label FROM e WHERE label = 1 OR neg <= pos * 4 OR hard <= floor(pos * 2) OR draw <= pos * 4 - floor(pos * 2))"""
query("w8_mine_negatives", f"WITH {MINED} SELECT * FROM mined", "v_pred", "v_gt")(
    lambda v: det.mine_negatives(labelled(v), SHEET))
# with a stricter positive rule and one negative each the draw really has to leave rows out
_TIGHT = (MINED.replace(">= 0.5", ">= 0.8").replace("pos * 4", "pos * 1").replace("floor(pos * 2)", "floor(pos * 1 / 2)"))
query("w8_mine_negatives_tight", f"WITH {_TIGHT} SELECT * FROM mined", "v_pred", "v_gt")(
    lambda v: det.mine_negatives(det.label_candidates(v("v_pred"), v("v_gt"), SHEET, pos=0.8).select(
        "sheet_id", "pred_id", "iou", "label"), SHEET, per_pos=1))


@query("a38_mining_tallies", f"""WITH {MINED}, t AS (SELECT *, CASE WHEN sheet_id % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM mined)
 SELECT split, sheet_id, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM t GROUP BY ROLLUP (split, sheet_id)""", "v_pred", "v_gt")
def _(v):
    split = F.when(F.col("sheet_id") % 5 == 0, "val").otherwise("train")
    return det.mining_tallies(det.mine_negatives(labelled(v), SHEET).withColumn("split", split), SHEET)


@query("a10_sheet_prf", f"""WITH RECURSIVE {matches_sql('sheet_id')}, h AS ({CENTER_SQL}),
 c AS (SELECT sheet_id, count(DISTINCT pred_id) AS pred_hits, count(DISTINCT gt_id) AS gt_found FROM h GROUP BY ALL),
 p AS (SELECT sheet_id, count(*) AS n_pred FROM v_pred GROUP BY ALL), m AS (SELECT sheet_id, count(*) AS matches, sum(iou) AS s FROM matched GROUP BY ALL),
 t AS (SELECT sheet_id, coalesce(n_pred, 0) AS n_pred, n_gt, coalesce(pred_hits, 0) AS pred_hits, coalesce(gt_found, 0) AS gt_found,
  coalesce(matches, 0) AS matches, coalesce(s, 0.0) AS s FROM v_sheet LEFT JOIN p USING (sheet_id) LEFT JOIN c USING (sheet_id) LEFT JOIN m USING (sheet_id)),
 r AS (SELECT *, {ratio_sql('pred_hits', 'n_pred')} AS cp, {ratio_sql('pred_hits', 'n_gt')} AS cr, {ratio_sql('gt_found', 'n_gt')} AS cg,
  {ratio_sql('matches', 'n_pred')} AS ip, {ratio_sql('matches', 'n_gt')} AS ir, {ratio_sql('s', 'matches')} AS mi FROM t),
 f AS (SELECT *, CASE WHEN cp + cr > 0 THEN 2 * cp * cr / (cp + cr) ELSE 0.0 END AS cf, CASE WHEN ip + ir > 0 THEN 2 * ip * ir / (ip + ir) ELSE 0.0 END AS f FROM r)
 SELECT sheet_id, n_pred, n_gt, pred_hits, gt_found, matches, {r4('cp')} AS center_precision, {r4('cr')} AS center_recall, {r4('cf')} AS center_f1,
  {r4('cg')} AS center_recall_gt, {r4('ip')} AS iou_precision, {r4('ir')} AS iou_recall, {r4('f')} AS iou_f1, {r4('mi')} AS mean_iou FROM f""", "v_pred", "v_gt", "v_sheet")
def _(v):
    return det.sheet_metrics(det.evaluate_sheets(v("v_pred"), v("v_gt"), SHEET), SHEET)


@query("i2_match_status", f"""WITH RECURSIVE {matches_sql('sheet_id')}
 SELECT 'pred' AS side, sheet_id, pred_id AS id, CASE WHEN pred_id IN (SELECT pred_id FROM matched) THEN 'tp' ELSE 'fp' END AS status FROM v_pred
 UNION ALL SELECT 'gt', sheet_id, gt_id, CASE WHEN gt_id IN (SELECT gt_id FROM matched) THEN 'matched' ELSE 'missed' END FROM v_gt""", "v_pred", "v_gt")
def _(v):
    p, g = det.match_status(v("v_pred"), v("v_gt"), SHEET)
    return (p.select(F.lit("pred").alias("side"), "sheet_id", F.col("pred_id").alias("id"), "status")
            .unionByName(g.select(F.lit("gt").alias("side"), "sheet_id", F.col("gt_id").alias("id"), "status")))


@query("i2_match_pairs", f"WITH RECURSIVE {matches_sql('sheet_id')} SELECT * FROM matched", "v_pred", "v_gt")
def _(v):
    return greedy.match_one_to_one(v("v_pred"), v("v_gt"), SHEET)


def nms_sql(thr: float, src: str = "v_pred") -> str:
    return f"""boxes AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY score DESC, pred_id) AS rn FROM {src}),
 beat AS (SELECT b.sheet_id, b.pred_id, list(a.pred_id) AS better FROM boxes a JOIN boxes b ON a.sheet_id = b.sheet_id AND a.rn < b.rn
   AND {OVERLAP} WHERE {IOU} > {thr} GROUP BY ALL),
 seq AS (SELECT x.sheet_id, x.pred_id, x.rn, coalesce(better, CAST([] AS BIGINT[])) AS better FROM boxes x LEFT JOIN beat USING (sheet_id, pred_id)),
 walk AS (SELECT DISTINCT sheet_id, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS alive, CAST(NULL AS BIGINT) AS pred_id, false AS kept FROM boxes
  UNION ALL SELECT s.sheet_id, s.rn, CASE WHEN list_has_any(s.better, w.alive) THEN w.alive ELSE list_append(w.alive, s.pred_id) END,
   s.pred_id, NOT list_has_any(s.better, w.alive) FROM walk w JOIN seq s ON s.sheet_id = w.sheet_id AND s.rn = w.rn + 1)"""


@query("i1_suppress", f"WITH RECURSIVE {nms_sql(0.3)} SELECT sheet_id, pred_id, kept FROM walk WHERE rn > 0", "v_pred")
def _(v):
    return greedy.suppress(v("v_pred"), SHEET, 0.3).select("sheet_id", "pred_id", "kept")


@query("i1_suppress_loose", f"WITH RECURSIVE {nms_sql(0.5)} SELECT sheet_id, pred_id, kept FROM walk WHERE rn > 0", "v_pred")
def _(v):
    return greedy.suppress(v("v_pred"), SHEET, 0.5).select("sheet_id", "pred_id", "kept")


@query("w10_cap_detections", """SELECT sheet_id, pred_id, score FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id
 ORDER BY score DESC, pred_id) AS r FROM v_pred) WHERE r <= 40""", "v_pred")
def _(v):
    return det.cap_detections(v("v_pred"), SHEET, 40).select("sheet_id", "pred_id", "score")


@query("w10_cap_detections_4000", """SELECT name, pred_id, score FROM (SELECT *, row_number() OVER (PARTITION BY name
 ORDER BY score DESC, pred_id) AS r FROM v_pred) WHERE r <= 4000""", "v_pred")
def _(v):
    return det.cap_detections(v("v_pred"), ["name"], 4000).select("name", "pred_id", "score")


@query("p12_first_boxes", """SELECT sheet_id, pt_idx FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY pt_idx) AS r
 FROM v_point) WHERE r <= 10""", "v_point")
def _(v):
    return det.first_rows(v("v_point"), SHEET, "pt_idx", 10).select("sheet_id", "pt_idx")


# --- tiles ---------------------------------------------------------------------------

TILE_SQL = """xs AS (SELECT sheet_id, unnest(list_distinct(list_concat(range(0, 1740 - 640 + 1, 544), [1740 - 640]))) AS x0 FROM v_sheet),
 ys AS (SELECT sheet_id, unnest(list_distinct(list_concat(range(0, 1040 - 640 + 1, 544), [1040 - 640]))) AS y0 FROM v_sheet),
 tiles AS (SELECT sheet_id, row_number() OVER (PARTITION BY sheet_id ORDER BY y0, x0) - 1 AS tile, x0, y0, least(x0 + 640, 1740) AS x1, least(y0 + 640, 1040) AS y1
  FROM xs JOIN ys USING (sheet_id))"""


@query("w15_tile_grid", f"WITH {TILE_SQL} SELECT sheet_id, tile, x0, y0, x1, y1 FROM tiles", "v_sheet")
def _(v):
    return spatial.tile_grid(v("v_sheet")).select("sheet_id", "tile", "x0", "y0", "x1", "y1")


@query("w15_match_tile_grid", """SELECT sheet_id, x0, y0, least(x0 + 1024, 1740) AS x1, least(y0 + 1024, 1040) AS y1
 FROM v_sheet, (SELECT unnest([0, 716]::BIGINT[]) AS x0), (SELECT unnest([0, 16]::BIGINT[]) AS y0)""", "v_sheet")
def _(v):
    return spatial.match_tile_grid(v("v_sheet"), 40, 40).select("sheet_id", "x0", "y0", "x1", "y1")


@query("w16_tile_grid_clipped", """SELECT sheet_id, x0, y0, least(x0 + 1024, 1740) AS x1, least(y0 + 1024, 1040) AS y1
 FROM v_sheet, (SELECT unnest(range(0, 1740 - 128, 896)) AS x0), (SELECT unnest(range(0, 1040 - 128, 896)) AS y0)""", "v_sheet")
def _(v):
    return spatial.tile_grid_clipped(v("v_sheet")).select("sheet_id", "x0", "y0", "x1", "y1")


@query("j10_assign_tiles", f"""WITH {TILE_SQL}, m AS (SELECT p.sheet_id, p.pt_idx, t.tile,
  row_number() OVER (PARTITION BY p.sheet_id, p.pt_idx ORDER BY least(p.x - x0, x1 - p.x, p.y - y0, y1 - p.y) DESC, tile) AS r
  FROM v_point p JOIN tiles t ON p.sheet_id = t.sheet_id AND p.x >= x0 AND p.x < x1 AND p.y >= y0 AND p.y < y1)
 SELECT p.sheet_id, p.pt_idx, coalesce(m.tile, 0) AS tile FROM v_point p LEFT JOIN m ON m.sheet_id = p.sheet_id AND m.pt_idx = p.pt_idx AND m.r = 1""", "v_sheet", "v_point")
def _(v):
    tiles = spatial.tile_grid(v("v_sheet"))
    return spatial.assign_tiles(v("v_point"), tiles, SHEET, 640).select("sheet_id", "pt_idx", "tile")


@query("j14_boxes_on_tiles", f"""WITH {TILE_SQL} SELECT g.sheet_id, g.gt_id, t.tile, g.x - x0 AS x, g.y - y0 AS y, g.w, g.h FROM v_gt g JOIN tiles t
 ON g.sheet_id = t.sheet_id AND g.x + g.w > x0 AND g.x < x1 AND g.y + g.h > y0 AND g.y < y1""", "v_sheet", "v_gt")
def _(v):
    return spatial.boxes_on_tiles(v("v_gt"), spatial.tile_grid(v("v_sheet")), SHEET, 320).select(
        "sheet_id", "gt_id", "tile", "x", "y", "w", "h")


PATCH_SQL = """px AS (SELECT sheet_id, unnest(range(0, 1740 - 128, 512)) AS x0 FROM v_sheet), py AS (SELECT sheet_id, unnest(range(0, 1040 - 128, 512)) AS y0 FROM v_sheet),
 patches AS (SELECT sheet_id, row_number() OVER (PARTITION BY sheet_id ORDER BY y0, x0) - 1 AS tile, x0, y0, least(x0 + 640, 1740) AS x1, least(y0 + 640, 1040) AS y1 FROM px JOIN py USING (sheet_id)),
 cov AS (SELECT g.sheet_id, g.gt_id, t.tile, CAST((least(g.x + g.w, x1) - greatest(g.x, x0)) * (least(g.y + g.h, y1) - greatest(g.y, y0)) AS DOUBLE) / (g.w * g.h) AS coverage
  FROM v_gt g JOIN patches t ON g.sheet_id = t.sheet_id AND g.x + g.w > x0 AND g.x < x1 AND g.y + g.h > y0 AND g.y < y1)"""


def patches(v):
    from pyspark.sql import Window

    t = spatial.tile_grid_clipped(v("v_sheet"), 640, 128)
    return t.withColumn("tile", (F.row_number().over(Window.partitionBy("sheet_id").orderBy("y0", "x0")) - 1).cast("bigint"))


@query("j22_covered_patches", f"WITH {PATCH_SQL} SELECT * FROM cov WHERE coverage >= 0.5", "v_sheet", "v_gt")
def _(v):
    return spatial.covered_patches(v("v_gt"), patches(v), SHEET, 320).select("sheet_id", "gt_id", "tile", "coverage")


@query("j22_empty_patches", f"""WITH {PATCH_SQL} SELECT sheet_id, tile FROM patches ANTI JOIN (SELECT * FROM cov WHERE coverage >= 0.5) USING (sheet_id, tile)""", "v_sheet", "v_gt")
def _(v):
    p = patches(v)
    used = spatial.covered_patches(v("v_gt"), p, SHEET, 320)
    return p.join(used, ["sheet_id", "tile"], "left_anti").select("sheet_id", "tile")


@query("j24_clip_to_roi", """WITH roi AS (SELECT sheet_id, gt_id AS roi, x - 100 AS rx, y - 80 AS ry, w + 200 AS rw, h + 160 AS rh FROM v_gt WHERE regexp_matches(name, '^1-.*'))
 SELECT g.sheet_id, g.gt_id, roi, greatest(x, rx) - rx AS x, greatest(y, ry) - ry AS y, least(x + w, rx + rw) - greatest(x, rx) AS w,
  least(y + h, ry + rh) - greatest(y, ry) AS h FROM v_gt g JOIN roi ON roi.sheet_id = g.sheet_id AND least(x + w, rx + rw) > greatest(x, rx) AND least(y + h, ry + rh) > greatest(y, ry)""", "v_gt")
def _(v):
    g = v("v_gt")
    roi = g.where(F.col("name").rlike("^1-.*")).selectExpr("sheet_id", "gt_id AS roi", "x - 100 AS x", "y - 80 AS y", "w + 200 AS w", "h + 160 AS h")
    return spatial.clip_to_roi(g, roi, SHEET, 128).select("sheet_id", "gt_id", "roi", "x", "y", "w", "h")


# --- neighbours ----------------------------------------------------------------------


@query("j11_nearest_distance", """WITH d AS (SELECT a.sheet_id, a.pt_idx, sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))::DOUBLE) AS nn
  FROM v_point a JOIN v_point b ON a.sheet_id = b.sheet_id AND a.pt_idx <> b.pt_idx GROUP BY ALL)
 SELECT p.sheet_id, p.pt_idx, nn, CAST(CASE WHEN nn IS NULL THEN 50 ELSE round_even(least(50.0, greatest(8.0, nn * 0.75)), 0) END AS BIGINT) AS half
 FROM v_point p LEFT JOIN d USING (sheet_id, pt_idx)""", "v_point")
def _(v):
    d = spatial.nearest_distance(v("v_point"), SHEET)
    return d.select("sheet_id", "pt_idx", "nn", spatial.adaptive_window(F.col("nn"), 50, 8, 8).alias("half"))


@query("j12_window_neighbours", """SELECT sheet_id, pt_idx, neighbour, d2, rank FROM (SELECT a.sheet_id, a.pt_idx, b.pt_idx AS neighbour,
  (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, CAST(row_number() OVER (PARTITION BY a.sheet_id, a.pt_idx
  ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.pt_idx) AS INTEGER) AS rank FROM v_point a JOIN v_point b
  ON a.sheet_id = b.sheet_id AND a.pt_idx <> b.pt_idx AND abs(a.x - b.x) < 150 AND abs(a.y - b.y) < 150) WHERE rank <= 16""", "v_point")
def _(v):
    return spatial.window_neighbours(v("v_point"), SHEET, 150)


@query("j13_densest_point", """SELECT sheet_id, pt_idx, neighbours FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY neighbours DESC, pt_idx) AS r FROM (
  SELECT a.sheet_id, a.pt_idx, count(*) AS neighbours FROM v_point a JOIN v_point b ON a.sheet_id = b.sheet_id
  AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 62500 GROUP BY ALL)) WHERE r = 1""", "v_point")
def _(v):
    return spatial.densest_point(v("v_point"), SHEET)


# --- masks and merged detectors ------------------------------------------------------


def masks(v):
    return v("v_pred").withColumnRenamed("pred_id", "mask_id")


HITS_SQL = """hit AS (SELECT p.sheet_id, p.pt_idx, m.pred_id, m.x, m.y, m.x + m.w AS x1, m.y + m.h AS y1, m.w, m.h, m.score, m.w * m.h AS area FROM v_point p
  JOIN v_pred m ON p.sheet_id = m.sheet_id AND p.x BETWEEN m.x AND m.x + m.w AND p.y BETWEEN m.y AND m.y + m.h)"""


@query("a28_covering_choice", f"""WITH {HITS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, pt_idx ORDER BY area, pred_id) - 1 AS i,
  count(*) OVER (PARTITION BY sheet_id, pt_idx) AS n FROM hit WHERE area <= 0.5 * 2500),
 med AS (SELECT sheet_id, pt_idx, area AS m FROM o WHERE i = n // 2),
 u AS (SELECT sheet_id, pt_idx, min(x) AS ux0, min(y) AS uy0, max(x1) AS ux1, max(y1) AS uy1, max(score) AS us FROM o JOIN med USING (sheet_id, pt_idx) WHERE area <= 1.2 * m GROUP BY ALL)
 SELECT u.sheet_id, u.pt_idx, CASE WHEN ux1 - ux0 > 34 OR uy1 - uy0 > 34 THEN o.x ELSE ux0 END AS x0, CASE WHEN ux1 - ux0 > 34 OR uy1 - uy0 > 34 THEN o.y ELSE uy0 END AS y0,
  CASE WHEN ux1 - ux0 > 34 OR uy1 - uy0 > 34 THEN o.x1 ELSE ux1 END AS x1, CASE WHEN ux1 - ux0 > 34 OR uy1 - uy0 > 34 THEN o.y1 ELSE uy1 END AS y1,
  CASE WHEN ux1 - ux0 > 34 OR uy1 - uy0 > 34 THEN o.score ELSE us END AS score FROM u JOIN o ON o.sheet_id = u.sheet_id AND o.pt_idx = u.pt_idx AND o.i = 0""", "v_point", "v_pred")
def _(v):
    return det.covering_choice(masks(v), v("v_point"), SHEET, 2500.0, 0.5, 1.2, 34)


@query("a29_best_mask", """SELECT sheet_id, name, pred_id AS mask_id, x, y, w, h, score FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, name
 ORDER BY w <= 24 AND h <= 24 DESC, score DESC, w * h, pred_id) AS r FROM v_pred) WHERE r = 1""", "v_pred")
def _(v):
    within = (F.col("w") <= 24) & (F.col("h") <= 24)
    return det.best_mask(masks(v), ["sheet_id", "name"], within)


@query("a29_best_mask_by_score", """SELECT sheet_id, name, pred_id AS mask_id, x, y, w, h, score FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, name
 ORDER BY score DESC, w * h, pred_id) AS r FROM v_pred) WHERE r = 1""", "v_pred")
def _(v):
    return det.best_mask(masks(v), ["sheet_id", "name"])


MIX_SQL = """c AS (SELECT m.sheet_id, m.pred_id, p.pt_idx, (p.x - (m.x + m.w / 2.0::DOUBLE)) ** 2 + (p.y - (m.y + m.h / 2.0::DOUBLE)) ** 2 AS d,
   p.x BETWEEN m.x AND m.x + m.w AND p.y BETWEEN m.y AND m.y + m.h AS inside FROM v_pred m JOIN v_point p ON p.sheet_id = m.sheet_id),
 own AS (SELECT sheet_id, pred_id, pt_idx FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id, pred_id ORDER BY inside DESC, d, pt_idx) AS r FROM c) WHERE r = 1),
 last AS (SELECT * FROM (SELECT o.pt_idx, v.*, row_number() OVER (PARTITION BY v.sheet_id, o.pt_idx, v.filt ORDER BY v.pred_id DESC) AS r
   FROM own o JOIN v_pred v ON v.sheet_id = o.sheet_id AND v.pred_id = o.pred_id) WHERE r = 1)"""


@query("j21_tighter_of_two", f"""WITH {MIX_SQL}, a AS (SELECT * FROM last WHERE filt = 'none'), b AS (SELECT * FROM last WHERE filt = 'median')
 SELECT coalesce(a.sheet_id, b.sheet_id) AS sheet_id, coalesce(a.pt_idx, b.pt_idx) AS pt_idx,
  CASE WHEN a.pt_idx IS NULL OR b.w * b.h < a.w * a.h THEN b.x ELSE a.x END AS x, CASE WHEN a.pt_idx IS NULL OR b.w * b.h < a.w * a.h THEN b.y ELSE a.y END AS y,
  CASE WHEN a.pt_idx IS NULL OR b.w * b.h < a.w * a.h THEN b.w ELSE a.w END AS w, CASE WHEN a.pt_idx IS NULL OR b.w * b.h < a.w * a.h THEN b.h ELSE a.h END AS h,
  CASE WHEN a.pt_idx IS NULL OR b.w * b.h < a.w * a.h THEN b.score ELSE a.score END AS score,
  CASE WHEN a.pt_idx IS NULL OR b.w * b.h < a.w * a.h THEN 'median' ELSE 'none' END AS source
 FROM a FULL JOIN b ON a.sheet_id = b.sheet_id AND a.pt_idx = b.pt_idx""", "v_pred", "v_point")
def _(v):
    pred = v("v_pred").select("sheet_id", "pred_id", "x", "y", "w", "h", "score", F.col("filt").alias("source"))
    own = det.boxes_to_points(pred, v("v_point"), SHEET, "pred_id")
    return det.tighter_per_point(own, ["sheet_id", "pt_idx"], "source", "none", "median")


@query("r4_fallback_box", """WITH m AS (SELECT sheet_id, pt_idx, x, y, w, h, score FROM (SELECT p.pt_idx, q.*, row_number() OVER (PARTITION BY p.sheet_id, p.pt_idx ORDER BY q.score DESC, q.pred_id) AS r
   FROM v_point p JOIN v_pred q ON p.sheet_id = q.sheet_id AND p.x BETWEEN q.x AND q.x + q.w AND p.y BETWEEN q.y AND q.y + q.h) WHERE r = 1),
 c AS (SELECT sheet_id, gt_id AS pt_idx, x, y, w, h FROM v_gt WHERE w <= 0.9 * 30 OR h <= 0.9 * 30)
 SELECT p.sheet_id, p.pt_idx, coalesce(m.x, c.x) AS x, coalesce(m.y, c.y) AS y, coalesce(m.w, c.w) AS w, coalesce(m.h, c.h) AS h,
  CASE WHEN m.pt_idx IS NOT NULL THEN m.score ELSE 0.0 END AS score, CASE WHEN m.pt_idx IS NOT NULL THEN 'model' ELSE 'cc' END AS source
 FROM v_point p LEFT JOIN m ON p.sheet_id = m.sheet_id AND p.pt_idx = m.pt_idx LEFT JOIN c ON p.sheet_id = c.sheet_id AND p.pt_idx = c.pt_idx
 WHERE m.pt_idx IS NOT NULL OR c.pt_idx IS NOT NULL""", "v_pred", "v_point", "v_gt")
def _(v):
    hit = spatial.boxes_over_points(v("v_pred"), spatial.prefixed(v("v_point"), "p_", SHEET), SHEET)
    model = hit.groupBy("sheet_id", F.col("p_pt_idx").alias("pt_idx")).agg(
        F.max_by(F.struct("x", "y", "w", "h", "score"), F.struct("score", -F.col("pred_id"))).alias("b")).select(
        "sheet_id", "pt_idx", "b.*", F.lit("model").alias("source"))
    comp = v("v_gt").select("sheet_id", F.col("gt_id").alias("pt_idx"), "x", "y", "w", "h",
                            F.lit(30).alias("win_w"), F.lit(30).alias("win_h"))
    return det.with_fallback(v("v_point"), model, comp, ["sheet_id", "pt_idx"], 0.9)


# --- size gates, windows, scaling ----------------------------------------------------


@query("p13_scaled_gates", """SELECT gt_id, CAST(greatest(1, round_even(w * CASE WHEN z > 1 THEN z ELSE 1.0 END, 0)) AS BIGINT) AS gate FROM
 (SELECT gt_id, w, CAST(gt_id % 9 AS DOUBLE) / 2 AS z FROM v_gt)""", "v_gt")
def _(v):
    zoom = (F.col("gt_id") % 9).cast("double") / 2
    return v("v_gt").select("gt_id", geo.scaled_gate(F.col("w"), zoom).cast("bigint").alias("gate"))


@query("p14_to_base", """SELECT pred_id, CAST(round_even(x * (1.0::DOUBLE / z), 0) AS BIGINT) AS x, CAST(round_even(y * (1.0::DOUBLE / z), 0) AS BIGINT) AS y, CAST(round_even(w * (1.0::DOUBLE / z), 0) AS BIGINT) AS w,
 CAST(round_even(h * (1.0::DOUBLE / z), 0) AS BIGINT) AS h, CAST(round_even((x + w) * (1.0::DOUBLE / z), 0) AS BIGINT) AS hull_x2 FROM (SELECT *, CAST(2 + pred_id % 3 AS DOUBLE) AS z FROM v_pred)""", "v_pred")
def _(v):
    z = (2 + F.col("pred_id") % 3).cast("double")
    b = Box.cols()
    hull = geo.hull_to_base(F.array(F.array(b.x, b.y), F.array(b.x1, b.y), F.array(b.x1, b.y1), F.array(b.x, b.y1)), z)
    return v("v_pred").select("pred_id", *[geo.to_base(c, z).alias(n) for n, c in zip("xywh", b)], hull[1][0].alias("hull_x2"))


@query("p15_finalize_box", """WITH a AS (SELECT pred_id, x - 3.0::DOUBLE AS x0, y - 3.0::DOUBLE AS y0, x + w + 3.0::DOUBLE AS x1, y + h + 3.0::DOUBLE AS y1 FROM v_pred),
 b AS (SELECT pred_id, CASE WHEN x1 - x0 < 29 THEN (x0 + x1) / 2 - 14.5::DOUBLE ELSE x0 END AS x0, CASE WHEN x1 - x0 < 29 THEN (x0 + x1) / 2 + 14.5::DOUBLE ELSE x1 END AS x1,
  CASE WHEN y1 - y0 < 29 THEN (y0 + y1) / 2 - 14.5::DOUBLE ELSE y0 END AS y0, CASE WHEN y1 - y0 < 29 THEN (y0 + y1) / 2 + 14.5::DOUBLE ELSE y1 END AS y1 FROM a),
 c AS (SELECT pred_id, CAST(greatest(0, round_even(x0, 0)) AS BIGINT) AS x, CAST(greatest(0, round_even(y0, 0)) AS BIGINT) AS y,
  CAST(least(1400, round_even(x1, 0)) AS BIGINT) AS x1, CAST(least(990, round_even(y1, 0)) AS BIGINT) AS y1 FROM b)
 SELECT pred_id, x, y, x1 - x AS w, y1 - y AS h FROM c""", "v_pred")
def _(v):
    b = Box.cols()
    f = geo.finalize_box(b.x, b.y, b.x1, b.y1, 3, 29, F.lit(1400).cast("bigint"), F.lit(990).cast("bigint"))
    return v("v_pred").select("pred_id", *f.named())


@query("p16_clip_window", """SELECT * FROM (SELECT pred_id, greatest(0, x - 4) AS x, greatest(0, y - 4) AS y, least(1400, x + w + 4) - greatest(0, x - 4) AS w,
 least(990, y + h + 4) - greatest(0, y - 4) AS h FROM v_pred) WHERE w > 0 AND h > 0""", "v_pred")
def _(v):
    b = geo.clip_window(Box.cols(), F.lit(1400), F.lit(990), 4)
    return v("v_pred").select("pred_id", *b.named()).where("w > 0 AND h > 0")


@query("p16_centroid_window", """SELECT * FROM (SELECT pred_id, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h FROM (SELECT pred_id, CAST(greatest(0, round_even(x + w / 2.0::DOUBLE - 25, 0)) AS BIGINT) AS x0,
 CAST(greatest(0, round_even(y + h / 2.0::DOUBLE - 25, 0)) AS BIGINT) AS y0, CAST(least(1024, round_even(x + w / 2.0::DOUBLE + 25, 0)) AS BIGINT) AS x1,
 CAST(least(1024, round_even(y + h / 2.0::DOUBLE + 25, 0)) AS BIGINT) AS y1 FROM v_pred)) WHERE w >= 2 AND h >= 2""", "v_pred")
def _(v):
    cx, cy = geo.center(Box.cols())
    b = geo.centroid_window(cx, cy, F.lit(25), F.lit(1024).cast("bigint"), F.lit(1024).cast("bigint"))
    return v("v_pred").select("pred_id", *b.named()).where("w >= 2 AND h >= 2")


@query("p17_hull_order", """SELECT pred_id, x, y, x + w AS x2, y + h AS y2, CAST(w AS DOUBLE) AS side_w, CAST(h AS DOUBLE) AS side_h,
 w >= 2 AND h >= 2 AS use_hull FROM v_pred""", "v_pred")
def _(v):
    b = Box.cols()
    # corners arrive in an arbitrary order
    c = [F.array(b.x1, b.y1), F.array(b.x, b.y), F.array(b.x, b.y1), F.array(b.x1, b.y)]
    o = geo.order_hull(F.array(*c))
    df = v("v_pred").select("pred_id", o.alias("o"))
    w, h = geo.hull_sides(F.col("o"))
    o = F.col("o")
    return df.select("pred_id", o[0][0].alias("x"), o[0][1].alias("y"), o[2][0].alias("x2"), o[2][1].alias("y2"),
                     w.alias("side_w"), h.alias("side_h"), ((w >= 2) & (h >= 2)).alias("use_hull"))


@query("p18_candidate_gate", "SELECT pred_id FROM v_pred WHERE least(w, h) >= 20 AND w * h <= 0.1 * 8000", "v_pred")
def _(v):
    return v("v_pred").where(geo.candidate_gate(F.col("w"), F.col("h"), F.lit(8000), 20)).select("pred_id")


@query("p19_feature_cells", """SELECT pred_id, r0, least(65, greatest(r0 + 1, CAST(ceil((y + h) * 1.1::DOUBLE / 16) AS BIGINT))) AS r1, c0, least(80, greatest(c0 + 1, CAST(ceil((x + w) * 0.9::DOUBLE / 16) AS BIGINT))) AS c1,
 (c0 * 16 + 8.0::DOUBLE) / 0.9::DOUBLE AS px, (r0 * 16 + 8.0::DOUBLE) / 1.1::DOUBLE AS py FROM (SELECT *, greatest(0, CAST(floor(y * 1.1::DOUBLE / 16) AS BIGINT)) AS r0, greatest(0, CAST(floor(x * 0.9::DOUBLE / 16) AS BIGINT)) AS c0 FROM v_pred)""", "v_pred")
def _(v):
    sx, sy = F.lit(0.9), F.lit(1.1)
    r0, r1, c0, c1 = geo.box_to_cells(Box.cols(), sx, sy, F.lit(65).cast("bigint"), F.lit(80).cast("bigint"))
    px, py = geo.cell_to_pixel(F.col("r0"), F.col("c0"), sx, sy)
    return v("v_pred").select("pred_id", r0.alias("r0"), r1.alias("r1"), c0.alias("c0"), c1.alias("c1")).select("*", px.alias("px"), py.alias("py"))


@query("p20_box_formats", """SELECT gt_id, x + w / 2.0::DOUBLE AS cx, y + h / 2.0::DOUBLE AS cy, CAST(x + w AS DOUBLE) AS x2, CAST(y + h AS DOUBLE) AS y2,
 (x + w / 2.0::DOUBLE) / 1740 AS nx, (y + h / 2.0::DOUBLE) / 1040 AS ny, w::DOUBLE / 1740 AS nw, h::DOUBLE / 1040 AS nh FROM v_gt""", "v_gt")
def _(v):
    b = Box.cols()
    xywh, corners = geo.convert_box(b, "xywh"), geo.convert_box(b, "x1y1x2y2w")
    n = geo.normalized_box(b, F.lit(1740), F.lit(1040))
    return v("v_gt").select("gt_id", xywh[0].alias("cx"), xywh[1].alias("cy"), corners[2].alias("x2"), corners[3].alias("y2"),
                            *[c.alias(k) for c, k in zip(n, ("nx", "ny", "nw", "nh"))])


@query("p21_line_boxes", """SELECT * FROM (SELECT gt_id, w::DOUBLE + h::DOUBLE AS length, x - w * 0.1::DOUBLE AS bx, y - h * 0.1::DOUBLE AS by_, w + 2 * (w * 0.1::DOUBLE) AS bw, h + 2 * (h * 0.1::DOUBLE) AS bh FROM v_gt) WHERE length >= 40""", "v_gt")
def _(v):
    b = Box.cols()
    line = F.array(F.array(b.x, b.y), F.array(b.x1, b.y), F.array(b.x1, b.y1))
    lb = geo.line_box(line, 0.1)
    return (v("v_gt").select("gt_id", geo.line_length(line).alias("length"), lb["x"].alias("bx"), lb["y"].alias("by_"),
                             lb["w"].alias("bw"), lb["h"].alias("bh")).where("length >= 40"))


@query("p21_line_boxes_tilted", """SELECT gt_id, round(area, 6) AS area FROM (SELECT gt_id, (w * w + h * h) * 1.2::DOUBLE * (w * h / (w * w + h * h)::DOUBLE) * 1.2::DOUBLE AS area FROM v_gt)""", "v_gt")
def _(v):
    b = Box.cols()
    line = F.array(F.array(b.x, b.y), F.array(b.x1, b.y), F.array(b.x1, b.y1))
    c = v("v_gt").select("gt_id", geo.line_box_tilted(line, 0.1).alias("c"))
    side = geo.point_distance(F.col("c")[0], F.col("c")[1]) * geo.point_distance(F.col("c")[1], F.col("c")[2])
    return c.select("gt_id", F.round(side, 6).alias("area"))


@query("p24_draw_order", """SELECT pred_id, score, pred_id AS colour FROM v_pred WHERE score >= 0.6""", "v_pred")
def _(v):
    from boxlake.sources.writers import draw_order

    return draw_order(v("v_pred").withColumnRenamed("pred_id", "hit_id"), 0.6).select(F.col("hit_id").alias("pred_id"), "score", "colour")


@query("p25_match_boxes", """SELECT * FROM (SELECT pred_id, greatest(0, CAST(round_even(x + 0.5::DOUBLE, 0) AS BIGINT) - 2) AS x, greatest(0, CAST(round_even(y + 0.5::DOUBLE, 0) AS BIGINT) - 2) AS y,
 least(1400 - greatest(0, CAST(round_even(x + 0.5::DOUBLE, 0) AS BIGINT) - 2), w + 4) AS w, least(990 - greatest(0, CAST(round_even(y + 0.5::DOUBLE, 0) AS BIGINT) - 2), h + 4) AS h, greatest(w, h) AS l FROM v_pred)
 WHERE w > 0 AND h > 0 AND l BETWEEN 20 AND 30""", "v_pred")
def _(v):
    b = Box.cols()
    x0, y0 = b.x + F.lit(0.5), b.y + F.lit(0.5)
    m = geo.match_box(x0, y0, x0 + b.w, y0 + b.h, F.lit(1400).cast("bigint"), F.lit(990).cast("bigint"), 20, 30, 2)
    return (v("v_pred").select("pred_id", m.alias("m"), F.greatest("w", "h").alias("l")).where(F.col("m").isNotNull())
            .select("pred_id", "m.*", "l"))


@query("p29_prompts", "SELECT gt_id, CAST(trunc(x + w / 2.0::DOUBLE) AS BIGINT) AS x, CAST(trunc(y + h / 2.0::DOUBLE) AS BIGINT) AS y, name FROM v_gt", "v_gt")
def _(v):
    x, y = geo.truncated_center(Box.cols())
    return v("v_gt").select("gt_id", x.alias("x"), y.alias("y"), "name")


@query("p26_fingerprint", "SELECT pred_id, substring(sha1(concat_ws('|', CAST(sheet_id AS VARCHAR), model, filt, CAST(w AS VARCHAR))), 1, 20) AS fp FROM v_pred", "v_pred")
def _(v):
    return v("v_pred").select("pred_id", fingerprint(F.col("sheet_id"), F.col("model"), F.col("filt"), F.col("w")).alias("fp"))


@query("w17_peaks", """WITH RECURSIVE grid AS (SELECT sheet_id, CAST(floor(y / 16.0) AS BIGINT) AS row, CAST(floor(x / 16.0) AS BIGINT) AS col, max(score) AS score FROM v_pred GROUP BY ALL),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY score DESC, row * 1000 + col) AS rn FROM grid WHERE score >= 0.4),
 best AS (SELECT * FROM ranked WHERE rn <= 250),
 beat AS (SELECT b.sheet_id, b.rn, list(a.rn) AS better FROM best a JOIN best b ON a.sheet_id = b.sheet_id AND a.rn < b.rn
   AND abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY ALL),
 seq AS (SELECT b.*, coalesce(better, CAST([] AS BIGINT[])) AS better FROM best b LEFT JOIN beat USING (sheet_id, rn)),
 walk AS (SELECT DISTINCT sheet_id, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS alive, false AS kept FROM best
  UNION ALL SELECT s.sheet_id, s.rn, CASE WHEN list_has_any(s.better, w.alive) THEN w.alive ELSE list_append(w.alive, s.rn) END,
   NOT list_has_any(s.better, w.alive) FROM walk w JOIN seq s ON s.sheet_id = w.sheet_id AND s.rn = w.rn + 1)
 SELECT sheet_id, row, col, score FROM walk JOIN best USING (sheet_id, rn) WHERE kept""", "v_pred")
def _(v):
    cells = v("v_pred").select("sheet_id", F.floor(F.col("y") / 16).alias("row"), F.floor(F.col("x") / 16).alias("col"), "score")
    grid = cells.groupBy("sheet_id", "row", "col").agg(F.max("score").alias("score"))
    grid = grid.withColumn("cell_id", F.col("row") * 1000 + F.col("col"))
    return greedy.pick_peaks(grid, SHEET, 0.4, 2, 250).select("sheet_id", "row", "col", "score")


@query("e1_match_finish", f"""WITH RECURSIVE capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY score DESC, pred_id) AS cap FROM v_pred WHERE score >= 0.5) WHERE cap <= 60),
 {nms_sql(0.3, 'capped')} SELECT sheet_id, pred_id, CAST(round_even(x * 1.6::DOUBLE, 0) AS BIGINT) AS x, CAST(round_even(y * 1.6::DOUBLE, 0) AS BIGINT) AS y,
 CAST(round_even(w * 1.6::DOUBLE, 0) AS BIGINT) AS w, CAST(round_even(h * 1.6::DOUBLE, 0) AS BIGINT) AS h, {r4('score')} AS score
 FROM walk k JOIN v_pred USING (sheet_id, pred_id) WHERE kept""", "v_pred")
def _(v):
    """Exemplar match after scanning: threshold, cap, suppress, map back."""
    best = det.cap_detections(v("v_pred").where("score >= 0.5"), SHEET, 60)
    kept = greedy.suppress(best, SHEET, 0.3).where("kept")
    up = [F.rint(F.col(c) * F.lit(1.6)).cast("bigint").alias(c) for c in "xywh"]
    return kept.select("sheet_id", "pred_id", *up, round_exact(F.col("score"), 4).alias("score"))


@query("s12_hits_by_score", """SELECT scan_key, count(*) AS n, min(score) AS lowest FROM (SELECT *, substring(sha1(concat_ws('|', 'segmasks_hits', model, filt, '1024')), 1, 20) AS scan_key FROM v_pred) WHERE score >= 0.25 GROUP BY scan_key""", "v_pred")
def _(v):
    """Hits of ten scans, written to a store and read back key by key at a least score."""
    from functools import reduce

    from boxlake.session import scratch
    from boxlake.sources import writers as wr

    h = v("v_pred").withColumn("scan_key", wr.hits_key(F.col("model"), F.col("filt"), F.lit(1024)))
    path = scratch(v.spark, "hits")
    wr.write_hits(h.where("score < 0.9"), path)
    wr.write_hits(h, path)  # a scan that is stored again replaces its own hits
    keys = sorted(r.scan_key for r in wr.finished_scans(v.spark, path).collect())  # one per detector and filter
    back = reduce(DataFrame.unionByName, [wr.read_hits(v.spark, path, k, 0.25) for k in keys])
    return back.groupBy("scan_key").agg(F.count("*").alias("n"), F.min("score").alias("lowest"))


@query("r5_pending_units", """SELECT DISTINCT sheet_id, model AS scan_key FROM v_pred ANTI JOIN (SELECT DISTINCT sheet_id, model FROM v_pred WHERE score > 0.9) s USING (sheet_id, model)""", "v_pred")
def _(v):
    from boxlake.streaming.incremental import pending

    req = v("v_pred").select("sheet_id", F.col("model").alias("scan_key"), "score")
    return pending(req, req.where("score > 0.9")).select("sheet_id", "scan_key")
