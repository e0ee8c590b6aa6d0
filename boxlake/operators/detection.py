"""Detector evaluation: centre hits, IoU matches, sweeps over detectors, labels for candidates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.functions.geometry import Box, contains
from boxlake.functions.numeric import f1, prf_columns, ratio, round_exact
from boxlake.functions.text import draw_key
from boxlake.operators.greedy import box_classes, match_one_to_one
from boxlake.operators.ranking import exact_rank, hash_rank, top_n
from boxlake.operators.spatial import CELL, containment_hits, max_iou, with_center
from boxlake.session import cut, dealt


# --- sweep grid ----------------------------------------------------------------------


def sweep_grid(spark, models: str, filters: str, gts: str) -> DataFrame:
    """Every (gt_mode, model, filt) from three comma lists; blanks dropped, defaults when empty."""
    one = spark.range(1).select(F.lit(models).alias("models"), F.lit(filters).alias("filters"), F.lit(gts).alias("gts"))
    return sweep_grids(one, [])


def sweep_grids(requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The grid of every request row (keys, models, filters, gts as comma lists)."""

    def items(text: str, default: str) -> Column:
        parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
        return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(default)))

    one = requests.select(*keys, items("gts", "bboxes").alias("g"), items("models", "fastsam").alias("m"), items("filters", "none").alias("f"))
    return (one.select(*keys, F.explode("g").alias("gt_mode"), "m", "f")
            .select(*keys, "gt_mode", F.explode("m").alias("model"), "f")
            .select(*keys, "gt_mode", "model", F.explode("f").alias("filt")))


# --- per-sheet evaluation ------------------------------------------------------------


def repeat_for(df: DataFrame, combos: Column | None) -> DataFrame:
    """One copy per swept combination: ``combos`` is a short literal array of structs."""
    return df if combos is None else df.withColumn("_c", F.explode(combos)).select("*", "_c.*").drop("_c")


def tally(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row per key from tables of partial counters, missing ones 0.

    The tables are stacked and summed, not joined: each has a row per key, and joins of that many would
    all be broadcast at once while they look small."""
    keys, names = list(keys), dict.fromkeys(c for p in parts for c in p.columns if c not in keys)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    zero = {c: F.lit(0.0 if c == "iou_sum" else 0) for c in names}
    return rows.groupBy(*keys).agg(*[F.coalesce(F.sum(c), zero[c]).alias(c) for c in names])


def sheet_counts(boxes: DataFrame, gt: DataFrame, keys: Sequence[str], gt_keys: Sequence[str],
                 combos: Column | None = None) -> list[DataFrame]:
    """n_pred and n_gt for every key present on either side; ``boxes`` are counted distinct boxes."""
    keys = list(keys)
    g = repeat_for(gt.groupBy(*gt_keys).agg(F.count("*").alias("n_gt")), combos)
    return [boxes.groupBy(*keys).agg(F.sum("pn").alias("n_pred")), g.select(*keys, "n_gt")]


def center_counts(boxes: DataFrame, points: DataFrame, keys: Sequence[str], gt_keys: Sequence[str],
                  combos: Column | None = None) -> list[DataFrame]:
    """Per key: predictions that hold a point (pred_hits) and points held (gt_found).

    Both sides are counted per distinct geometry; points are shared by the swept combinations, and only
    boxes of those count.
    """
    keys = list(keys)
    n_pt = points.groupBy(*gt_keys, "px", "py").agg(F.count("*").alias("pn"))
    if combos is not None:
        own = [k for k in keys if k not in gt_keys]
        boxes = boxes.where(F.exists(combos, lambda c: reduce(Column.__and__, [c[k] == F.col(k) for k in own])))
    hb, hp = containment_hits(boxes, n_pt, keys, distinct=False, carry=["pn"], point_keys=gt_keys)
    return [hb.groupBy(*keys).agg(F.sum("pn").alias("pred_hits")), hp.groupBy(*keys).agg(F.sum("pn").alias("gt_found"))]


def evaluate_sheets(pred: DataFrame, gt: DataFrame, keys: Sequence[str], thr: float = 0.5,
                    gt_keys: Sequence[str] | None = None, combos: Column | None = None,
                    boxes: DataFrame | None = None) -> DataFrame:
    """Raw counters per key: n_pred, n_gt, pred_hits, gt_found, matches, iou_sum.

    For a sweep the predictions carry the combination in ``keys`` while the ground truth has
    ``gt_keys`` only; ``combos`` lists the combinations. Predictions are collapsed to counted
    distinct boxes once (``boxes`` when the caller has them) and every part reads those.
    """
    keys, gt_keys = list(keys), list(gt_keys or keys)
    boxes = cut(box_classes(pred, keys)) if boxes is None else boxes
    m = (match_one_to_one(pred, gt, keys, thr, gt_keys=gt_keys, pred_classes=boxes).groupBy(*keys)
         .agg(F.count("*").alias("matches"), F.sum("iou").alias("iou_sum")))
    return tally([*sheet_counts(boxes, gt, keys, gt_keys, combos),
                  *center_counts(boxes, with_center(gt), keys, gt_keys, combos), m], keys)


def evaluate_sheets_points(pred: DataFrame, points: DataFrame, keys: Sequence[str],
                           gt_keys: Sequence[str] | None = None, combos: Column | None = None,
                           boxes: DataFrame | None = None) -> DataFrame:
    """The same counters against points (px, py); the IoU part is zero."""
    keys, gt_keys = list(keys), list(gt_keys or keys)
    boxes = box_classes(pred, keys) if boxes is None else boxes
    out = tally([*sheet_counts(boxes, points, keys, gt_keys, combos),
                 *center_counts(boxes, points, keys, gt_keys, combos)], keys)
    return (out.withColumn("matches", F.lit(0).cast("bigint")).withColumn("iou_sum", F.lit(0.0)))


def sheet_metrics(counters: DataFrame, keys: Sequence[str], gt_recall: bool = False) -> DataFrame:
    """Rounded metric blocks per key.

    The box evaluation takes its centre recall from predicted hits over n_gt
    (``center_recall``); points and sweeps take it from the ground truth that was found.
    ``center_recall_gt`` always carries the latter.
    """
    recall_gt = ratio(F.col("gt_found"), F.col("n_gt"))
    if gt_recall:
        p = ratio(F.col("pred_hits"), F.col("n_pred"))
        center = [round_exact(p, 4).alias("center_precision"), round_exact(recall_gt, 4).alias("center_recall"),
                  round_exact(f1(p, recall_gt), 4).alias("center_f1")]
    else:
        center = prf_columns(F.col("pred_hits"), F.col("n_pred"), F.col("n_gt"), "center_")
    return counters.select(
        *keys, "n_pred", "n_gt", "pred_hits", "gt_found", "matches", *center,
        round_exact(recall_gt, 4).alias("center_recall_gt"),
        *prf_columns(F.col("matches"), F.col("n_pred"), F.col("n_gt"), "iou_"),
        round_exact(ratio(F.col("iou_sum"), F.col("matches")), 4).alias("mean_iou"))


def sweep(counters: DataFrame, combo: Sequence[str]) -> DataFrame:
    """Micro-averages per combination over its sheets.

    Mean IoU weighs the rounded per-sheet means by their matches; centre recall comes from
    gt_found while centre F1 keeps the value of the predicted-hit recall.
    """
    combo = list(combo)
    c = counters.withColumn("_w", round_exact(ratio(F.col("iou_sum"), F.col("matches")), 4) * F.col("matches"))
    agg = c.groupBy(*combo).agg(*[F.sum(x).alias(x) for x in (
        "n_pred", "n_gt", "pred_hits", "gt_found", "matches", "_w")], F.count("*").alias("n_sheets"))
    center = prf_columns(F.col("pred_hits"), F.col("n_pred"), F.col("n_gt"), "center_")
    return agg.select(
        *combo, "n_sheets", "n_pred", "n_gt", "pred_hits", "gt_found", "matches",
        center[0], round_exact(ratio(F.col("gt_found"), F.col("n_gt")), 4).alias("center_recall"), center[2],
        *prf_columns(F.col("matches"), F.col("n_pred"), F.col("n_gt"), "iou_"),
        round_exact(ratio(F.col("_w"), F.col("matches")), 4).alias("mean_iou"))


def match_status(pred: DataFrame, gt: DataFrame, keys: Sequence[str], thr: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Predictions tagged tp/fp and ground truth tagged matched/missed."""
    keys = list(keys)
    m = match_one_to_one(pred, gt, keys, thr)
    p = pred.join(m.select(*keys, "pred_id", F.lit("tp").alias("status")), [*keys, "pred_id"], "left")
    g = gt.join(m.select(*keys, "gt_id", F.lit("matched").alias("status")), [*keys, "gt_id"], "left")
    return p.fillna("fp", ["status"]), g.fillna("missed", ["status"])


# --- candidates ----------------------------------------------------------------------


def label_candidates(cands: DataFrame, gt: DataFrame, keys: Sequence[str], pos: float = 0.5,
                     neg: float = 0.1) -> DataFrame:
    """Best IoU decides: 1 from ``pos`` up, 0 below ``neg``, rows between are dropped."""
    iou = F.col("iou")
    return (max_iou(cands, gt, keys)
            .withColumn("label", F.when(iou >= pos, F.lit(1)).when(iou < neg, F.lit(0)))
            .where(F.col("label").isNotNull()))


def mine_negatives(labelled: DataFrame, keys: Sequence[str], per_pos: int = 4, seed: int = 0,
                   id_col: str = "pred_id") -> DataFrame:
    """All positives of a sheet plus ``per_pos`` negatives for each: the harder half by IoU,
    the rest drawn by key. Few negatives are all kept; a sheet without positives gives nothing.
    """
    keys, labelled = list(keys), cut(labelled)  # read for the counts, the kept rows and the ranks
    n = labelled.groupBy(*keys).agg(F.sum("label").alias("_pos"), F.count("*").alias("_all"))
    rows = (labelled.join(n.where(F.col("_pos") > 0), keys)
            .withColumn("_budget", F.col("_pos") * per_pos).withColumn("_neg", F.col("_all") - F.col("_pos")))
    keep_all = (F.col("label") == 1) | (F.col("_neg") <= F.col("_budget"))
    hard = exact_rank(rows.where(~keep_all), keys, [F.desc("iou"), F.asc(id_col)], "_hard")
    n_hard = F.floor(F.col("_budget") / 2)
    rest = hash_rank(hard.where(F.col("_hard") > n_hard).withColumn("_key", draw_key(seed, F.col(id_col))),
                     keys, "_key", "_draw")
    cols = labelled.columns
    return (rows.where(keep_all).select(*cols)
            .unionByName(hard.where(F.col("_hard") <= n_hard).select(*cols))
            .unionByName(rest.where(F.col("_draw") <= F.col("_budget") - n_hard).select(*cols)))


def mining_tallies(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positives and negatives per sheet and split, with subtotals and the grand total."""
    return rows.rollup("split", *keys).agg(
        F.count("*").alias("n"), F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))


def covering_choice(masks: DataFrame, points: DataFrame, keys: Sequence[str], crop_area: float,
                    max_box_frac: float = 1.0, size_ratio: float = 1.4, max_symbol: float = 50) -> DataFrame:
    """One box per point from the masks over it.

    Masks no larger than ``size_ratio`` times the upper median area are joined; an oversized
    union falls back to the smallest mask, with that mask's score.
    """
    keys = list(keys)
    from boxlake.operators.spatial import boxes_over_points, prefixed

    m = masks.where((F.col("w") * F.col("h")) <= max_box_frac * crop_area)
    # points on one position share their box, so positions are joined once
    pt = prefixed(points.select(*keys, "x", "y").distinct(), "p_", keys)
    hit = boxes_over_points(m, pt, keys).withColumn("area", F.col("w") * F.col("h"))
    point = [*keys, "p_x", "p_y"]
    mid = hit.groupBy(*point).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY area DESC)").alias("_med"))
    near = F.col("area") <= size_ratio * F.col("_med")
    x1, y1 = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    first = F.struct("area", "mask_id")
    agg = hit.join(mid, point).groupBy(*point).agg(
        F.min(F.when(near, F.col("x"))).alias("ux0"), F.min(F.when(near, F.col("y"))).alias("uy0"),
        F.max(F.when(near, x1)).alias("ux1"), F.max(F.when(near, y1)).alias("uy1"),
        F.max(F.when(near, F.col("score"))).alias("us"),
        F.min_by(F.struct("x", "y", x1.alias("x1"), y1.alias("y1"), "score"), first).alias("core"))
    big = ((F.col("ux1") - F.col("ux0")) > max_symbol) | ((F.col("uy1") - F.col("uy0")) > max_symbol)

    def pick(core: str, union: str) -> Column:
        return F.when(big, F.col(f"core.{core}")).otherwise(F.col(union))

    spots = agg.select(*keys, F.col("p_x").alias("x"), F.col("p_y").alias("y"), pick("x", "ux0").alias("x0"),
                       pick("y", "uy0").alias("y0"), pick("x1", "ux1").alias("x1"), pick("y1", "uy1").alias("y1"),
                       pick("score", "us").alias("score"))
    return (points.select(*keys, "pt_idx", "x", "y").join(spots, [*keys, "x", "y"])
            .select(*keys, "pt_idx", "x0", "y0", "x1", "y1", "score"))


def best_mask(masks: DataFrame, keys: Sequence[str], within: Column | None = None) -> DataFrame:
    """Best mask per point by (within size, score, smaller area); without ``within`` by the last two."""
    order = [F.col("score"), -(F.col("w") * F.col("h")), -F.col("mask_id")]
    if within is not None:
        order = [within, *order]
    return masks.groupBy(*keys).agg(F.max_by(F.struct("mask_id", "x", "y", "w", "h", "score"),
                                             F.struct(*order)).alias("b")).select(*keys, "b.*")


def cap_detections(dets: DataFrame, keys: Sequence[str], n: int = 4000, id_col: str = "pred_id") -> DataFrame:
    """Best ``n`` detections per sheet by score."""
    return top_n(dets, keys, [F.desc("score"), F.asc(id_col)], n).drop("rank")


def first_rows(rows: DataFrame, keys: Sequence[str], idx: str, n: int) -> DataFrame:
    """First ``n`` rows per sheet in input order; 0 keeps all."""
    return rows if n <= 0 else top_n(rows, keys, [F.asc(idx)], n).drop("rank")


# --- merging detectors ---------------------------------------------------------------


def boxes_to_points(boxes: DataFrame, points: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Point of each box: the point inside nearest its centre, else the nearest of the sheet.

    Boxes travel once, to the cell of their corner, with all their columns; points go to the cells whose boxes can reach
    them. So the best point is known where the box lies, and only boxes without one go on."""
    from boxlake.operators.spatial import grade, home_graded, prefixed, reach_graded

    keys = list(keys)
    pts = cut(points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(*keys, "x", "y").agg(F.min("pt_idx").alias("pt_idx")))
    at = [*keys, "_lv", "_cx", "_cy"]
    top = boxes.agg(F.max(grade(F.col("w"), F.col("h")))).first()[0]
    near_by = reach_graded(prefixed(pts, "p_", keys), "p_x", "p_y", F.lit(top).cast("int"))
    d = (F.col("p_x") - (F.col("x") + F.col("w") / 2.0)) ** 2 + (F.col("p_y") - (F.col("y") + F.col("h") / 2.0)) ** 2
    inside = contains(Box.cols(), F.col("p_x"), F.col("p_y"))
    best = (home_graded(boxes).join(dealt(near_by), at, "left")
            .groupBy(*at, *[c for c in boxes.columns if c not in keys])
            .agg(F.min(F.when(inside, F.struct(d.alias("d"), F.col("p_pt_idx").alias("p")))).alias("_b"))
            .select(*boxes.columns, F.col("_b.p").alias("pt_idx")))
    lost = cut(best.where(F.col("pt_idx").isNull()).drop("pt_idx"))
    near = nearest_point(lost, pts, keys, id_col)
    return best.where(F.col("pt_idx").isNotNull()).unionByName(lost.join(dealt(near), [*keys, id_col]).select(*boxes.columns, "pt_idx"))


def nearest_point(boxes: DataFrame, pts: DataFrame, keys: Sequence[str], id_col: str, reach: float = 2 * CELL) -> DataFrame:
    """Nearest point to each box centre, widening the search only for boxes still open.

    Cells are four times as wide as the reach, so a centre visits two or three of them."""
    from boxlake.operators.spatial import cover, place_points, prefixed

    keys = list(keys)
    q = cut(boxes.select(*keys, id_col, (F.col("x") + F.col("w") / 2.0).alias("qx"),
                         (F.col("y") + F.col("h") / 2.0).alias("qy")).where(F.col("qx").isNotNull() & F.col("qy").isNotNull())
            .join(dealt(pts.select(*keys).distinct()), keys, "left_semi"))
    ext = pts.select("x", "y").unionByName(q.select(F.col("qx").alias("x"), F.col("qy").alias("y"))).agg(
        F.max("x"), F.min("x"), F.max("y"), F.min("y")).first()
    widest = 0 if ext[0] is None else max(ext[0] - ext[1], ext[2] - ext[3])
    out = None
    while not q.isEmpty():
        x, y = F.col("qx"), F.col("qy")
        a = cover(q, x - reach, y - reach, x + reach, y + reach, 4 * reach)
        b = place_points(prefixed(pts, "p_", keys), "p_x", "p_y", 4 * reach)
        d = (F.col("p_x") - F.col("qx")) ** 2 + (F.col("p_y") - F.col("qy")) ** 2
        best = a.join(dealt(b), [*keys, "_cx", "_cy"]).groupBy(*keys, id_col).agg(
            F.min(F.struct(d.alias("d"), F.col("p_pt_idx").alias("p"))).alias("b"))
        if reach <= widest:
            best = best.where(F.col("b.d") <= float(reach) * float(reach))
        found = cut(best.select(*keys, id_col, F.col("b.p").alias("pt_idx")))
        out = found if out is None else out.unionByName(found)
        q = cut(q.join(dealt(found), [*keys, id_col], "left_anti"))
        reach *= 8
    return out if out is not None else boxes.select(*keys, id_col, F.lit(None).cast("bigint").alias("pt_idx")).limit(0)


def tighter_per_point(boxes: DataFrame, point: Sequence[str], by: str, first: str, second: str) -> DataFrame:
    """``tighter_box`` of the ``one_box_per_point`` of two detectors, ``by`` naming the detector, in one grouping."""
    box = F.struct("x", "y", "w", "h", "score", "source")
    last = lambda name: F.max_by(box, F.when(F.col(by) == name, F.col("pred_id")))
    m = boxes.where(F.col(by).isin(first, second)).groupBy(*point).agg(last(first).alias("_a"), last(second).alias("_b"))
    return m.select(*point, _tighter().alias("_m")).select(*point, "_m.*")


def tighter_box(a: DataFrame, b: DataFrame, point: Sequence[str]) -> DataFrame:
    """Per point the box with the smaller area (``a`` on ties), or the only one."""
    point = list(point)
    sa = a.select(*point, F.struct("x", "y", "w", "h", "score", "source").alias("_a"))
    sb = b.select(*point, F.struct("x", "y", "w", "h", "score", "source").alias("_b"))
    return sa.join(sb, point, "full_outer").select(*point, _tighter().alias("_m")).select(*point, "_m.*")


def _tighter() -> Column:
    area_a, area_b = F.col("_a.w") * F.col("_a.h"), F.col("_b.w") * F.col("_b.h")
    use_b = F.col("_a").isNull() | (F.col("_b").isNotNull() & (area_b < area_a))
    return F.when(use_b, F.col("_b")).otherwise(F.col("_a"))


def one_box_per_point(boxes: DataFrame, point: Sequence[str]) -> DataFrame:
    """When several boxes of a detector land on one point the last one (largest id) stays."""
    return boxes.groupBy(*point).agg(
        F.max_by(F.struct("x", "y", "w", "h", "score", "source"), "pred_id").alias("b")).select(*point, "b.*")


def with_fallback(points: DataFrame, model: DataFrame, components: DataFrame, point: Sequence[str],
                  max_frac: float = 1.0) -> DataFrame:
    """Model box, else component box when at least one of its sides fits the window, else none."""
    point = list(point)
    m = model.select(*point, F.struct("x", "y", "w", "h", "score", "source").alias("_m"))
    fits = (F.col("w") <= max_frac * F.col("win_w")) | (F.col("h") <= max_frac * F.col("win_h"))
    c = components.where(fits).select(*point, F.struct(
        "x", "y", "w", "h", F.lit(0.0).alias("score"), F.lit("cc").alias("source")).alias("_c"))
    return (points.select(*point).join(m, point, "left").join(c, point, "left")
            .select(*point, F.coalesce("_m", "_c").alias("_b")).where(F.col("_b").isNotNull())
            .select(*point, "_b.*"))

