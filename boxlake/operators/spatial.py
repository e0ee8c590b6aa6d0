"""Tile grids and spatial joins as equi-joins on grid cells.

Grids come in levels whose cells grow by ``GROWTH``. A box lies on the level that fits its longer
side, so it covers four cells at most, however large it is; it is also listed on the levels above
that the other side really has. Two boxes meet on the higher of their levels, and only in the cell
that holds the top-left corner of their intersection, so no distinct is needed.
Joins that ask "is there any" run on distinct geometry with semi joins: a spot that holds a
third of all rows as copies becomes one row before the join, and no pair list is written.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.functions.geometry import Box, center, contains, intersection, iou
from boxlake.session import cut, dealt

# Fixed value: default cell side, above the usual 18-31 px side of an annotated box.
CELL = 64
GEO = ["x", "y", "w", "h"]


def _cell(v: Column, cell: float) -> Column:
    return F.floor(v / F.lit(float(cell)))


def cover(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, cell: float = CELL) -> DataFrame:
    """One row per grid cell touched by the closed range; adds ``_cx``, ``_cy``."""
    return (df.withColumn("_cx", F.explode(F.sequence(_cell(x0, cell), _cell(x1, cell))))
            .withColumn("_cy", F.explode(F.sequence(_cell(y0, cell), _cell(y1, cell)))))


def cover_boxes(df: DataFrame, prefix: str = "", cell: float = CELL) -> DataFrame:
    b = Box.cols(prefix)
    return cover(df, b.x, b.y, b.x1, b.y1, cell)


GROWTH = 4


def grade(w: Column, h: Column, cell: float = CELL) -> Column:
    """Level of a box: cells of that level are no narrower than its longer side."""
    longer = F.greatest(w.cast("double"), h.cast("double"), F.lit(float(cell)))
    return F.ceil(F.log(longer / float(cell)) / math.log(GROWTH)).cast("int")


def _side(level: Column, cell: float) -> Column:
    return F.pow(F.lit(float(GROWTH)), level) * float(cell)


def _levels(df: DataFrame, own: Column, top: Column | None) -> DataFrame:
    """Add ``_own`` and one row per level ``_lv`` from there up to ``top`` (its own only without)."""
    d = df.withColumn("_own", own)
    if top is None:
        return d.withColumn("_lv", F.col("_own"))
    d = d.withColumn("_top", F.greatest("_own", top))
    return d.withColumn("_lv", F.explode(F.sequence("_own", "_top"))).drop("_top")


def cover_graded(df: DataFrame, prefix: str = "", cell: float = CELL, top: Column | None = None) -> DataFrame:
    """One row per level and cell; adds ``_own``, ``_lv``, ``_cx``, ``_cy``."""
    b = Box.cols(prefix)
    d = _levels(df, grade(b.w, b.h, cell), top)
    s = _side(F.col("_lv"), cell)
    return (d.withColumn("_cx", F.explode(F.sequence(F.floor(b.x / s), F.floor(b.x1 / s))))
            .withColumn("_cy", F.explode(F.sequence(F.floor(b.y / s), F.floor(b.y1 / s)))))


def top_level(df: DataFrame, prefix: str = "", cell: float = CELL) -> Column:
    """Highest level of a table's boxes as a scalar subquery; null for an empty table."""
    return df.agg(F.max(grade(F.col(f"{prefix}w"), F.col(f"{prefix}h"), cell))).scalar()


def place_graded(df: DataFrame, x: str, y: str, top: Column, cell: float = CELL) -> DataFrame:
    """Points on every level from the lowest to ``top``."""
    d = _levels(df, F.lit(0), top)
    s = _side(F.col("_lv"), cell)
    return d.withColumn("_cx", F.floor(F.col(x) / s)).withColumn("_cy", F.floor(F.col(y) / s)).drop("_own")


def home_graded(boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """Every box once, in the cell of its corner; cells are twice as wide as the largest box of the level."""
    s = _side(F.col("_lv"), cell) * 2
    return (boxes.withColumn("_lv", grade(F.col("w"), F.col("h"), cell))
            .withColumn("_cx", F.floor(F.col("x") / s)).withColumn("_cy", F.floor(F.col("y") / s)))


def reach_graded(points: DataFrame, x: str, y: str, top: Column, cell: float = CELL) -> DataFrame:
    """Points on every level up to ``top``, in the cells of ``home_graded`` whose boxes can hold them: one or two per axis.
    A hundredth more than the largest box is looked back, for rounding."""
    d = _levels(points, F.lit(0), top).drop("_own")
    s = _side(F.col("_lv"), cell)
    back = lambda c: F.explode(F.sequence(F.floor((F.col(c) - s * 1.01) / (s * 2)), F.floor(F.col(c) / (s * 2))))
    return d.withColumn("_cx", back(x)).withColumn("_cy", back(y))


def boxes_over_points(boxes: DataFrame, points: DataFrame, keys: Sequence[str], cell: float = CELL) -> DataFrame:
    """Boxes joined to the points (columns ``p_*``, among them p_x and p_y) that they hold."""
    at = [*keys, "_lv", "_cx", "_cy"]
    p = place_graded(points, "p_x", "p_y", top_level(boxes, cell=cell), cell)
    return (cover_graded(boxes, cell=cell).drop("_own").join(dealt(p), at)
            .where(contains(Box.cols(), F.col("p_x"), F.col("p_y"))).drop("_lv", "_cx", "_cy"))


def place_points(df: DataFrame, x: str, y: str, cell: float = CELL) -> DataFrame:
    return df.withColumn("_cx", _cell(F.col(x), cell)).withColumn("_cy", _cell(F.col(y), cell))


def prefixed(df: DataFrame, prefix: str, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def overlap_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], cell: float = CELL) -> DataFrame:
    """Pairs of boxes with a positive overlap inside each key; columns come back as a_*, b_*."""
    keys = list(keys)
    ca = cover_graded(prefixed(a, "a_", keys), "a_", cell, top_level(b, cell=cell)).withColumnRenamed("_own", "_oa")
    cb = cover_graded(prefixed(b, "b_", keys), "b_", cell, top_level(a, cell=cell)).withColumnRenamed("_own", "_ob")
    ba, bb = Box.cols("a_"), Box.cols("b_")
    x0, y0 = F.greatest(ba.x, bb.x), F.greatest(ba.y, bb.y)
    meet = (F.least(ba.x1, bb.x1) > x0) & (F.least(ba.y1, bb.y1) > y0)
    s = _side(F.col("_lv"), cell)
    own = (F.floor(x0 / s) == F.col("_cx")) & (F.floor(y0 / s) == F.col("_cy")) & (F.col("_lv") == F.greatest("_oa", "_ob"))
    return ca.join(dealt(cb), [*keys, "_lv", "_cx", "_cy"]).where(meet & own).drop("_lv", "_cx", "_cy", "_oa", "_ob")


def iou_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], thr: float, cell: float = CELL) -> DataFrame:
    """Overlapping pairs with IoU of at least ``thr`` (> 0)."""
    pairs = overlap_pairs(a, b, keys, cell)
    return pairs.withColumn("iou", iou(Box.cols("a_"), Box.cols("b_"))).where(F.col("iou") >= thr)


# --- containment ---------------------------------------------------------------------


def containment_hits(boxes: DataFrame, points: DataFrame, keys: Sequence[str], cell: float = CELL,
                     distinct: bool = True, carry: Sequence[str] = (), point_keys: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct boxes that hold a point, and distinct points (px, py) held by a box.

    ``distinct=False`` says the inputs hold each geometry once already; ``carry`` columns
    (functions of the geometry) are then kept. ``point_keys`` are the keys of points that several
    groups of boxes share; held points then come back once per group, and no point is copied before.
    """
    keys, carry, point_keys = list(keys), list(carry), list(point_keys or keys)
    ub = boxes.select(*keys, *GEO, *carry)
    up = points.select(*point_keys, "px", "py", *carry)
    if distinct:
        ub, up = ub.distinct(), up.distinct()
    at = [*point_keys, "_lv", "_cx", "_cy"]
    own = [k for k in keys if k not in point_keys]
    cb = cover_graded(ub, cell=cell).drop("_own")
    cp = place_graded(up, "px", "py", top_level(ub, cell=cell), cell)
    inside = contains(Box.cols(), F.col("px"), F.col("py"))

    def same_cell(left: DataFrame, right: DataFrame) -> Column:
        cond = inside
        for k in at:
            cond = cond & (left[k] == right[k])
        return cond

    spots, covers = dealt(cp.select(*at, "px", "py")), dealt(cb.select(*at, *own, *GEO))
    hit_boxes = cb.join(spots, same_cell(cb, spots), "left_semi").select(*keys, *GEO, *carry).distinct()
    held = cp.join(covers, at).where(inside) if own else cp.join(covers, same_cell(cp, covers), "left_semi")
    return hit_boxes, held.select(*keys, "px", "py", *carry).distinct()


def flag_hits(boxes: DataFrame, points: DataFrame, keys: Sequence[str],
              cell: float = CELL) -> tuple[DataFrame, DataFrame]:
    """Both inputs with a ``hit`` flag: box holds a point / point is held by a box."""
    keys = list(keys)
    hb, hp = containment_hits(boxes, points, keys, cell)
    b = boxes.join(dealt(hb.withColumn("_hit", F.lit(True))), [*keys, *GEO], "left")
    p = points.join(dealt(hp.withColumn("_hit", F.lit(True))), [*keys, "px", "py"], "left")
    done = F.coalesce("_hit", F.lit(False))
    return b.withColumn("hit", done).drop("_hit"), p.withColumn("hit", done).drop("_hit")


def with_center(df: DataFrame) -> DataFrame:
    cx, cy = center(Box.cols())
    return df.withColumn("px", cx).withColumn("py", cy)


def max_iou(cands: DataFrame, gt: DataFrame, keys: Sequence[str], cell: float = CELL) -> DataFrame:
    """Every candidate with its best IoU over all ground-truth boxes of its key (0 without any)."""
    keys = list(keys)
    u = cands.select(*keys, *GEO).distinct()
    pairs = overlap_pairs(u, gt.select(*keys, *GEO).distinct(), keys, cell)
    a, b = Box.cols("a_"), Box.cols("b_")
    best = (pairs.groupBy(*keys, *[F.col("a_" + c).alias(c) for c in GEO])
            .agg(F.max(iou(a, b)).alias("_best")))
    return (cands.join(dealt(best), [*keys, *GEO], "left")
            .withColumn("iou", F.coalesce("_best", F.lit(0.0))).drop("_best"))


# --- tiles ---------------------------------------------------------------------------


def starts_flushed(total: Column, tile: Column, step: Column) -> Column:
    """Regular starts plus a last one flush with the far edge."""
    inner = F.sequence(F.lit(0).cast("bigint"), F.greatest(total - tile, F.lit(0)), step)
    return F.when(total <= tile, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.array_union(inner, F.array(total - tile)))


def tile_grid(sheets: DataFrame, tile: int = 640, overlap: int = 96) -> DataFrame:
    """Overlapping square tiles per sheet (width, height); the last row and column sit flush."""
    t = max(64, int(tile))
    o = max(0, min(int(overlap), t - 1))
    lt, ls = F.lit(t).cast("bigint"), F.lit(max(1, t - o)).cast("bigint")
    w, h = F.col("width").cast("bigint"), F.col("height").cast("bigint")
    nx = F.size(starts_flushed(w, lt, ls))
    return (sheets.select("*", nx.alias("_nx"), F.posexplode(starts_flushed(h, lt, ls)).alias("_iy", "y0"))
            .select("*", F.posexplode(starts_flushed(w, lt, ls)).alias("_ix", "x0"))
            .withColumn("tile", (F.col("_iy") * F.col("_nx") + F.col("_ix")).cast("bigint"))
            .withColumn("x1", F.least(F.col("x0") + t, w)).withColumn("y1", F.least(F.col("y0") + t, h))
            .drop("_nx", "_ix", "_iy"))


def match_tile_grid(sheets: DataFrame, max_tw: int, max_th: int, tile: int = 1024, margin: int = 16) -> DataFrame:
    """Flush grid for template search: overlap covers the largest template plus a margin."""
    eff = max(tile, max_tw + 1, max_th + 1)
    lt = F.lit(eff).cast("bigint")
    sx = F.lit(max(1, eff - max_tw - margin)).cast("bigint")
    sy = F.lit(max(1, eff - max_th - margin)).cast("bigint")
    w, h = F.col("width").cast("bigint"), F.col("height").cast("bigint")
    return (sheets.select("*", F.explode(starts_flushed(h, lt, sy)).alias("y0"))
            .select("*", F.explode(starts_flushed(w, lt, sx)).alias("x0"))
            .withColumn("x1", F.least(F.col("x0") + eff, w)).withColumn("y1", F.least(F.col("y0") + eff, h)))


def tile_grid_clipped(sheets: DataFrame, tile: int = 1024, overlap: int = 128) -> DataFrame:
    """Overlapping tiles whose last row and column are cut at the edge."""
    step = max(1, tile - overlap)

    def starts(total: Column) -> Column:
        return F.sequence(F.lit(0).cast("bigint"),
                          F.greatest(F.lit(1), total.cast("bigint") - overlap) - 1,
                          F.lit(step).cast("bigint"))

    return (sheets.select("*", F.explode(starts(F.col("height"))).alias("y0"))
            .select("*", F.explode(starts(F.col("width"))).alias("x0"))
            .withColumn("x1", F.least(F.col("x0") + tile, F.col("width").cast("bigint")))
            .withColumn("y1", F.least(F.col("y0") + tile, F.col("height").cast("bigint"))))


def assign_tiles(points: DataFrame, tiles: DataFrame, keys: Sequence[str], tile_side: int) -> DataFrame:
    """Exactly one tile per point: the one it lies deepest in, the first on ties, else tile 0.

    Points meet tiles on cells of the tile side, so each point sees only the few tiles
    around it. Points are collapsed to distinct positions first.
    """
    keys = list(keys)
    t = cover(tiles.select(*keys, "tile", "x0", "y0", "x1", "y1"),
              F.col("x0"), F.col("y0"), F.col("x1") - 1, F.col("y1") - 1, tile_side)
    u = place_points(points.select(*keys, "x", "y").distinct(), "x", "y", tile_side)
    x, y = F.col("x"), F.col("y")
    inside = (x >= F.col("x0")) & (x < F.col("x1")) & (y >= F.col("y0")) & (y < F.col("y1"))
    margin = F.least(x - F.col("x0"), F.col("x1") - x, y - F.col("y0"), F.col("y1") - y)
    best = (u.join(t, [*keys, "_cx", "_cy"]).where(inside)
            .groupBy(*keys, "x", "y")
            .agg(F.max_by("tile", F.struct(margin, -F.col("tile"))).alias("tile")))
    return (points.join(best, [*keys, "x", "y"], "left")
            .withColumn("tile", F.coalesce("tile", F.lit(0).cast("bigint"))))


def boxes_on_tiles(boxes: DataFrame, tiles: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    """Boxes that strictly overlap a tile, with tile-local corners."""
    t = tiles.select(*keys, "tile", F.col("x0").alias("x"), F.col("y0").alias("y"),
                     (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    p = overlap_pairs(boxes, t, keys, cell)
    rest = [F.col(c).alias(c[2:]) for c in p.columns
            if c.startswith("a_") and c[2:] not in GEO]
    return p.select(*keys, *rest, F.col("b_tile").alias("tile"),
                    (F.col("a_x") - F.col("b_x")).alias("x"), (F.col("a_y") - F.col("b_y")).alias("y"),
                    F.col("a_w").alias("w"), F.col("a_h").alias("h"),
                    F.col("b_w").alias("tile_w"), F.col("b_h").alias("tile_h"))


def covered_patches(boxes: DataFrame, tiles: DataFrame, keys: Sequence[str], cell: float,
                    coverage: float = 0.5) -> DataFrame:
    """Patch annotations: boxes with at least ``coverage`` of their area on the patch."""
    on = boxes_on_tiles(boxes, tiles, keys, cell)
    tile_box = Box(F.lit(0), F.lit(0), F.col("tile_w"), F.col("tile_h"))
    frac = intersection(Box.cols(), tile_box) / (F.col("w") * F.col("h"))
    return on.withColumn("coverage", frac).where(F.col("coverage") >= coverage)


def clip_to_roi(boxes: DataFrame, rois: DataFrame, keys: Sequence[str], cell: float = CELL) -> DataFrame:
    """Boxes cut to each region they overlap and shifted to its corner (``roi`` names it)."""
    p = overlap_pairs(boxes, rois.select(*keys, "roi", *GEO), keys, cell)
    a, b = Box.cols("a_"), Box.cols("b_")
    x, y = F.greatest(a.x, b.x), F.greatest(a.y, b.y)
    rest = [F.col(c).alias(c[2:]) for c in p.columns if c.startswith("a_") and c[2:] not in GEO]
    return p.select(*keys, *rest, F.col("b_roi").alias("roi"), (x - b.x).alias("x"), (y - b.y).alias("y"),
                    (F.least(a.x1, b.x1) - x).alias("w"), (F.least(a.y1, b.y1) - y).alias("h"))


# --- neighbours ----------------------------------------------------------------------


def distinct_points(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct positions with the number of points on each."""
    return points.groupBy(*keys, "x", "y").agg(F.count("*").alias("n"))


def pairs_within(points: DataFrame, keys: Sequence[str], reach: float) -> DataFrame:
    """Pairs of different distinct positions at most ``reach`` apart on each axis (both orders)."""
    keys = list(keys)
    a = place_points(prefixed(points, "a_", keys), "a_x", "a_y", reach)
    b = place_points(prefixed(points, "b_", keys), "b_x", "b_y", reach)
    ring = F.sequence(F.lit(-1), F.lit(1))
    a = (a.withColumn("_cx", F.explode(F.transform(ring, lambda d: F.col("_cx") + d)))
         .withColumn("_cy", F.explode(F.transform(ring, lambda d: F.col("_cy") + d))))
    dx, dy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    return (a.join(b, [*keys, "_cx", "_cy"])
            .where((F.abs(dx) <= reach) & (F.abs(dy) <= reach) & ((dx != 0) | (dy != 0)))
            .withColumn("d2", (dx * dx + dy * dy).cast("double")).drop("_cx", "_cy"))


def nearest_distance(points: DataFrame, keys: Sequence[str], reach: float = CELL) -> DataFrame:
    """Distance to the nearest other point of the key (null for a lone point); copies give 0.

    Cells of side ``reach`` settle every point with a neighbour in reach. Whoever stays open
    is tried again with a reach eight times as wide, against *all* positions, until none is
    open: the widening stops at the span of the data, so the loop is short and the result exact.
    """
    keys = list(keys)
    pos = cut(distinct_points(points, keys))
    span = pos.groupBy(*keys).agg((F.max("x") - F.min("x")).alias("sx"), (F.max("y") - F.min("y")).alias("sy"),
                                  F.count("*").alias("positions"))
    widest = span.agg(F.max(F.greatest("sx", "sy"))).first()[0] or 0
    settled = pos.where("n > 1").select(*keys, "x", "y", F.lit(0.0).alias("nn"))
    open_pos = cut(pos.where("n = 1").join(span.where("positions > 1").select(*keys), keys, "left_semi")
                   .select(*keys, "x", "y"))
    while not open_pos.isEmpty():
        found = cut(_nearest_in_reach(open_pos, pos.select(*keys, "x", "y"), keys, reach, reach > widest))
        settled = settled.unionByName(found)
        open_pos = cut(open_pos.join(found, [*keys, "x", "y"], "left_anti"))
        reach *= 8
    return points.join(settled, [*keys, "x", "y"], "left")


def _nearest_in_reach(q: DataFrame, pos: DataFrame, keys: list[str], reach: float, last: bool) -> DataFrame:
    """Exact nearest distance for those of ``q`` that have one no longer than ``reach``."""
    a = place_points(prefixed(q, "a_", keys), "a_x", "a_y", reach)
    b = place_points(prefixed(pos, "b_", keys), "b_x", "b_y", reach)
    ring = F.sequence(F.lit(-1), F.lit(1))
    a = (a.withColumn("_cx", F.explode(F.transform(ring, lambda d: F.col("_cx") + d)))
         .withColumn("_cy", F.explode(F.transform(ring, lambda d: F.col("_cy") + d))))
    dx, dy = (F.col("b_x") - F.col("a_x")).cast("double"), (F.col("b_y") - F.col("a_y")).cast("double")
    best = (a.join(b, [*keys, "_cx", "_cy"]).where((dx != 0) | (dy != 0))
            .groupBy(*keys, F.col("a_x").alias("x"), F.col("a_y").alias("y"))
            .agg(F.sqrt(F.min(dx * dx + dy * dy)).alias("nn")))
    return best if last else best.where(F.col("nn") <= reach)


def adaptive_window(nn: Column, crop: int, min_box: int, min_symbol: int, frac: float = 0.75) -> Column:
    """Crop half-side drawn in towards the nearest neighbour, never below one symbol."""
    floor = F.lit(float(max(min_box, min_symbol)))
    shrunk = F.rint(F.least(F.lit(float(crop)), F.greatest(floor, nn * frac)))
    return F.when(nn.isNull(), F.lit(crop)).otherwise(shrunk).cast("bigint")


def window_neighbours(points: DataFrame, keys: Sequence[str], half: int, k: int = 16) -> DataFrame:
    """Up to ``k`` nearest other points strictly inside a square window, ties by point id.

    Per distinct position only its ``k`` smallest ids can matter (``k + 1`` with the asking
    point itself), so stacks of copies are cut to that before positions meet.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys, "x", "y").orderBy("pt_idx")
    few = (points.select(*keys, "pt_idx", "x", "y").withColumn("_r", F.row_number().over(w))
           .where(F.col("_r") <= k + 1).drop("_r"))
    a = place_points(prefixed(points.select(*keys, "pt_idx", "x", "y"), "a_", keys), "a_x", "a_y", half)
    b = place_points(prefixed(few, "b_", keys), "b_x", "b_y", half)
    ring = F.sequence(F.lit(-1), F.lit(1))
    a = (a.withColumn("_cx", F.explode(F.transform(ring, lambda d: F.col("_cx") + d)))
         .withColumn("_cy", F.explode(F.transform(ring, lambda d: F.col("_cy") + d))))
    dx, dy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    d2 = dx * dx + dy * dy
    near = (a.join(b, [*keys, "_cx", "_cy"])
            .where((F.abs(dx) < half) & (F.abs(dy) < half) & (F.col("a_pt_idx") != F.col("b_pt_idx")))
            .select(*keys, F.col("a_pt_idx").alias("pt_idx"), F.col("b_pt_idx").alias("neighbour"),
                    d2.alias("d2")))
    r = F.row_number().over(Window.partitionBy(*keys, "pt_idx").orderBy("d2", "neighbour"))
    return near.withColumn("rank", r).where(F.col("rank") <= k)


def densest_point(points: DataFrame, keys: Sequence[str], radius: float = 250) -> DataFrame:
    """Per key the point with most points within ``radius`` (itself included); first id on ties.

    Works on distinct positions with counts; the id of the winning position is its smallest.
    """
    keys = list(keys)
    pos = points.groupBy(*keys, "x", "y").agg(F.count("*").alias("n"), F.min("pt_idx").alias("pt_idx"))
    near = pairs_within(pos.select(*keys, "x", "y", "n"), keys, radius).where(F.col("d2") <= radius * radius)
    around = near.groupBy(*keys, F.col("a_x").alias("x"), F.col("a_y").alias("y")).agg(F.sum("b_n").alias("_m"))
    cnt = (pos.join(around, [*keys, "x", "y"], "left")
           .withColumn("neighbours", F.col("n") + F.coalesce("_m", F.lit(0))))
    return cnt.groupBy(*keys).agg(
        F.max_by("pt_idx", F.struct("neighbours", -F.col("pt_idx"))).alias("pt_idx"),
        F.max("neighbours").alias("neighbours"))
