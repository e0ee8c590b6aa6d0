"""Greedy suppression and one-to-one matching as rounds of joins, equal to the sequential result.

Both loops keep their state in checkpointed tables and go on until nothing is left; every round
settles at least the best pair or box of each key. ``max_rounds`` is a guard for tests. Identical boxes are collapsed first, so a stack of copies that
holds a third of the rows is one row (suppression) or one row with a count (matching).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.functions.geometry import Box, iou
from boxlake.operators.ranking import exact_rank
from boxlake.operators.spatial import CELL, GEO, cover_boxes, iou_pairs
from boxlake.session import cut, dealt

Conflict = Callable[[Box, Box], Column]


#: most boxes of a cell that are compared all with all; fuller cells go through rounds first
CROWD = 64


def suppress(boxes: DataFrame, keys: Sequence[str], thr: float = 0.3, id_col: str = "pred_id",
             score: str = "score", cell: float | None = None, frontier: int = 16,
             max_rounds: int | None = None, crowd: int = CROWD) -> DataFrame:
    """Non-maximum suppression: ``kept`` is true for boxes the score-descending greedy keeps.

    Order is score descending, then id ascending. A box goes when a kept box overlaps it with
    IoU above ``thr``. Copies of a box always fall to their best one when ``thr`` < 1, so only
    that one enters the rounds; boxes without area never conflict and stay. Boxes that conflict
    differ by at most 1 / ``thr`` in their longer sides, so each box lies on the grid of its own
    size and on the next larger one: small boxes beside huge ones do not crowd a cell. Below 0.05
    boxes of nearly any two sizes may conflict, and one grid serves all; ``cell`` forces that.
    """
    keys = list(keys)
    flat = (F.col("w") <= 0) | (F.col("h") <= 0)
    reps = (boxes.where(~flat).groupBy(*keys, *GEO)
            .agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(id_col)).alias("i"))).alias("_b"))
            .select(*keys, *GEO, F.col("_b.s").alias("_s"), (-F.col("_b.i")).alias("_id")))
    if cell is None and thr >= 0.05:
        cells, at, side = by_size(reps, min(0.9, thr)), ["_g", "_cx", "_cy"], _size_side(min(0.9, thr))
    else:
        cells = cover_boxes(reps, cell=cell or CELL).withColumn("_home", F.lit(True))
        at, side = ["_cx", "_cy"], F.lit(float(cell or CELL))
    kept = _greedy_rounds(reps, cells, keys, at, side, lambda a, b: iou(a, b) > thr, frontier, max_rounds, crowd)
    ids = kept.select(*keys, F.col("_id").alias(id_col)).withColumn("_kept", F.lit(True))
    return (boxes.join(dealt(ids), [*keys, id_col], "left")
            .withColumn("kept", F.coalesce("_kept", F.lit(False)) | flat).drop("_kept"))


def pick_peaks(cells: DataFrame, keys: Sequence[str], thr: float, min_dist: int, top: int,
               id_col: str = "cell_id", max_rounds: int | None = None) -> DataFrame:
    """Peaks of a score map (row, col, score): at least ``thr``, best ``top`` per key, and no
    two within ``min_dist`` cells of each other on both axes."""
    from boxlake.operators.ranking import top_n

    keys, d = list(keys), max(1, int(min_dist))
    best = top_n(cells.where(F.col("score") >= thr), keys, [F.desc("score"), F.asc(id_col)], top)
    sites = best.select(*keys, F.col("col").alias("x"), F.col("row").alias("y"),
                        F.lit(d).alias("w"), F.lit(d).alias("h"),
                        F.col("score").alias("_s"), F.col(id_col).alias("_id"))

    def near(a: Box, b: Box) -> Column:
        return (F.abs(a.x - b.x) <= d) & (F.abs(a.y - b.y) <= d)

    wide = max(4 * d, 8)
    cover = cover_boxes(sites, cell=wide).withColumn("_home", F.lit(True))
    kept = _greedy_rounds(sites, cover, keys, ["_cx", "_cy"], F.lit(float(wide)), near, 16, max_rounds)
    return best.drop("rank").join(kept.select(*keys, F.col("_id").alias(id_col)), [*keys, id_col], "left_semi")


def _size_side(ratio: float) -> Column:
    """Width of the cells of grid ``_g`` of ``by_size``."""
    return F.exp((F.col("_g") + 1) * -math.log(ratio))


def by_size(boxes: DataFrame, ratio: float) -> DataFrame:
    """One row per cell of a box on the grid of its size (``_home``) and on the next larger one.

    Sizes are classes of the longer side with steps of 1 / ``ratio``; the cells of a grid are as wide as its
    largest box, so a box covers four of them at most. Sides that differ by less than one step share a grid.
    A box lies in the cells of its first 1 - ``ratio`` on each axis (and a hundredth for rounding): an IoU above
    ``ratio`` shares more than ``ratio`` of either box's sides, so those parts of the two boxes meet."""
    step, part = -math.log(ratio), 1 - ratio + 0.01
    longer = F.greatest(F.col("w").cast("double"), F.col("h").cast("double"))
    sized = (boxes.withColumn("_s0", F.floor(F.log(longer) / step)).withColumn("_g", F.explode(F.array(F.col("_s0"), F.col("_s0") + 1)))
             .withColumn("_home", F.col("_g") == F.col("_s0")).drop("_s0"))
    side, b = _size_side(ratio), Box.cols()
    return (sized.withColumn("_cx", F.explode(F.sequence(F.floor(b.x / side), F.floor((b.x + b.w * part) / side))))
            .withColumn("_cy", F.explode(F.sequence(F.floor(b.y / side), F.floor((b.y + b.h * part) / side)))))


def _greedy_rounds(nodes: DataFrame, cells: DataFrame, keys: list[str], grid: list[str], side: Column, conflict: Conflict,
                   frontier: int, max_rounds: int | None, crowd: int = CROWD) -> DataFrame:
    """Greedy independent set by (``_s`` desc, ``_id`` asc) over boxes that conflict only when they share a
    row of ``cells`` (the nodes, once per cell of ``grid``, whose width is ``side``).

    Boxes are compared once, inside cells of at most ``crowd`` live ones, and rounds run on the pairs of ids that
    conflict. While a cell holds more, rounds on the best of every cell come first: they list no pairs.
    """
    at, node = [*keys, *grid], [*keys, "_id"]
    pairs = cut(_conflicts(cells, at, keys, side, conflict, crowd))
    rounds, stayed = 0, None
    if not pairs.where(F.col("_win").isNull()).isEmpty():
        number = cells.groupBy(*node).agg(F.count("*").alias("_cells"))
        cells, stayed = cut(cells.join(dealt(number), node)), []
        while not pairs.where(F.col("_win").isNull()).isEmpty():
            rounds = _next_round(rounds, max_rounds)
            winners, cells = _frontier_round(cells, at, node, conflict, frontier)
            stayed.append(winners)
            crowded = cells.groupBy(*at).agg(F.count("*").alias("_n")).where(F.col("_n") > crowd)
            if crowded.isEmpty():
                pairs = cut(_conflicts(cells, at, keys, side, conflict, crowd))
    lost: list[DataFrame] = []
    while not pairs.isEmpty():
        rounds = _next_round(rounds, max_rounds)
        firm = (pairs.select(*keys, F.col("_win").alias("_id")).join(dealt(pairs.select(*node)), node, "left_anti")
                .distinct().withColumnRenamed("_id", "_win"))
        gone = cut(pairs.join(dealt(firm), [*keys, "_win"], "left_semi").select(*node).distinct())
        lost.append(gone)
        pairs = cut(pairs.join(dealt(gone), node, "left_anti")
                    .join(dealt(gone.withColumnRenamed("_id", "_win")), [*keys, "_win"], "left_anti"))
    live = nodes.select(*node) if stayed is None else cells.select(*node).distinct()
    if lost:
        live = live.join(dealt(reduce(DataFrame.unionByName, lost)), node, "left_anti")
    return live if stayed is None else reduce(DataFrame.unionByName, [w.select(*node) for w in stayed], live)


def _next_round(rounds: int, max_rounds: int | None) -> int:
    if max_rounds is not None and rounds >= max_rounds:
        raise RuntimeError(f"suppression did not finish in {max_rounds} rounds")
    return rounds + 1


def _conflicts(cells: DataFrame, at: list[str], keys: list[str], side: Column, conflict: Conflict, crowd: int) -> DataFrame:
    """Conflicting pairs: ``_win`` comes before ``_id`` in greedy order. A cell of more than ``crowd`` boxes gives one
    row with neither instead.

    A pair counts in the cell that holds the larger left and upper edge, on the grid where one of the two is
    at home, so it comes once."""
    whole = Window.partitionBy(*at)
    me = Box.cols()

    def beats(p: Column) -> Column:
        b = Box.of(p)
        corner = (F.floor(F.greatest(b.x, me.x) / side) == F.col("_cx")) & (F.floor(F.greatest(b.y, me.y) / side) == F.col("_cy"))
        before = ((p["_s"] > F.col("_s")) | (p["_s"].isNotNull() & F.col("_s").isNull())
                  | (p["_s"].eqNullSafe(F.col("_s")) & (p["_id"] < F.col("_id"))))
        return before & (p["_home"] | F.col("_home")) & corner & conflict(b, me)

    few = F.when(F.col("_n") <= crowd, F.struct(*GEO, "_s", "_id", "_home"))
    seen = (cells.withColumn("_n", F.count("*").over(whole)).withColumn("_first", F.min("_id").over(whole) == F.col("_id"))
            .withColumn("_peers", F.collect_list(few).over(whole)))
    wins = F.transform(F.filter("_peers", beats), lambda p: p["_id"])
    mark = F.when(F.col("_first"), F.array(F.lit(None).cast(cells.schema["_id"].dataType)))
    return (seen.withColumn("_win", F.explode(F.when(F.col("_n") <= crowd, wins).otherwise(mark)))
            .select(*keys, "_win", F.when(F.col("_win").isNotNull(), F.col("_id")).alias("_id")))


def _frontier_round(cells: DataFrame, at: list[str], node: list[str], conflict: Conflict, frontier: int) -> tuple[DataFrame, DataFrame]:
    """Boxes that stay, and the cells of the boxes still open.

    A round looks at the best ``frontier`` live boxes of every cell. A box seen in all its
    cells, with no better live conflicting box there, is final: every better neighbour of it
    shares a cell and ranks before it in that cell. Kept boxes then remove their conflicts,
    which costs at most ``frontier`` comparisons per live row and cell, never all pairs. The
    best live box always qualifies, so each round makes progress; the order of decisions does
    not change the outcome.
    """
    per_cell = Window.partitionBy(*at).orderBy(F.desc("_s"), F.asc("_id"))
    top = cells.withColumn("_r", F.row_number().over(per_cell)).where(F.col("_r") <= frontier)
    peers = F.collect_list(F.struct("_r", *GEO)).over(Window.partitionBy(*at))
    me = Box.cols()
    beaten = F.exists("_peers", lambda p: (p["_r"] < F.col("_r")) & conflict(Box.of(p), me))
    seen = top.withColumn("_peers", peers).select(*at, *GEO, "_s", "_id", "_cells", beaten.alias("_beaten"))
    winners = cut(seen.groupBy(*node, *GEO, "_s", "_cells")
                  .agg(F.count("*").alias("_n"), F.bool_or("_beaten").alias("_lost"))
                  .where(~F.col("_lost") & (F.col("_n") == F.col("_cells")))
                  .select(*node, *GEO, "_s"))
    marks = cells.join(winners.select(*node), node, "left_semi").select(
        *at, *[F.col(c).alias("k_" + c) for c in [*GEO, "_id"]])
    gone = (cells.join(marks, at)
            .where((F.col("_id") == F.col("k__id")) | conflict(Box.cols(), Box.cols("k_")))
            .select(*node).distinct())
    return winners, cut(cells.join(gone, node, "left_anti"))


# --- one-to-one matching -------------------------------------------------------------


def match_one_to_one(pred: DataFrame, gt: DataFrame, keys: Sequence[str], thr: float = 0.5,
                     pred_id: str = "pred_id", gt_id: str = "gt_id", cell: float = CELL,
                     max_rounds: int | None = None, gt_keys: Sequence[str] | None = None,
                     pred_classes: DataFrame | None = None) -> DataFrame:
    """Greedy matching over pairs with IoU >= ``thr`` in the order (iou, pred, gt) descending.

    Returns (keys, pred_id, gt_id, iou). A round takes every pair that is first for both of
    its sides; taking it now or in sequence gives the same set. Identical boxes form a class
    with a count, and a class pair that is strictly best for both sides is used up at once:
    its members pair off in id order. ``gt_keys`` names the keys the ground truth has when it
    is shared by several detectors; it is then matched once per detector without being copied.
    ``pred_classes`` is ``box_classes(pred)`` when the caller has it already.
    """
    keys = list(keys)
    gt_keys = list(gt_keys or keys)
    extra = [k for k in keys if k not in gt_keys]
    pc = pred_classes if pred_classes is not None else box_classes(pred, keys, pred_id)
    gc = _classes(gt, gt_keys, gt_id, "g")
    base = iou_pairs(pc, gc, gt_keys, thr, cell).withColumnsRenamed({f"a_{k}": k for k in extra})
    edges = cut(base.select(
        *keys, "iou",
        *[F.col(f"a_{c}").alias(c) for c in ("pc", "pn", "ptop")], F.lit(0).cast("bigint").alias("pused"),
        *[F.col(f"b_{c}").alias(c) for c in ("gc", "gn", "gtop")], F.lit(0).cast("bigint").alias("gused")))
    multi = edges.agg(F.max((F.col("pn") > 1).cast("int")).alias("p"), F.max((F.col("gn") > 1).cast("int")).alias("g"),
                      F.count("*").alias("n")).first()
    p_ranks = _member_ranks(pred, pc, keys, pred_id, "p") if multi.p else None
    g_ranks = _member_ranks(gt, gc, gt_keys, gt_id, "g") if multi.g else None

    batch = bool(multi.p or multi.g)
    parts: list[DataFrame] = []
    rounds = 0
    while not edges.isEmpty():
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError(f"matching did not finish in {max_rounds} rounds")
        marked = cut(_mark_round(edges, keys, batch))
        taken = marked.where(F.col("take") > 0).select(*keys, "iou", "pc", "gc", "pused", "gused", "take")
        tied = marked.where(F.col("tie").isNotNull()) if batch else None
        if tied is not None and not tied.isEmpty():
            taken = cut(taken.unionByName(_zip_ties(tied, keys, gt_keys, p_ranks, g_ranks)))
        parts.append(taken)
        edges = cut(_advance(marked, taken, keys, gt_keys, p_ranks, g_ranks))
    if not parts:
        none = pred.sparkSession.createDataFrame([], gt.select(gt_id).schema)
        return pred.select(*keys, pred_id).limit(0).join(none, F.col(pred_id) == F.col(gt_id)).select(
            *keys, pred_id, gt_id, F.lit(0.0).alias("iou"))
    return _expand(reduce(DataFrame.unionByName, parts), keys, gt_keys, pred_id, gt_id, p_ranks, g_ranks)


def box_classes(pred: DataFrame, keys: Sequence[str], pred_id: str = "pred_id") -> DataFrame:
    """Distinct predicted boxes per key with their member count."""
    return _classes(pred, list(keys), pred_id, "p")


def _classes(df: DataFrame, keys: list[str], id_col: str, s: str) -> DataFrame:
    """One row per distinct box: class id = largest member id, member count."""
    return df.groupBy(*keys, *GEO).agg(
        F.max(id_col).alias(f"{s}c"), F.count("*").alias(f"{s}n"), F.max(id_col).alias(f"{s}top"))


def _member_ranks(df: DataFrame, classes: DataFrame, keys: list[str], id_col: str, s: str) -> DataFrame:
    """0-based position of each member in its class, largest id first."""
    many = df.join(dealt(classes.where(F.col(f"{s}n") > 1).select(*keys, *GEO, f"{s}c")), [*keys, *GEO])
    r = exact_rank(many.select(*keys, f"{s}c", id_col), [*keys, f"{s}c"], [F.desc(id_col)])
    return cut(r.select(*keys, f"{s}c", F.col(id_col).alias(f"{s}id"), (F.col("rank") - 1).alias(f"{s}rank")))


def _mark_round(edges: DataFrame, keys: list[str], batch: bool) -> DataFrame:
    """Add ``take``: how many members of the pair are matched in this round, and (``batch``) ``tie``.

    Edges that are best for both their classes by IoU form tie groups. Where every class of a group meets the
    same classes, its members on both sides pair off in id order whatever class they are in: such edges get
    the group as ``tie`` and leave ``take`` at 0."""
    best_p = edges.groupBy(*keys, "pc").agg(F.max(F.struct("iou", "gtop")).alias("bp"))
    best_g = edges.groupBy(*keys, "gc").agg(F.max(F.struct("iou", "ptop")).alias("bg"))
    e = edges.join(dealt(best_p), [*keys, "pc"]).join(dealt(best_g), [*keys, "gc"])
    mutual = (F.struct("iou", "gtop") == F.col("bp")) & (F.struct("iou", "ptop") == F.col("bg"))
    left = F.least(F.col("pn") - F.col("pused"), F.col("gn") - F.col("gused"))
    if not batch:
        return e.withColumn("take", F.when(mutual, F.lit(1)).otherwise(F.lit(0)).cast("bigint")).drop("bp", "bg")
    top = e.where((F.col("iou") == F.col("bp.iou")) | (F.col("iou") == F.col("bg.iou")))
    both = (F.col("iou") == F.col("bp.iou")) & (F.col("iou") == F.col("bg.iou"))
    mark = lambda c: F.xxhash64(c).cast("decimal(38,0)")
    of_p = (top.where(F.col("iou") == F.col("bp.iou")).groupBy(*keys, "pc")
            .agg(F.count("*").alias("tp"), F.bool_and(both).alias("whole_p"), F.sum(mark("gc")).alias("sp")))
    of_g = (top.where(F.col("iou") == F.col("bg.iou")).groupBy(*keys, "gc")
            .agg(F.count("*").alias("tg"), F.bool_and(both).alias("whole_g"), F.sum(mark("pc")).alias("sg")))
    t = cut(top.join(dealt(of_p), [*keys, "pc"]).join(dealt(of_g), [*keys, "gc"]).where(both))
    same_p = t.groupBy(*keys, "gc").agg((F.min("sp") == F.max("sp")).alias("one_p"), F.bool_and("whole_p").alias("ok_p"))
    same_g = t.groupBy(*keys, "pc").agg((F.min("sg") == F.max("sg")).alias("one_g"), F.bool_and("whole_g").alias("ok_g"))
    closed = F.col("one_p") & F.col("one_g") & F.col("ok_p") & F.col("ok_g") & F.col("whole_p") & F.col("whole_g")
    groups = (t.join(dealt(same_p), [*keys, "gc"]).join(dealt(same_g), [*keys, "pc"])
              .select(*keys, "pc", "gc", ((F.col("tp") == 1) & (F.col("tg") == 1)).alias("alone"),
                      F.when(closed & ((F.col("tp") > 1) | (F.col("tg") > 1)), F.struct("sp", "sg")).alias("tie")))
    m = e.withColumn("mutual", mutual).join(dealt(groups), [*keys, "pc", "gc"], "left")
    take = F.when(~F.col("mutual") | F.col("tie").isNotNull(), F.lit(0)).when(F.col("alone"), left).otherwise(F.lit(1)).cast("bigint")
    return m.withColumn("take", take).drop("bp", "bg", "mutual", "alone")


def _zip_ties(tied: DataFrame, keys: list[str], gt_keys: list[str], p_ranks: DataFrame | None, g_ranks: DataFrame | None) -> DataFrame:
    """Members of closed tie groups, paired by their place in id order; one row per pair with ``take`` 1."""
    at = [*keys, "iou", "tie"]

    def line_up(s: str, ranks: DataFrame | None, own: list[str]) -> DataFrame:
        c, used = f"{s}c", f"{s}used"
        classes = tied.select(*at, c, used, f"{s}n").distinct()
        if ranks is None:
            rows = classes.select(*at, c, F.col(c).alias("id"), F.col(used).alias("pos"))
        else:
            r = ranks.select(*own, c, F.col(f"{s}id").alias("_m"), F.col(f"{s}rank").alias("_r"))
            rows = (classes.join(r, [*own, c], "left").where(F.col("_r").isNull() | (F.col("_r") >= F.col(used)))
                    .select(*at, c, F.coalesce("_m", c).alias("id"), F.coalesce("_r", used).alias("pos")))
        flat = rows.select(*keys, "iou", F.xxhash64("tie").alias("tie"), c, F.col("pos").alias(used), "id")
        return exact_rank(flat, [*keys, "iou", "tie"], [F.desc("id")], "place").drop("id")

    p, g = line_up("p", p_ranks, keys), line_up("g", g_ranks, gt_keys)
    return p.join(g, [*keys, "iou", "tie", "place"]).select(*keys, "iou", "pc", "gc", "pused", "gused", F.lit(1).cast("bigint").alias("take"))


def _advance(marked: DataFrame, taken: DataFrame, keys: list[str], gt_keys: list[str],
             p_ranks: DataFrame | None, g_ranks: DataFrame | None) -> DataFrame:
    """Edges of the classes that still have members, with their new first members."""
    e = marked.drop("take", "tie")
    for s, ranks, own in (("p", p_ranks, keys), ("g", g_ranks, gt_keys)):
        used = taken.groupBy(*keys, f"{s}c").agg(F.sum("take").alias("_t"))
        if ranks is None:
            e = e.join(dealt(used), [*keys, f"{s}c"], "left_anti")
            continue
        e = (e.join(dealt(used), [*keys, f"{s}c"], "left")
             .withColumn(f"{s}used", F.col(f"{s}used") + F.coalesce("_t", F.lit(0))).drop("_t")
             .where(F.col(f"{s}used") < F.col(f"{s}n")))
        head = ranks.select(*own, f"{s}c", F.col(f"{s}rank").alias(f"{s}used"), F.col(f"{s}id").alias("_top"))
        e = (e.join(dealt(head), [*own, f"{s}c", f"{s}used"], "left")
             .withColumn(f"{s}top", F.coalesce("_top", F.col(f"{s}c"))).drop("_top"))
    return e


def _expand(m: DataFrame, keys: list[str], gt_keys: list[str], pred_id: str, gt_id: str,
            p_ranks: DataFrame | None, g_ranks: DataFrame | None) -> DataFrame:
    """Class matches back to member pairs by position."""
    if p_ranks is None:
        m = m.withColumn("_pid", F.col("pc")).withColumn("_shift", F.lit(0).cast("bigint"))
    else:
        r = p_ranks.withColumnRenamed("pid", "_m").withColumnRenamed("prank", "_r")
        inside = F.col("_r").isNull() | ((F.col("_r") >= F.col("pused")) & (F.col("_r") < F.col("pused") + F.col("take")))
        m = (m.join(dealt(r), [*keys, "pc"], "left").where(inside)
             .withColumn("_pid", F.coalesce("_m", "pc"))
             .withColumn("_shift", F.coalesce(F.col("_r") - F.col("pused"), F.lit(0))).drop("_m", "_r"))
    m = m.withColumn("_gr", F.col("gused") + F.col("_shift"))
    if g_ranks is None:
        m = m.withColumn("_gid", F.col("gc"))
    else:
        r = g_ranks.select(*gt_keys, "gc", F.col("grank").alias("_gr"), F.col("gid").alias("_m"))
        m = m.join(dealt(r), [*gt_keys, "gc", "_gr"], "left").withColumn("_gid", F.coalesce("_m", "gc"))
    return m.select(*keys, F.col("_pid").alias(pred_id), F.col("_gid").alias(gt_id), "iou")
