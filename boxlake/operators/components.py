"""Connected components of ink, on horizontal runs instead of pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxlake.operators.spatial import CELL
from boxlake.session import cut


def ink_runs(ink: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maximal horizontal runs (y, xa, xb) of ink pixels; a window holds one image row at most."""
    keys = list(keys)
    row = Window.partitionBy(*keys, "y").orderBy("x")
    return (ink.withColumn("_g", F.col("x") - F.row_number().over(row))
            .groupBy(*keys, "y", "_g").agg(F.min("x").alias("xa"), F.max("x").alias("xb")).drop("_g")
            .withColumn("run", F.struct("y", "xa")))


def run_edges(runs: DataFrame, keys: Sequence[str], cell: int = CELL) -> DataFrame:
    """Runs of neighbouring rows that touch, corners included (8-neighbourhood)."""
    keys = list(keys)
    up = runs.select(*keys, (F.col("y") + 1).alias("_y"), F.col("run").alias("a"),
                     (F.col("xa") - 1).alias("a0"), (F.col("xb") + 1).alias("a1"))
    dn = runs.select(*keys, F.col("y").alias("_y"), F.col("run").alias("b"), F.col("xa").alias("b0"), F.col("xb").alias("b1"))

    def bucket(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.withColumn("_c", F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))))

    touch = (F.col("a0") <= F.col("b1")) & (F.col("b0") <= F.col("a1"))
    own = F.floor(F.greatest("a0", "b0") / cell) == F.col("_c")
    return (bucket(up, "a0", "a1").join(bucket(dn, "b0", "b1"), [*keys, "_y", "_c"])
            .where(touch & own).select(*keys, "a", "b"))


def connected(nodes: DataFrame, edges: DataFrame, keys: Sequence[str], node: str = "run") -> DataFrame:
    """Smallest node of each node's component as ``root``.

    Alternates two star steps on the edge list: hang larger neighbours on the smallest
    neighbour, then smaller ones. Every step is a grouped minimum (combined before the
    shuffle) and a join against one row per node, so a hub never gathers its neighbours.
    """
    keys = list(keys)
    e = cut(edges.select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            .where(F.col("u") != F.col("v")).distinct())
    last = None
    while True:
        both = e.unionByName(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        large = (both.join(low, [*keys, "u"]).where(F.col("v") > F.col("u"))
                 .select(*keys, F.col("v").alias("u"), F.least("m", "u").alias("v")))
        large = large.where(F.col("u") != F.col("v")).distinct()
        low2 = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        hang = (large.join(low2, [*keys, "u"]).where(F.col("v") != F.col("m"))
                .select(*keys, F.col("v").alias("u"), F.col("m").alias("v")))
        e = cut(low2.withColumnRenamed("m", "v").unionByName(hang).distinct())
        mark = e.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    return (nodes.join(e.select(*keys, F.col("u").alias(node), F.col("v").alias("root")), [*keys, node], "left")
            .withColumn("root", F.coalesce("root", node)))


def label_ink(ink: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of each image with their component root (the topmost, leftmost run)."""
    runs = cut(ink_runs(ink, keys))
    return connected(runs, run_edges(runs, keys), keys)


def component_boxes(labelled_runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Box, pixel count and root of each component."""
    return (labelled_runs.groupBy(*keys, "root")
            .agg(F.min("xa").alias("x"), F.min("y").alias("y"),
                 (F.max("xb") - F.min("xa") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"),
                 F.sum(F.col("xb") - F.col("xa") + 1).alias("pixels"))
            .select(*keys, F.col("root.y").alias("root_y"), F.col("root.xa").alias("root_x"), "x", "y", "w", "h", "pixels"))


def sizeable(components: DataFrame, image_width: str = "width") -> DataFrame:
    """Drop specks below 2 px and components wider than 98% of the image."""
    return components.where((F.col("w") >= 2) & (F.col("h") >= 2) & (F.col("w") <= F.col(image_width) * 0.98))


def compact(components: DataFrame, crop_w: int, crop_h: int, max_symbol: int = 48, span: float = 0.92,
            max_aspect: float = 6.0, min_area: int = 4) -> DataFrame:
    """Glyph-like components: not too big, not spanning the crop, not a sliver, not a speck."""
    w, h = F.col("w"), F.col("h")
    return components.where(
        (w <= max_symbol) & (h <= max_symbol) & (w <= span * crop_w) & (h <= span * crop_h)
        & (F.greatest(w, h) <= max_aspect * F.least(w, h)) & (F.col("pixels") >= min_area))


def grow_from_seeds(components: DataFrame, points: DataFrame, keys: Sequence[str], search: int = 16,
                    gap: int = 1, max_symbol: int = 48) -> DataFrame:
    """One box per point: seed on the component under (or nearest to) the point, then join
    components within ``gap`` px of the grown box that lie inside the point's window.

    Growth is a loop of joins between grown boxes and nearby components; each round extends
    every open point at once and the loop ends when no box changes, which the window bounds.
    """
    from boxlake.functions.geometry import Box
    from boxlake.operators.spatial import cover, cover_boxes

    keys = list(keys)
    comp = cut(components.select(*keys, "root_y", "root_x", "x", "y", "w", "h", "pixels"))
    px, py = F.col("px"), F.col("py")
    pts = points.select(*keys, "pt_idx", F.col("x").alias("px"), F.col("y").alias("py"))
    near = cover(pts, px - search, py - search, px + search, py + search)
    dx = F.greatest(F.col("x") - px, px - (F.col("x") + F.col("w") - 1), F.lit(0))
    dy = F.greatest(F.col("y") - py, py - (F.col("y") + F.col("h") - 1), F.lit(0))
    d2 = dx * dx + dy * dy
    own = [*keys, "pt_idx"]
    seed = (near.join(cover_boxes(comp), [*keys, "_cx", "_cy"]).where(d2 <= search * search)
            .groupBy(*own, "px", "py")
            .agg(F.min_by(F.struct("x", "y", "w", "h"), F.struct(d2, F.col("root_y"), F.col("root_x"))).alias("b"))
            .select(*own, "px", "py", "b.*"))
    grown = cut(seed)
    b = Box.cols("b_")
    inside = ((b.x >= px - max_symbol) & (b.y >= py - max_symbol)
              & (b.x1 - 1 <= px + max_symbol) & (b.y1 - 1 <= py + max_symbol))
    parts = cover_boxes(comp.select(*keys, *[F.col(c).alias("b_" + c) for c in "xywh"]), "b_")
    while True:
        a = Box.cols()
        close = (b.x <= a.x1 + gap) & (a.x <= b.x1 + gap) & (b.y <= a.y1 + gap) & (a.y <= b.y1 + gap)
        reach = cover(grown, a.x - gap, a.y - gap, a.x1 + gap, a.y1 + gap)
        add = (reach.join(parts, [*keys, "_cx", "_cy"]).where(close & inside).groupBy(*own)
               .agg(F.min("b_x").alias("nx0"), F.min("b_y").alias("ny0"), F.max(b.x1).alias("nx1"), F.max(b.y1).alias("ny1")))
        x0, y0 = F.least("x", "nx0"), F.least("y", "ny0")
        x1, y1 = F.greatest(a.x1, F.col("nx1")), F.greatest(a.y1, F.col("ny1"))
        nxt = cut(grown.join(add, own, "left").select(
            *own, "px", "py", x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"),
            ((x0 != F.col("x")) | (y0 != F.col("y")) | (x1 != a.x1) | (y1 != a.y1)).alias("_moved")))
        moved = not nxt.where("_moved").isEmpty()
        grown = nxt.drop("_moved")
        if not moved:
            return grown
