"""Pixel rows (img, y, x, v): profiles, jumps, histograms, masks, legend layout.

Windows here run along one image row, one profile or one 256-bin histogram; their size is
bounded by the image side, never by the number of images or pixels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.operators.spatial import CELL


def gray(r: Column, g: Column, b: Column) -> Column:
    return (r + g + b) / 3.0


def binarize(v: Column, threshold: float = 127) -> Column:
    return F.when(v > threshold, 255).otherwise(0)


def black_profiles(binary: DataFrame, img: Sequence[str] = ("img",), v: str = "v") -> DataFrame:
    """Black pixels per image row and column: (img, axis, pos, n), one scan for both."""
    img = list(img)
    g = binary.groupingSets([[*img, "y"], [*img, "x"]], *img, "y", "x").agg(F.count_if(F.col(v) == 0).alias("n"))
    return g.select(*img, F.when(F.col("y").isNotNull(), "row").otherwise("col").alias("axis"),
                    F.coalesce("y", "x").alias("pos"), "n")


def dense_profiles(profiles: DataFrame, img: Sequence[str] = ("img",)) -> DataFrame:
    """Profiles with every position from 0 to the last one; absent positions count 0."""
    img = list(img)
    spine = (profiles.groupBy(*img, "axis").agg(F.max("pos").alias("_m"))
             .select(*img, "axis", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_m").cast("bigint"))).alias("pos")))
    return spine.join(profiles.withColumn("pos", F.col("pos").cast("bigint")), [*img, "axis", "pos"], "left").fillna(0, ["n"])


def find_jumps(dense: DataFrame, row_pct: float = 93.9, col_pct: float = 99.2,
               img: Sequence[str] = ("img",)) -> DataFrame:
    """Positions whose step to the next exceeds the axis percentile of its image, strictly."""
    img = list(img)
    w = Window.partitionBy(*img, "axis").orderBy("pos")
    d = dense.withColumn("step", F.abs(F.lead("n").over(w) - F.col("n"))).where(F.col("step").isNotNull())
    lim = d.groupBy(*img, "axis").agg(F.percentile("step", F.lit(row_pct / 100)).alias("_r"),
                                      F.percentile("step", F.lit(col_pct / 100)).alias("_c"))
    limit = F.when(F.col("axis") == "row", F.col("_r")).otherwise(F.col("_c"))
    return d.join(lim, [*img, "axis"]).where(F.col("step") > limit).select(*img, "axis", "pos", "step")


def split_column(jumps: DataFrame, sizes: DataFrame, min_gap: int = 25, fallback: float = 0.22,
                 img: Sequence[str] = ("img",)) -> DataFrame:
    """Right edge of the first wide gap between column jumps, else a fixed share of the width."""
    img = list(img)
    w = Window.partitionBy(*img).orderBy("pos")
    c = jumps.where(F.col("axis") == "col").withColumn("_prev", F.lag("pos").over(w))
    first = c.where(F.col("pos") - F.col("_prev") > min_gap).groupBy(*img).agg(F.min("pos").alias("_s"))
    return sizes.join(first, img, "left").select(
        *img, "width", F.coalesce(F.col("_s"), (F.col("width") * fallback).cast("bigint")).cast("bigint").alias("split_x"))


def otsu(pixels: DataFrame, img: Sequence[str] = ("img",), v: str = "v") -> DataFrame:
    """Otsu threshold per image: first gray level with the largest between-class variance."""
    img = list(img)
    h = pixels.groupBy(*img, F.col(v).cast("int").alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*img).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*img)
    c = h.select(*img, "v", F.sum("n").over(w).alias("n1"), F.sum(F.col("n") * F.col("v")).over(w).alias("s1"),
                 F.sum("n").over(whole).alias("n_all"), F.sum(F.col("n") * F.col("v")).over(whole).alias("s_all"))
    q1 = F.col("n1") / F.col("n_all")
    gap = F.col("s1") / F.col("n1") - (F.col("s_all") - F.col("s1")) / (F.col("n_all") - F.col("n1"))
    var = F.when(F.col("n1") < F.col("n_all"), q1 * (1 - q1) * gap * gap).otherwise(F.lit(0.0))
    return (c.withColumn("var", var).groupBy(*img)
            .agg(F.max_by("v", F.struct("var", -F.col("v"))).alias("_t"), F.max("var").alias("var"))
            .select(*img, F.when(F.col("var") > 0, F.col("_t")).otherwise(F.lit(0)).alias("threshold"), "var"))


def ink(pixels: DataFrame, thresholds: DataFrame, img: Sequence[str] = ("img",), v: str = "v") -> DataFrame:
    """Dark pixels: value at or below their image's threshold."""
    return pixels.join(thresholds.select(*img, "threshold"), list(img)).where(F.col(v) <= F.col("threshold")).drop("threshold")


def mask_stats(mask_pixels: DataFrame, mask: Sequence[str]) -> DataFrame:
    """Extent, pixel count and centroid per mask."""
    return mask_pixels.groupBy(*mask).agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"),
        F.count("*").alias("pixels"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def mask_features(stats: DataFrame, conf: Column, crop_w: Column, crop_h: Column) -> DataFrame:
    """conf, box share of the crop, squareness, fill; zeros for an empty mask."""
    w, h = F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1
    area = F.greatest(F.lit(1), w * h)
    empty = F.coalesce("pixels", F.lit(0)) == 0

    def feat(c: Column) -> Column:
        return F.when(empty, F.lit(0.0)).otherwise(c)

    return stats.select("*", conf.cast("double").alias("conf"),
                        feat(area / F.greatest(F.lit(1), crop_w * crop_h)).alias("norm_area"),
                        feat(F.least(w, h) / F.greatest(w, h)).alias("aspect"),
                        feat(F.col("pixels") / area).alias("extent"))


def ink_in_masks(mask_runs: DataFrame, ink_runs: DataFrame, min_pixels: int, min_fill: float,
                 img: Sequence[str] = ("img",), cell: int = CELL) -> DataFrame:
    """Ink pixels inside each mask; masks with too little or too sparse ink drop out.

    Both sides are runs (y, xa, xb); they meet on (img, y, x cell) and count overlap lengths.
    """
    img = list(img)
    box = mask_runs.groupBy(*img, "mask_id").agg(
        F.min("xa").alias("x"), F.min("y").alias("y"), (F.max("xb") - F.min("xa") + 1).alias("w"),
        (F.max("y") - F.min("y") + 1).alias("h"))

    def bucket(df: DataFrame, p: str) -> DataFrame:
        return (df.select(*img, "y", *([F.col("mask_id")] if p == "m" else []), F.col("xa").alias(f"{p}a"), F.col("xb").alias(f"{p}b"))
                .withColumn("_c", F.explode(F.sequence(F.floor(F.col(f"{p}a") / cell), F.floor(F.col(f"{p}b") / cell)))))

    lo, hi = F.greatest("ma", "ia"), F.least("mb", "ib")
    hit = (bucket(mask_runs, "m").join(bucket(ink_runs, "i"), [*img, "y", "_c"])
           .where((lo <= hi) & (F.floor(lo / cell) == F.col("_c")))
           .groupBy(*img, "mask_id").agg(F.sum(hi - lo + 1).alias("ink")))
    return (box.join(hit, [*img, "mask_id"])
            .where((F.col("ink") >= min_pixels) & (F.col("ink") / F.greatest(F.lit(1), F.col("w") * F.col("h")) >= min_fill)))


# --- legend layout -------------------------------------------------------------------


def group_rows(components: DataFrame, tolerance: float = 14, img: Sequence[str] = ("img",)) -> DataFrame:
    """Components with ``row``: walking down by centre, one joins the current row while it is
    less than ``tolerance`` from the row's running mean, else it opens the next row.

    The walk depends on order, so it is a fold, but only over distinct centre heights with
    counts (equal heights always share a row): at most twice the image height per image. A
    gap of ``tolerance`` always opens a row, so the fold runs per gap-free stretch.
    """
    img = list(img)
    c = components.withColumn("cy", F.col("y") + F.col("h") / 2.0)
    heights = c.groupBy(*img, "cy").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*img).orderBy("cy")
    gap = F.col("cy") - F.lag("cy").over(w)
    stretch = F.sum(F.when(gap >= tolerance, 1).otherwise(0)).over(w)
    s = heights.withColumn("_s", stretch).groupBy(*img, "_s").agg(
        F.array_sort(F.collect_list(F.struct("cy", "n"))).alias("_a"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("row"),
                     F.array().cast("array<struct<cy:double,row:int>>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        joins = (acc["n"] > 0) & (F.abs(e["cy"] - acc["sum"] / acc["n"]) < tolerance)
        row = F.when(joins | (acc["n"] == 0), acc["row"]).otherwise(acc["row"] + 1)
        total, n = e["cy"] * e["n"], e["n"]
        return F.struct(F.when(joins, acc["sum"] + total).otherwise(total).alias("sum"),
                        F.when(joins, acc["n"] + n).otherwise(n).alias("n"), row.alias("row"),
                        F.concat(acc["out"], F.array(F.struct(e["cy"].alias("cy"), row.alias("row")))).alias("out"))

    placed = s.select(*img, "_s", F.explode(F.aggregate("_a", start, step)["out"]).alias("_o"))
    order = Window.partitionBy(*img).orderBy("_s", "_o.row")
    rows = placed.select(*img, F.col("_o.cy").alias("cy"), (F.dense_rank().over(order) - 1).cast("bigint").alias("row"))
    return c.join(rows, [*img, "cy"])


def shrink_wrap(boxes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Smallest box around all boxes of a group."""
    x, y = F.min("x"), F.min("y")
    return boxes.groupBy(*by).agg(x.alias("x"), y.alias("y"), (F.max(F.col("x") + F.col("w")) - x).alias("w"),
                                  (F.max(F.col("y") + F.col("h")) - y).alias("h"))


def legend(rows: DataFrame, splits: DataFrame, texts: DataFrame, img: Sequence[str] = ("img",)) -> DataFrame:
    """Two-column legend: per row the symbol box, the text box and its key.

    A row without text gets a numbered header key; a later row with the same key replaces an
    earlier one. ``texts`` has (img, row, text) for recognised text boxes.
    """
    from boxlake.functions.text import collapse_space

    img = list(img)
    side = F.when(F.col("x") + F.col("w") / 2.0 < F.col("split_x"), 0).otherwise(1)
    cols = rows.join(splits.select(*img, "split_x"), img).withColumn("col", side)
    x, y = F.min("x"), F.min("y")
    box = F.struct(x.alias("x"), y.alias("y"), (F.max(F.col("x") + F.col("w")) - x).alias("w"),
                   (F.max(F.col("y") + F.col("h")) - y).alias("h"))
    wide = (cols.groupBy(*img, "row").pivot("col", [0, 1]).agg(box)
            .withColumn("symbol_box", F.when(F.col("0.x").isNotNull(), F.col("0")))
            .withColumn("text_box", F.when(F.col("1.x").isNotNull(), F.col("1"))).drop("0", "1")
            .join(texts, [*img, "row"], "left"))
    text = F.when(F.col("text_box").isNotNull(), collapse_space(F.coalesce("text", F.lit(""))))
    key = F.coalesce(F.nullif(text, F.lit("")), F.concat(F.lit("Header_or_Section_Row_"), F.col("row").cast("string")))
    return (wide.withColumn("key", key).groupBy(*img, "key")
            .agg(F.max_by(F.struct("row", "symbol_box", "text_box"), "row").alias("_v")).select(*img, "key", "_v.*"))
