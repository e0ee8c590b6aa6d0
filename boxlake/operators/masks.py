"""Pixel masks as a column: the runs of each row, with set algebra, measures and a stored form.

A mask is ``struct<y0, rows>``: the first row and, per row from there on, its maximal runs ``[xa, xb]`` from left to
right, both ends included. Rows at both ends hold runs; a mask without pixels has no rows. Every operation works row
by row on built-in functions, so it costs the rows of the masks and, per row, the product of the two run counts, which
are few; pixels are never listed. One mask is one value, so it has to fit a task: masks are shapes inside one image.

Unions over groups of masks (``union_by``) work on run tables instead and never gather a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.operators.spatial import CELL

RUN = "struct<xa:int,xb:int>"
TYPE = f"struct<y0:int,rows:array<array<{RUN}>>>"


def _let(value: Column, body) -> Column:
    """``body(v)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _run(xa: Column, xb: Column) -> Column:
    return F.struct(xa.cast("int").alias("xa"), xb.cast("int").alias("xb"))


def _no_runs() -> Column:
    return F.array().cast(f"array<{RUN}>")


def mask(y0: Column, rows: Column) -> Column:
    """A mask in normal form: empty rows at both ends are cut off."""
    none = F.struct(F.lit(0).alias("y0"), F.array().cast(f"array<array<{RUN}>>").alias("rows"))

    def trim(rows: Column) -> Column:
        def between(full: Column) -> Column:
            first, last = F.array_min(full), F.array_max(full)
            return F.struct((y0 + first).cast("int").alias("y0"), F.slice(rows, first + 1, last - first + 1).alias("rows"))
        full = F.filter(F.transform(rows, lambda r, i: F.when(F.size(r) > 0, i)), lambda i: i.isNotNull())
        return _let(full, lambda f: F.when(F.size(f) > 0, between(f)).otherwise(none))

    return _let(rows, trim).cast(TYPE)


def _row(m: Column, y: Column) -> Column:
    """Runs of row ``y``; none outside the mask."""
    return F.coalesce(F.get(m["rows"], y - m["y0"]), _no_runs())


def _rowwise(a: Column, b: Column, lo: Column, hi: Column, each) -> Column:
    """The mask whose rows from lo to hi are ``each(row of a, row of b)``."""
    rows = F.when(hi >= lo, F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda y: each(_row(a, y), _row(b, y))))
    return mask(lo, F.coalesce(rows, F.array().cast(f"array<array<{RUN}>>")))


def _both(a: Column, b: Column, body) -> Column:
    return _let(F.struct(a.alias("a"), b.alias("b")), lambda s: body(s["a"], s["b"]))


def _end(m: Column) -> Column:
    return m["y0"] + F.size(m["rows"]) - 1


def is_empty(m: Column) -> Column:
    return F.size(m["rows"]) == 0


def _joined(a: Column, b: Column) -> Column:
    """Runs of both rows; such as overlap or touch become one. A left end counts unless a run that begins before it
    reaches it, and so for right ends; the n-th left end belongs to the n-th right end."""
    def islands(both: Column) -> Column:
        begins = F.filter(both, lambda r: ~F.exists(both, lambda s: (s["xa"] < r["xa"]) & (s["xb"] >= r["xa"] - 1)))
        ends = F.filter(both, lambda r: ~F.exists(both, lambda s: (s["xb"] > r["xb"]) & (s["xa"] <= r["xb"] + 1)))
        left = F.array_sort(F.array_distinct(F.transform(begins, lambda r: r["xa"])))
        right = F.array_sort(F.array_distinct(F.transform(ends, lambda r: r["xb"])))
        return F.zip_with(left, right, _run)
    return F.when(F.size(a) == 0, b).when(F.size(b) == 0, a).otherwise(_let(F.concat(a, b), islands))


def _common(a: Column, b: Column) -> Column:
    def meet(r: Column) -> Column:
        hit = F.filter(b, lambda s: (s["xa"] <= r["xb"]) & (s["xb"] >= r["xa"]))
        return F.transform(hit, lambda s: _run(F.greatest(r["xa"], s["xa"]), F.least(r["xb"], s["xb"])))
    return F.flatten(F.transform(a, meet))


def _without(a: Column, b: Column) -> Column:
    def rest(r: Column) -> Column:
        def gaps(hit: Column) -> Column:
            left = F.concat(F.array(r["xa"]), F.transform(hit, lambda s: s["xb"] + 1))
            right = F.concat(F.transform(hit, lambda s: s["xa"] - 1), F.array(r["xb"]))
            return F.filter(F.zip_with(left, right, _run), lambda s: s["xa"] <= s["xb"])
        return _let(F.filter(b, lambda s: (s["xa"] <= r["xb"]) & (s["xb"] >= r["xa"])), gaps)
    return F.flatten(F.transform(a, rest))


def union(a: Column, b: Column) -> Column:
    def whole(a: Column, b: Column) -> Column:
        both = _rowwise(a, b, F.least(a["y0"], b["y0"]), F.greatest(_end(a), _end(b)), _joined)
        return F.when(is_empty(a), b).when(is_empty(b), a).otherwise(both)
    return _both(a, b, whole)


def intersection(a: Column, b: Column) -> Column:
    return _both(a, b, lambda a, b: _rowwise(a, b, F.greatest(a["y0"], b["y0"]), F.least(_end(a), _end(b)), _common))


def difference(a: Column, b: Column) -> Column:
    """Pixels of a that are not in b."""
    return _both(a, b, lambda a, b: _rowwise(a, b, a["y0"], _end(a), _without))


def area(m: Column) -> Column:
    """Number of pixels."""
    per_row = F.transform(m["rows"], lambda r: F.aggregate(r, F.lit(0).cast("bigint"), lambda n, s: n + s["xb"] - s["xa"] + 1))
    return F.aggregate(per_row, F.lit(0).cast("bigint"), lambda n, k: n + k)


def extent(m: Column) -> Column:
    """struct(x0, y0, x1, y1) of the outermost pixels; null for an empty mask."""
    def box(m: Column) -> Column:
        ends = F.flatten(m["rows"])
        return F.when(~is_empty(m), F.struct(F.array_min(ends["xa"]).alias("x0"), m["y0"].alias("y0"),
                                             F.array_max(ends["xb"]).alias("x1"), _end(m).alias("y1")))
    return _let(m, box)


def contains(m: Column, x: Column, y: Column) -> Column:
    """Whether the pixel is in the mask."""
    return F.exists(_row(m, y.cast("int")), lambda r: (r["xa"] <= x) & (x <= r["xb"]))


def mask_iou(a: Column, b: Column) -> Column:
    """Shared pixels by all pixels of both; 0 for two empty masks."""
    def share(common: Column, a: Column, b: Column) -> Column:
        total = area(a) + area(b) - common
        return F.when(total > 0, common / total).otherwise(F.lit(0.0))
    return _both(a, b, lambda a, b: _let(area(intersection(a, b)), lambda n: share(n, a, b)))


# --- tables --------------------------------------------------------------------------


def pack(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, mask) from runs (keys, y, xa, xb) that are maximal and apart, as ``ink_runs`` gives them."""
    keys = list(keys)
    rows = runs.groupBy(*keys, "y").agg(F.array_sort(F.collect_list(_run(F.col("xa"), F.col("xb")))).alias("r"))
    got = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("y").cast("int").alias("y"), "r"))).alias("_m"),
                                  F.min("y").cast("int").alias("_lo"), F.max("y").cast("int").alias("_hi"))
    all_rows = F.transform(F.sequence("_lo", "_hi"), lambda y: F.coalesce(F.element_at("_m", y), _no_runs()))
    return got.select(*keys, mask(F.col("_lo"), all_rows).alias("mask"))


def unpack(masks: DataFrame, keys: Sequence[str], col: str = "mask") -> DataFrame:
    """Runs (keys, y, xa, xb) of masks; the stored form. An empty mask has none."""
    rows = masks.select(*keys, F.col(col)["y0"].alias("_y0"), F.posexplode(F.col(col)["rows"]).alias("_i", "_r"))
    return rows.select(*keys, (F.col("_y0") + F.col("_i")).alias("y"), F.explode("_r").alias("_s")).select(*keys, "y", "_s.xa", "_s.xb")


def union_by(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of all runs of each key as maximal runs. A window holds one image row of one key and is read as a
    stream: a run opens a new one when all before it end left of it."""
    keys = list(keys)
    row = Window.partitionBy(*keys, "y").orderBy("xa", "xb")
    before = F.max("xb").over(row.rowsBetween(Window.unboundedPreceding, -1))
    new = runs.select(*keys, "y", "xa", "xb", F.when(F.col("xa") <= before + 1, 0).otherwise(1).alias("_new"))
    numbered = new.withColumn("_n", F.sum("_new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "y", "_n").agg(F.min("xa").alias("xa"), F.max("xb").alias("xb")).drop("_n")


def covering_masks(masks: DataFrame, points: DataFrame, keys: Sequence[str], crop_area: float, max_frac: float = 1.0,
                   size_ratio: float = 1.4, max_symbol: float = 50) -> DataFrame:
    """One box, score and mask per point from the masks that hold it: (keys, pt_idx, x0, y0, x1, y1, score, mask).

    ``masks``: (keys, mask_id, score, mask). Masks over ``max_frac`` of the crop are background. Of the rest those of
    at most ``size_ratio`` times the upper median area (in pixels) are joined; a union wider or higher than
    ``max_symbol`` falls back to the smallest mask with its own score. Points without a mask give no row; ties in area
    go to the smaller mask_id. Boxes are outermost pixels, not those of the detector."""
    keys = list(keys)
    e = extent(F.col("mask"))
    m = (masks.withColumn("area", area(F.col("mask"))).where((F.col("area") > 0) & (F.col("area") <= max_frac * crop_area))
         .withColumn("_e", e).select(*keys, "mask_id", "score", "mask", "area", F.col("_e.x0").alias("x"), F.col("_e.y0").alias("y"),
                                     (F.col("_e.x1") - F.col("_e.x0")).alias("w"), (F.col("_e.y1") - F.col("_e.y0")).alias("h")))
    spots = points.select(*keys, F.col("x").alias("p_x"), F.col("y").alias("p_y")).distinct()
    spot = [*keys, "p_x", "p_y"]
    # a point meets the runs of its image row that pass through its cell; only the mask's facts go along
    cut_at = lambda c: F.floor(F.col(c) / CELL)
    runs = unpack(m, [*keys, "mask_id"]).withColumn("_c", F.explode(F.sequence(cut_at("xa"), cut_at("xb")))).withColumnRenamed("y", "p_y")
    inside = (spots.withColumn("_c", cut_at("p_x")).join(runs, [*keys, "p_y", "_c"])
              .where((F.col("xa") <= F.col("p_x")) & (F.col("p_x") <= F.col("xb"))).select(*spot, "mask_id"))
    hit = inside.join(m.drop("mask"), [*keys, "mask_id"])
    order = Window.partitionBy(*spot).orderBy("area", "mask_id")
    ranked = (hit.withColumn("_i", F.row_number().over(order) - 1)
              .withColumn("_n", F.count("*").over(Window.partitionBy(*spot))))
    middle = ranked.where(F.col("_i") == F.floor(F.col("_n") / 2)).select(*spot, F.col("area").alias("_median"))
    near = ranked.join(middle, spot).where(F.col("area") <= size_ratio * F.col("_median"))
    box = near.groupBy(*spot).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"),
                                  F.max(F.col("y") + F.col("h")).alias("y1"), F.max("score").alias("_best"))
    big = (F.col("x1") - F.col("x0") > max_symbol) | (F.col("y1") - F.col("y0") > max_symbol)
    judged = near.join(box.select(*spot, "_best", big.alias("_big")), spot).where(~F.col("_big") | (F.col("_i") == 0))
    final = judged.groupBy(*spot).agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"),
        F.max(F.when(F.col("_big"), F.col("score")).otherwise(F.col("_best"))).alias("score"))
    # points under the same masks share one union
    sets = judged.groupBy(*spot).agg(F.array_sort(F.collect_list("mask_id")).alias("_set"))
    each = sets.select(*keys, "_set").distinct().withColumn("mask_id", F.explode("_set"))
    runs_of = unpack(each.join(m.select(*keys, "mask_id", "mask"), [*keys, "mask_id"]), [*keys, "_set"])
    shapes = sets.join(pack(union_by(runs_of, [*keys, "_set"]), [*keys, "_set"]), [*keys, "_set"]).drop("_set")
    placed = final.join(shapes, spot).withColumnsRenamed({"p_x": "x", "p_y": "y"})
    return points.select(*keys, "pt_idx", "x", "y").join(placed, [*keys, "x", "y"]).select(
        *keys, "pt_idx", "x0", "y0", "x1", "y1", "score", "mask")
