"""Box, ring and coordinate expressions.

A box is four columns (x, y, w, h): top-left corner and size. Helpers take any four
columns, so the same expression serves flat columns, prefixed columns and struct fields.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxlake.functions.numeric import rint, round_exact


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Box(NamedTuple):
    x: Column
    y: Column
    w: Column
    h: Column

    @staticmethod
    def cols(prefix: str = "") -> "Box":
        return Box(*(F.col(prefix + c) for c in "xywh"))

    @staticmethod
    def of(struct: Column) -> "Box":
        return Box(*(struct[c] for c in "xywh"))

    @property
    def x1(self) -> Column:
        return self.x + self.w

    @property
    def y1(self) -> Column:
        return self.y + self.h

    def named(self, prefix: str = "") -> list[Column]:
        return [c.alias(prefix + n) for n, c in zip("xywh", self)]


def intersection(a: Box, b: Box) -> Column:
    """Overlap area. Kept short: it sits in join conditions, and a long one is not compiled."""
    iw = F.least(a.x1, b.x1) - F.greatest(a.x, b.x)
    ih = F.least(a.y1, b.y1) - F.greatest(a.y, b.y)
    return F.greatest(iw, F.lit(0)) * F.greatest(ih, F.lit(0))


def iou_of(inter: Column, a: Box, b: Box) -> Column:
    """IoU from a known overlap area; 0 when the union is empty."""
    union = a.w * a.h + b.w * b.h - inter
    return F.when(union > 0, inter.cast("double") / union).otherwise(F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 when the boxes do not overlap or the union is empty."""
    return iou_of(intersection(a, b), a, b)


def center(b: Box) -> tuple[Column, Column]:
    return b.x + b.w / 2.0, b.y + b.h / 2.0


def contains(b: Box, px: Column, py: Column) -> Column:
    """Closed on all four sides."""
    return (px >= b.x) & (px <= b.x1) & (py >= b.y) & (py <= b.y1)


def truncated_center(b: Box) -> tuple[Column, Column]:
    """Prompt point of a ground-truth box: centre cut to an integer."""
    cx, cy = center(b)
    return cx.cast("bigint"), cy.cast("bigint")


# --- source canvas -> raster ---------------------------------------------------------


def axis_scale(raster: Column, canvas: Column) -> Column:
    """Raster pixels per canvas unit; an unknown canvas size means no scaling."""
    return F.when(F.coalesce(canvas, F.lit(0)) > 0, raster / canvas).otherwise(F.lit(1.0))


def to_raster(x: Column, y: Column, sx: Column, sy: Column) -> tuple[Column, Column]:
    """The canvas has y growing upwards from 0, so y is negative there."""
    return x * sx, F.abs(y) * sy


def in_image(px: Column, py: Column, w: Column, h: Column) -> Column:
    """Half-open membership of a pixel."""
    return (px >= 0) & (px < w) & (py >= 0) & (py < h)


def open_ring(ring: Column) -> Column:
    """Drop the closing vertex when it repeats the first one."""
    n = F.size(ring)
    closed = (n > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    return F.when(closed, F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(ring)


def ring_extent(ring: Column, sx: Column, sy: Column) -> Column:
    """Extent struct (x0, y0, x1, y1, n) of a ring in raster units; short vertices are skipped."""

    def over(pts: Column) -> Column:
        xs, ys = F.transform(pts, lambda p: p[0] * sx), F.transform(pts, lambda p: F.abs(p[1]) * sy)
        return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"),
                        F.array_max(ys).alias("y1"), F.size(pts).alias("n"))

    return let(F.filter(ring, lambda p: F.size(p) >= 2), over)


def ring_box(ring: Column, sx: Column, sy: Column, zoom: float) -> Column:
    """Rounded box struct of a ring in zoomed pixels, null below 3 vertices or 2 px a side."""

    def box(e: Column) -> Column:
        x0, y0, w, h = e["x0"] * zoom, e["y0"] * zoom, e["x1"] * zoom - e["x0"] * zoom, e["y1"] * zoom - e["y0"] * zoom
        return F.when((w >= 2) & (h >= 2), F.struct(
            rint(x0).alias("x"), rint(y0).alias("y"), rint(w).alias("w"), rint(h).alias("h")))

    return let(let(ring, open_ring), lambda r: F.when(F.size(r) >= 3, let(ring_extent(r, sx, sy), box)))


def ring_box_clamped(ring: Column, sx: Column, sy: Column, img_w: Column, img_h: Column) -> Column:
    """Rounded box struct of a ring cut to the image, null when nothing is left."""

    def corners(e: Column) -> Column:
        return F.struct(F.greatest(F.lit(0), rint(e["x0"])).alias("x0"), F.greatest(F.lit(0), rint(e["y0"])).alias("y0"),
                        F.least(img_w, rint(e["x1"])).alias("x1"), F.least(img_h, rint(e["y1"])).alias("y1"))

    def box(c: Column) -> Column:
        return F.when((c["x1"] > c["x0"]) & (c["y1"] > c["y0"]), F.struct(
            c["x0"].alias("x"), c["y0"].alias("y"), (c["x1"] - c["x0"]).alias("w"), (c["y1"] - c["y0"]).alias("h")))

    return let(let(ring_extent(ring, sx, sy), corners), box)


def ring_pixels(ring: Column, sx: Column, sy: Column) -> Column:
    """Ring as pixel vertices at one decimal, closing vertex dropped."""
    return F.transform(open_ring(ring), lambda p: F.array(
        round_exact(p[0] * sx, 1), round_exact(F.abs(p[1]) * sy, 1)))


# --- size gates and windows ----------------------------------------------------------


def scaled_gate(value: Column, zoom: Column) -> Column:
    """A pixel limit at ``zoom``: zooms up to 1 leave it alone, the result is at least 1."""
    z = F.when(zoom > 1.0, zoom).otherwise(F.lit(1.0))
    return F.greatest(F.lit(1), rint(value * z))


def to_base(v: Column, zoom: Column) -> Column:
    """Zoomed pixel value back on the base raster (multiplied by the inverse, as stored)."""
    return rint(v * (F.lit(1.0) / zoom))


def hull_to_base(hull: Column, zoom: Column) -> Column:
    return F.transform(hull, lambda p: F.array(to_base(p[0], zoom), to_base(p[1], zoom)))


def finalize_box(x0: Column, y0: Column, x1: Column, y1: Column, pad: float, min_px: float,
                 img_w: Column, img_h: Column) -> Box:
    """Pad, grow to the smallest side about the centre, round, clamp to the image."""
    out = []
    for lo, hi, lim in ((x0, x1, img_w), (y0, y1, img_h)):
        lo, hi = lo - float(pad), hi + float(pad)
        c = (lo + hi) / 2
        small = (hi - lo) < min_px
        lo2 = F.when(small, c - min_px / 2).otherwise(lo)
        hi2 = F.when(small, c + min_px / 2).otherwise(hi)
        a = F.greatest(F.lit(0), rint(lo2))
        out.append((a, F.least(lim, rint(hi2)) - a))
    (x, w), (y, h) = out
    return Box(x, y, w, h)


def clip_window(b: Box, img_w: Column, img_h: Column, pad: int = 0) -> Box:
    """Crop window cut to the image; a non-positive side means nothing to crop."""
    x, y = F.greatest(F.lit(0), b.x - pad), F.greatest(F.lit(0), b.y - pad)
    return Box(x, y, F.least(img_w, b.x1 + pad) - x, F.least(img_h, b.y1 + pad) - y)


def centroid_window(cx: Column, cy: Column, half: Column, w: Column, h: Column) -> Box:
    """Window of ``half`` around a centroid, cut to the tile (keep only sides of 2 px or more)."""
    x0, y0 = F.greatest(F.lit(0), rint(cx - half)), F.greatest(F.lit(0), rint(cy - half))
    return Box(x0, y0, F.least(w, rint(cx + half)) - x0, F.least(h, rint(cy + half)) - y0)


def candidate_gate(w: Column, h: Column, tile_area: Column, min_px: int = 12, max_frac: float = 0.1) -> Column:
    return (F.least(w, h) >= min_px) & (w * h <= max_frac * tile_area)


def match_box(x0: Column, y0: Column, x1: Column, y1: Column, img_w: Column, img_h: Column,
              min_px: int, max_px: int | None, pad: int) -> Column:
    """Detector corners to a padded, clipped box struct; null when a size rule rejects it."""
    bw, bh = x1 - x0, y1 - y0
    longest = F.greatest(bw, bh)
    ok = (bw >= 1) & (bh >= 1) & (longest >= min_px)
    if max_px is not None:
        ok = ok & (longest <= max_px)
    mx, my = F.greatest(F.lit(0), rint(x0) - pad), F.greatest(F.lit(0), rint(y0) - pad)
    mw, mh = F.least(img_w - mx, rint(bw) + 2 * pad), F.least(img_h - my, rint(bh) + 2 * pad)
    return F.when(ok & (mw > 0) & (mh > 0), F.struct(
        mx.alias("x"), my.alias("y"), mw.alias("w"), mh.alias("h")))


# --- hulls, lines, grids -------------------------------------------------------------


def order_hull(hull: Column) -> Column:
    """Four corners as top-left, top-right, bottom-right, bottom-left (first wins on ties)."""

    def corner(key, smallest: bool) -> Column:
        def pick(vals: Column) -> Column:
            best = F.array_min(vals) if smallest else F.array_max(vals)
            return F.element_at(hull, F.array_position(vals, best).cast("int"))

        return let(F.transform(hull, key), pick)

    s, d = (lambda p: p[0] + p[1]), (lambda p: p[1] - p[0])
    return F.array(corner(s, True), corner(d, True), corner(s, False), corner(d, False))


def point_distance(p: Column, q: Column) -> Column:
    dx, dy = (p[0] - q[0]).cast("double"), (p[1] - q[1]).cast("double")
    return F.sqrt(dx * dx + dy * dy)


def hull_sides(ordered: Column) -> tuple[Column, Column]:
    """Width (tl-tr) and height (tl-bl) of an ordered hull."""
    tl, tr, bl = F.get(ordered, F.lit(0)), F.get(ordered, F.lit(1)), F.get(ordered, F.lit(3))
    return point_distance(tl, tr), point_distance(tl, bl)


def line_length(line: Column) -> Column:
    n = F.size(line)
    steps = F.zip_with(F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0))),
                       F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(0))), point_distance)
    return F.aggregate(steps, F.lit(0.0), lambda a, d: a + d)


def line_box(line: Column, pad: float) -> Column:
    """Axis-aligned box of a polyline, grown by ``pad`` of each side's length."""
    xs, ys = F.transform(line, lambda p: p[0]), F.transform(line, lambda p: p[1])
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    px, py = (x1 - x0) * pad, (y1 - y0) * pad
    return F.struct((x0 - px).alias("x"), (y0 - py).alias("y"),
                    (x1 - x0 + 2 * px).alias("w"), (y1 - y0 + 2 * py).alias("h"))


def line_box_tilted(line: Column, pad: float) -> Column:
    """Box aligned to the end-to-end direction: four corners, grown by ``pad`` of each side."""

    def axes(a: Column, b: Column) -> Column:
        n = point_distance(a, b)
        return F.struct(a[0].alias("ox"), a[1].alias("oy"),
                        F.when(n > 0, (b[0] - a[0]) / n).otherwise(F.lit(1.0)).alias("ux"),
                        F.when(n > 0, (b[1] - a[1]) / n).otherwise(F.lit(0.0)).alias("uy"))

    def extent(t: Column) -> Column:
        us = F.transform(line, lambda p: (p[0] - t["ox"]) * t["ux"] + (p[1] - t["oy"]) * t["uy"])
        vs = F.transform(line, lambda p: (p[1] - t["oy"]) * t["ux"] - (p[0] - t["ox"]) * t["uy"])
        return F.struct(t.alias("t"), F.array_min(us).alias("u0"), F.array_max(us).alias("u1"),
                        F.array_min(vs).alias("v0"), F.array_max(vs).alias("v1"))

    def corners(e: Column) -> Column:
        t, pu, pv = e["t"], (e["u1"] - e["u0"]) * pad, (e["v1"] - e["v0"]) * pad
        us, vs = (e["u0"] - pu, e["u1"] + pu), (e["v0"] - pv, e["v1"] + pv)
        return F.array(*[F.array(t["ox"] + us[i] * t["ux"] - vs[j] * t["uy"],
                                 t["oy"] + us[i] * t["uy"] + vs[j] * t["ux"]) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))])

    return let(let(axes(F.element_at(line, 1), F.element_at(line, -1)), extent), corners)


# Fixed value: pixels per feature cell of the dense encoder.
FEATURE_STRIDE = 16


def cell_to_pixel(row: Column, col: Column, sx: Column, sy: Column) -> tuple[Column, Column]:
    half = FEATURE_STRIDE / 2.0
    return (col * FEATURE_STRIDE + half) / sx, (row * FEATURE_STRIDE + half) / sy


def box_to_cells(b: Box, sx: Column, sy: Column, rows: Column, cols: Column) -> list[Column]:
    """Half-open cell range (r0, r1, c0, c1) under a box, at least one cell, cut to the grid."""
    out = []
    for lo, hi, s, lim in ((b.y, b.y1, sy, rows), (b.x, b.x1, sx, cols)):
        a = F.greatest(F.lit(0), F.floor(lo * s / FEATURE_STRIDE))
        z = F.least(lim, F.greatest(a + 1, F.ceil(hi * s / FEATURE_STRIDE)))
        out += [a, z]
    return out


def convert_box(b: Box, fmt: str) -> Column:
    """Box as an array in one of the exchange layouts."""
    layouts = {
        "x1y1wh": [b.x, b.y, b.w, b.h],
        "xywh": [b.x + b.w / 2.0, b.y + b.h / 2.0, b.w, b.h],
        "x1y1x2y2": [b.x, b.y, b.x1, b.y1],
        "x1y1x2y2w": [b.x, b.y, b.x1, b.y1, b.w],
    }
    return F.array(*[c.cast("double") for c in layouts[fmt]])


def normalized_box(b: Box, img_w: Column, img_h: Column) -> list[Column]:
    """Centre and size as fractions of the image."""
    return [(b.x + b.w / 2.0) / img_w, (b.y + b.h / 2.0) / img_h,
            b.w.cast("double") / img_w, b.h.cast("double") / img_h]
