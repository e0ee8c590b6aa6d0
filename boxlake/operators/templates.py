"""Exemplar search in pixel tables and batch scoring with a caller's model."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.session import cut


def correlation(tile: np.ndarray, tpl: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation of a template at every place of a tile; 0 where a window is flat.

    Window sums come from integral images and products from one Fourier transform, so memory is a few arrays
    of the tile's size, whatever the template's."""
    (rows, cols), (h, w) = tile.shape, tpl.shape
    t, a = tpl - tpl.mean(), tile.astype(float)

    def sums(x: np.ndarray) -> np.ndarray:
        c = np.zeros((rows + 1, cols + 1))
        c[1:, 1:] = x.cumsum(axis=0).cumsum(axis=1)
        return c[h:, w:] - c[:-h, w:] - c[h:, :-w] + c[:-h, :-w]

    centred = a - a.mean()  # the template sums to zero, so a constant changes nothing but rounding
    num = np.fft.irfft2(np.fft.rfft2(centred) * np.conj(np.fft.rfft2(t, s=a.shape)), s=a.shape)[:rows - h + 1, :cols - w + 1]
    s1 = sums(a)
    den = np.sqrt(np.maximum(sums(a * a) - s1 * s1 / (h * w), 0) * (t * t).sum())
    return np.where(den > 1e-6, num / np.where(den > 1e-6, den, 1), 0.0)


def scale_template(tpl: np.ndarray, w: int, h: int) -> np.ndarray:
    """Area-average resize to w x h."""

    def weights(n: int, m: int) -> np.ndarray:
        e = np.arange(m + 1) * n / m
        lo, hi = np.arange(n)[None, :], np.arange(1, n + 1)[None, :]
        cover = np.clip(np.minimum(hi, e[1:, None]) - np.maximum(lo, e[:-1, None]), 0, None)
        return cover / cover.sum(axis=1, keepdims=True)

    return weights(tpl.shape[0], h) @ tpl @ weights(tpl.shape[1], w).T


def template_sizes(w: int, h: int, scales: Sequence[float]) -> list[tuple[int, int]]:
    return [(max(4, int(round(w * s))), max(4, int(round(h * s)))) for s in scales]


def search(pixels: DataFrame, sizes: DataFrame, template: np.ndarray, threshold: float = 0.7,
           scales: Sequence[float] = (0.8, 0.9, 1.0, 1.1, 1.25), tile: int = 1024, margin: int = 16,
           img: str = "img") -> DataFrame:
    """Matches (img, x, y, w, h, score) of one exemplar over all images.

    Pixels go to the overlapping tiles that hold them; a tile is bounded by its side, so each
    task builds one small array at a time. Places seen by two tiles give equal rows and are
    made distinct. Missing pixels count as 0. Cap, suppression and mapping back are the plain
    table operators that follow.
    """
    from boxlake.operators.spatial import match_tile_grid

    if min(template.shape) < 4:
        return pixels.sparkSession.createDataFrame([], f"{img} bigint, x bigint, y bigint, w bigint, h bigint, score double")
    base = template.astype(float)
    shapes = template_sizes(base.shape[1], base.shape[0], scales)
    tpls = [(w, h, scale_template(base, w, h)) for w, h in shapes]
    eff = max(tile, max(w for w, _, _ in tpls) + 1, max(h for _, h, _ in tpls) + 1)
    tiles = match_tile_grid(sizes.select(img, "width", "height"), max(w for w, _ in shapes), max(h for _, h in shapes), tile, margin)
    step = max(1, eff // 2)
    from boxlake.operators.spatial import cover, place_points

    t = cover(tiles, F.col("x0"), F.col("y0"), F.col("x1") - 1, F.col("y1") - 1, step)
    p = place_points(pixels.select(img, "x", "y", "v"), "x", "y", step)
    placed = (p.join(t, [img, "_cx", "_cy"])
              .where((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")))
              .select(img, "x0", "y0", "x1", "y1", "width", "height", "x", "y", "v"))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        f = pdf.iloc[0]
        x0, y0 = int(f.x0), int(f.y0)
        a = np.zeros((int(f.y1) - y0, int(f.x1) - x0))
        a[pdf.y.to_numpy() - y0, pdf.x.to_numpy() - x0] = pdf.v.to_numpy()
        out = []
        for w, h, tpl in tpls:
            if h >= f.height or w >= f.width or h >= a.shape[0] or w >= a.shape[1]:
                continue
            r = correlation(a, tpl)
            ys, xs = np.nonzero(r >= threshold)
            out.append(pd.DataFrame({img: f[img], "x": xs + x0, "y": ys + y0, "w": w, "h": h, "score": np.round(r[ys, xs], 9)}))
        cols = [img, "x", "y", "w", "h", "score"]
        return pd.concat(out)[cols] if out else pd.DataFrame({c: pd.Series(dtype="float64" if c == "score" else "int64") for c in cols})

    found = placed.groupBy(img, "x0", "y0").applyInPandas(scan, f"{img} bigint, x bigint, y bigint, w bigint, h bigint, score double")
    return found.groupBy(img, "x", "y", "w", "h").agg(F.max("score").alias("score"))


def match_exemplar(pixels: DataFrame, sizes: DataFrame, template: np.ndarray, threshold: float = 0.7,
                   scales: Sequence[float] = (0.8, 0.9, 1.0, 1.1, 1.25), most: int = 4000, overlap: float = 0.3,
                   to_base: float = 1.0, tile: int = 1024, margin: int = 16, img: str = "img") -> DataFrame:
    """Exemplar match as one job: all scales, best ``most`` per image, suppression, boxes mapped back by ``to_base``.

    Matches are numbered by their place, so ties fall alike on every run."""
    from boxlake.operators.detection import cap_detections
    from boxlake.operators.greedy import suppress

    found = search(pixels, sizes, template, threshold, scales, tile, margin, img)
    key = F.concat_ws(".", *[F.lpad(F.col(c).cast("string"), 9, "0") for c in ("y", "x", "h", "w")])
    ranked = cut(found.withColumn("pred_id", F.xxhash64(key)))
    kept = suppress(cap_detections(ranked, [img], most), [img], overlap).where("kept")
    return kept.select(img, *[F.rint(F.col(c) * F.lit(to_base)).cast("bigint").alias(c) for c in "xywh"], "score")


def exemplar(pixels: DataFrame, image: int, x: int, y: int, w: int, h: int, img: str = "img") -> np.ndarray:
    """The chosen rectangle as a small array (w * h pixels, checked)."""
    if w * h > 1_000_000:
        raise ValueError("exemplar larger than a tile")
    rows = pixels.where((F.col(img) == image) & F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)).select("x", "y", "v").collect()
    a = np.zeros((h, w))
    for r in rows:
        a[r.y - y, r.x - x] = r.v
    return a


def score_candidates(rows: DataFrame, make_model: Callable, features: Sequence[str], temperature: float = 1.0,
                     batch_size: int = 1024, out: str = "score") -> DataFrame:
    """Calibrated score of every candidate from a caller's model.

    ``make_model`` runs once per Python worker and returns a function from a feature matrix to
    logits; rows arrive in Arrow batches.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import DoubleType

    from boxlake.operators.classifier import calibrated

    def load():
        model = make_model()
        return lambda x: np.asarray(model(x), dtype="float64").reshape(-1)

    logit = predict_batch_udf(load, return_type=DoubleType(), batch_size=batch_size, input_tensor_shapes=[[len(features)]])
    vec = F.array(*[F.col(c).cast("double") for c in features])
    return rows.withColumn("logit", logit(vec)).withColumn(out, calibrated(F.col("logit"), temperature))


def class_categories(names: DataFrame, mapping: DataFrame | None, include: Sequence[str] = (), exclude: Sequence[str] = (),
                     max_rules: int = 10_000) -> DataFrame:
    """Category of each distinct layer name: the rule with the lowest id whose pattern fits.

    Without rules each name is its own category, ids by sorted name. Rules are a short
    configuration; they become one CASE chain, so names are scanned once and nothing is joined.
    """
    from boxlake.operators.ranking import exact_rank

    distinct = names.select("name").distinct()
    if mapping is None:
        out = exact_rank(distinct, [], [F.asc("name")], "category_id").select(
            "name", F.col("name").alias("category"), (F.col("category_id") - 1).alias("category_id"))
    else:
        rules = mapping.orderBy("category_id").limit(max_rules + 1).collect()
        if len(rules) > max_rules:
            raise ValueError("category map is larger than a configuration should be")
        case: Column | None = None
        for r in rules:
            pick = F.struct(F.lit(r.category_name).alias("category"), F.lit(r.category_id).cast("bigint").alias("category_id"))
            fits = F.col("name").rlike(f"^(?:{r.layer_name_regex})")
            case = F.when(fits, pick) if case is None else case.when(fits, pick)
        out = distinct.withColumn("_c", case).where(F.col("_c").isNotNull()).select("name", "_c.*")
    if include:
        out = out.where(F.col("category").isin(list(include)))
    return out.where(~F.col("category").isin(list(exclude))) if exclude else out
