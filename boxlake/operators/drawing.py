"""Vector paths of a drawing: visibility, length and style operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.operators.ranking import exact_rank

# Fixed value: style attributes that make two paths one drawing command.
STYLE = ("fill", "color", "dashes", "even_odd", "close_path", "line_join", "line_cap", "width",
         "stroke_opacity", "fill_opacity")


def mean_colour(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / F.size(c)


def visibility(kind: Column, color: Column, fill: Column, stroke_opacity: Column, fill_opacity: Column) -> Column:
    """Darkness times opacity on 0..255, cut to an integer; strokes use their colour, others the fill."""
    stroke = kind == "s"
    shade = F.when(stroke, mean_colour(color)).otherwise(mean_colour(fill))
    opacity = F.when(stroke, stroke_opacity).otherwise(fill_opacity)
    return ((F.lit(1) - shade) * opacity * 255).cast("int")


def visibility_histogram(paths: DataFrame, v: str = "visibility", bins: int = 256) -> DataFrame:
    """All ``bins`` equal-width bins between the smallest and largest value: (bin, n, upper)."""
    ends = paths.agg(F.struct(F.min(v).cast("double").alias("lo"), F.max(v).cast("double").alias("hi"))).scalar()

    def limits(df: DataFrame) -> DataFrame:
        flat = F.col("_e.lo") == F.col("_e.hi")
        lo, hi = F.when(flat, F.col("_e.lo") - 0.5).otherwise(F.col("_e.lo")), F.when(flat, F.col("_e.hi") + 0.5).otherwise(F.col("_e.hi"))
        return df.withColumn("_e", ends).withColumn("lo", lo).withColumn("hi", hi).withColumn("step", (F.col("hi") - F.col("lo")) / bins).drop("_e")

    lo, hi, step, x = F.col("lo"), F.col("hi"), F.col("step"), F.col("v").cast("double")
    values = limits(paths.groupBy(F.col(v).alias("v")).agg(F.count("*").alias("n"))).withColumn(
        "guess", F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)))
    guess = F.col("guess")
    idx = (F.when(x < guess * step + lo, guess - 1)
           .when((guess < bins - 1) & (x >= (guess + 1) * step + lo), guess + 1).otherwise(guess))
    counts = values.groupBy(idx.cast("bigint").alias("bin")).agg(F.sum("n").alias("n"))
    spine = paths.sparkSession.range(bins).withColumnRenamed("id", "bin")
    upper = F.when(F.col("bin") == bins - 1, hi).otherwise((F.col("bin") + 1) * step + lo)
    return limits(spine).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), upper.alias("upper"))


def visibility_threshold(paths: DataFrame, v: str = "visibility", bins: int = 256) -> DataFrame:
    """Count-weighted mean of the upper edges at the histogram's peaks, cut to an integer; the
    median value when there is no peak.

    A peak is a run of equal counts above both neighbours, taken at its middle; outside the
    histogram counts are 0. The windows run over the 258 padded bins.
    """
    h = visibility_histogram(paths, v, bins)
    ends = paths.sparkSession.range(2).select((F.col("id") * (bins + 1) - 1).alias("bin"),
                                              F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("upper"))
    p = h.unionByName(ends)
    order = Window.orderBy("bin")
    new = F.coalesce((F.col("n") != F.lag("n").over(order)).cast("int"), F.lit(1))
    runs = (p.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
            .groupBy("_run").agg(F.min("bin").alias("a"), F.max("bin").alias("b"), F.max("n").alias("n")))
    by = Window.orderBy("_run")
    peak = (F.col("n") > F.lag("n").over(by)) & (F.col("n") > F.lead("n").over(by))
    peaks = (runs.withColumn("_peak", peak).where("_peak")
             .select(F.floor((F.col("a") + F.col("b")) / 2).alias("bin"), F.col("n").alias("weight")))
    w = peaks.join(h.select("bin", "upper"), "bin").agg(
        (F.sum(F.col("upper") * F.col("weight")) / F.sum("weight")).alias("t"))
    median = paths.agg(F.percentile(v, F.lit(0.5))).scalar()
    return w.select(F.coalesce(F.col("t").cast("bigint").cast("double"), median).alias("threshold"))


def visible_paths(paths: DataFrame, v: str = "visibility") -> DataFrame:
    return paths.where(F.col(v) >= visibility_threshold(paths, v).scalar())


def drop_long(paths: DataFrame, limit: float, rect: str = "rect") -> DataFrame:
    """Drop paths whose rectangle is wider or taller than ``limit``; paths without one stay."""
    r = F.col(rect)
    long = (F.abs(r[2] - r[0]) > limit) | (F.abs(r[3] - r[1]) > limit)
    return paths.where(r.isNull() | ~long)


def style_groups(paths: DataFrame, style: Sequence[str] = STYLE, id_col: str = "path_id") -> DataFrame:
    """One row per distinct style: ``grp`` numbers them by first appearance, with size and first path."""
    g = paths.groupBy(*style).agg(F.count("*").alias("n_paths"), F.min(id_col).alias("first_path"))
    return exact_rank(g, [], [F.asc("first_path")], "grp").withColumn("grp", F.col("grp") - 1)


def grouped_paths(paths: DataFrame, style: Sequence[str] = STYLE, id_col: str = "path_id") -> DataFrame:
    """Every path with its style group and its place in it (input order).

    Stays one row per path: a style that covers a third of a corpus must not become one array.
    """
    groups = style_groups(paths, style, id_col)
    cond = None
    g = groups.select("grp", *[F.col(c).alias(f"_g_{c}") for c in style])
    for c in style:
        e = F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        cond = e if cond is None else cond & e
    tagged = paths.join(g, cond).drop(*[f"_g_{c}" for c in style])
    return exact_rank(tagged, ["grp"], [F.asc(id_col)], "pos").withColumn("pos", F.col("pos") - 1)


def shape_tallies(paths: DataFrame, limit: float, kind: str = "kind", size: str = "size") -> DataFrame:
    """Curves, lines and rectangles before and after the length rule; curves always stay."""
    k = F.when(F.col(kind) == "c", "curve").when(F.col(kind) == "l", "line").otherwise("rect")
    keep = (k == "curve") | (F.col(size) <= limit)
    return paths.groupBy(k.alias("shape")).agg(F.count("*").alias("before"), F.count_if(keep).alias("after"))
