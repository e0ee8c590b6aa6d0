"""Binary classifier metrics over (label, score) rows, grouped by any columns (scorer, split).

Rows are first counted per distinct score; ranks and thresholds are running sums over those
counts, cut into range pieces so neither a hot score nor a single scorer fills one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.functions.numeric import f1, ratio, round_exact, sigmoid
from boxlake.operators.ranking import prefix_sums
from boxlake.session import cut


def score_counts(df: DataFrame, groups: Sequence[str] = (), label: str = "y", score: str = "score") -> DataFrame:
    """Rows and positives per distinct score."""
    return df.groupBy(*groups, F.col(score).alias("score")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos"))


def roc_auc(df: DataFrame, groups: Sequence[str] = (), label: str = "y", score: str = "score") -> DataFrame:
    """Area under the ROC curve by mid-ranks; NaN when one class is missing."""
    groups = list(groups)
    s = prefix_sums(score_counts(df, groups, label, score), groups, [F.asc("score")], {"n": "cum"})
    mid = F.col("cum") - F.col("n") + (F.col("n") + 1) / 2.0
    a = s.groupBy(*groups).agg(F.sum("n").alias("n"), F.sum("pos").alias("n_pos"), F.sum(mid * F.col("pos")).alias("rs"))
    n_neg = F.col("n") - F.col("n_pos")
    u = F.col("rs") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0
    auc = F.when((F.col("n_pos") > 0) & (n_neg > 0), u / (F.col("n_pos") * n_neg)).otherwise(F.lit(float("nan")))
    return a.select(*groups, "n", "n_pos", auc.alias("auc"))


def _prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [round_exact(p, 4).alias("precision"), round_exact(r, 4).alias("recall"),
            round_exact(f1(p, r), 4).alias("f1")]


def prf_at(df: DataFrame, thr: float = 0.5, groups: Sequence[str] = (), label: str = "y",
           score: str = "score") -> DataFrame:
    hit, y = F.col(score) >= thr, F.col(label) == 1
    a = df.groupBy(*groups).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"),
                                F.count_if(~hit & y).alias("fn"))
    return a.select(*groups, "tp", "fp", "fn", *_prf(F.col("tp"), F.col("fp"), F.col("fn")))


def best_f1(df: DataFrame, groups: Sequence[str] = (), label: str = "y", score: str = "score") -> DataFrame:
    """Threshold among the seen scores with the best F1.

    Candidates compare by F1 at four decimals; the lowest threshold wins ties and is itself
    reported at four decimals.
    """
    groups = list(groups)
    s = prefix_sums(score_counts(df, groups, label, score), groups, [F.desc("score")], {"n": "at", "pos": "tp"})
    total = df.groupBy(*groups).agg(F.sum(F.col(label).cast("bigint")).alias("n_pos"))
    if groups:
        s = s.join(total, groups)
        n_pos = F.col("n_pos")
    else:
        n_pos = total.scalar()
    tp, fp = F.col("tp"), F.col("at") - F.col("tp")
    m = s.select(*groups, "score", "tp", fp.alias("fp"), (n_pos - tp).alias("fn"))
    m = m.select("*", *_prf(F.col("tp"), F.col("fp"), F.col("fn")))
    best = m.groupBy(*groups).agg(F.max_by(
        F.struct("score", "tp", "fp", "fn", "precision", "recall", "f1"), F.struct("f1", -F.col("score"))).alias("b"))
    out = best.select(*groups, round_exact(F.coalesce("b.score", F.lit(0.5)), 4).alias("thr"),
                      *[F.coalesce(f"b.{c}", F.lit(0)).alias(c) for c in ("tp", "fp", "fn")],
                      *[F.coalesce(f"b.{c}", F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])
    return out


def calibration(df: DataFrame, groups: Sequence[str] = (), bins: int = 10, label: str = "y",
                score: str = "score") -> DataFrame:
    """Reliability bins: rows, mean score, positive share; the last bin is closed.

    Bin edges are the doubles i * (1 / bins) a linear spacing gives, so a score on an edge
    lands in the upper bin. Scores outside [0, 1] belong to no bin; empty bins are left out.
    """
    s = F.col(score)
    step = 1.0 / bins
    edges = [i * step for i in range(1, bins)]
    b = sum((F.when(s >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("bigint")
    a = (df.where((s >= 0) & (s <= 1)).groupBy(*groups, b.alias("bin"))
         .agg(F.count("*").alias("n"), F.avg(s).alias("_m"), F.avg(F.col(label).cast("double")).alias("_p")))
    return a.select(*groups, "bin", "n", round_exact(F.col("_m"), 3).alias("mean_score"),
                    round_exact(F.col("_p"), 3).alias("frac_pos"))


def relabel(df: DataFrame, pos_iou: float = 0.5, iou: str = "iou", out: str = "label") -> DataFrame:
    return df.withColumn(out, F.when(F.col(iou) >= pos_iou, 1).otherwise(0))


def label_flips(df: DataFrame, pos_iou: float = 0.5, baked: str = "label", iou: str = "iou") -> DataFrame:
    """How many rows change class when the stored IoU is thresholded again."""
    new = F.when(F.col(iou) >= pos_iou, 1).otherwise(0)
    return df.agg(F.count("*").alias("n"), F.sum(new).alias("pos"), F.sum(1 - new).alias("neg"),
                  F.count_if(new != F.col(baked)).alias("flips"))


def shared_scores(df: DataFrame, label: str, scorers: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long rows (scorer, y, score): several scorers judged on the same rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("scorer"), F.col(s).alias("score")) for s in scorers]))
    return df.select(*keep, F.col(label).alias("y"), pairs.alias("_s")).select(*keep, "y", "_s.*")


def calibrated(logit: Column, temperature: float | Column) -> Column:
    return sigmoid(logit / temperature)


def fit_temperature(df: DataFrame, logit: str = "logit", label: str = "y", max_steps: int = 60,
                    tol: float = 1e-10) -> float:
    """T > 0 with the smallest log loss of sigmoid(z / T); 1.0 unless both classes occur.

    Newton steps on u = log T. With a = z / T the loss has slope -(p - y) a and curvature
    (p - y) a + p (1 - p) a^2, one aggregate per step. Where the curvature is not positive, or
    a step does not lower the loss, the step falls back to a shortened descent step.
    """
    rows = cut(df.select(F.col(logit).cast("double").alias("z"), F.col(label).cast("double").alias("y")))
    n, pos = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or not 0 < pos < n:
        return 1.0

    def at(u: float):
        a = F.col("z") * F.exp(F.lit(-u))
        p = sigmoid(a)
        loss = F.greatest(a, F.lit(0.0)) - a * F.col("y") + F.log1p(F.exp(-F.abs(a)))
        return rows.agg(F.avg(loss), F.avg(-(p - F.col("y")) * a),
                        F.avg((p - F.col("y")) * a + p * (1 - p) * a * a)).first()

    import math

    u, (loss, g, h) = 0.0, at(0.0)
    for _ in range(max_steps):
        if abs(g) < tol:
            break
        step = -g / h if h > 0 else (-1.0 if g > 0 else 1.0)
        step = max(-2.0, min(2.0, step))
        nxt = at(u + step)
        while nxt[0] > loss and abs(step) > 1e-12:
            step /= 2
            nxt = at(u + step)
        if nxt[0] > loss:
            break
        u, (loss, g, h) = u + step, nxt
    return math.exp(u)
