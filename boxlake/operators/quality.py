"""Dataset verification: each check is one aggregate row, the report is their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake.operators.curation import class_size_stats, overlap

# Render zoom every crop must carry, and its tolerance.
EXPECTED_ZOOM = 4.0
ZOOM_TOL = 1e-6


def _row(df: DataFrame, pos: int, name: str, ok: Column, *detail: Column | str) -> DataFrame:
    parts = [F.lit(d) if isinstance(d, str) else F.coalesce(d.cast("string"), F.lit("none")) for d in detail]
    return df.select(F.lit(pos).alias("pos"), F.lit(name).alias("name"),
                     F.coalesce(ok, F.lit(False)).alias("ok"), F.concat(*parts).alias("detail"))


def _missing(ids: DataFrame, have: DataFrame) -> DataFrame:
    return ids.join(have.select("rid"), "rid", "left_anti").agg(F.count("*").alias("n"))


def source_packs(ids: DataFrame, packs: DataFrame) -> DataFrame:
    """Every id has a source pack."""
    return _row(_missing(ids, packs), 1, "source_packs", F.col("n") == 0, "missing packs=", F.col("n"))


def box_layers(ids: DataFrame, features: DataFrame) -> DataFrame:
    """Every id has at least one boxed feature."""
    n = features.where(F.col("layer").startswith("bbox_")).groupBy("rid").agg(F.count("*").alias("n"))
    a = ids.join(n, "rid", "left").agg(F.coalesce(F.min(F.coalesce("n", F.lit(0))), F.lit(0)).alias("least"),
                                       F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return _row(a, 2, "bbox_layers", F.col("least") > 0, "features=", F.col("total"), " fewest per id=", F.col("least"))


def crops_exported(ids: DataFrame, crops: DataFrame) -> DataFrame:
    """Every id has exported crops."""
    return _row(_missing(ids, crops), 3, "crops_exported", F.col("n") == 0, "missing crops=", F.col("n"))


def rid_overlap(split_ids: DataFrame) -> DataFrame:
    """No id in both splits."""
    return _row(overlap(split_ids, "rid").agg(F.count("*").alias("n")), 4, "rid_overlap", F.col("n") == 0, "shared ids=", F.col("n"))


def val_locked(split_ids: DataFrame, locked: DataFrame) -> DataFrame:
    """Val ids are exactly the locked list."""
    v = split_ids.where(F.col("split") == "val").select("rid").distinct().withColumn("v", F.lit(1))
    d = v.join(locked.select("rid").distinct().withColumn("l", F.lit(1)), "rid", "full_outer").agg(
        F.count_if(F.col("l").isNull()).alias("extra"), F.count_if(F.col("v").isNull()).alias("absent"))
    return _row(d, 5, "val_rids_locked", (F.col("extra") == 0) & (F.col("absent") == 0),
                "extra=", F.col("extra"), " absent=", F.col("absent"))


def split_mode(meta: DataFrame) -> DataFrame:
    """The split was made by id holdout. ``meta`` is the one-row split summary."""
    return _row(meta.agg(F.max("split_mode").alias("m")), 6, "split_mode", F.col("m") == "rid_holdout", "split_mode=", F.col("m"))


def crop_counts(assigned: DataFrame) -> DataFrame:
    """Both splits hold crops."""
    a = assigned.agg(F.count_if(F.col("split") == "train").alias("t"), F.count_if(F.col("split") == "val").alias("v"))
    return _row(a, 7, "crop_counts", (F.col("t") > 0) & (F.col("v") > 0), "train=", F.col("t"), " val=", F.col("v"))


def class_stats(train: DataFrame) -> DataFrame:
    """At least two train classes."""
    s = class_size_stats(train)
    return _row(s, 8, "class_stats", F.col("n_classes") >= 2, "n_classes=", F.col("n_classes"), " min=", F.col("min_n"),
                " median=", F.col("median_n"), " max=", F.col("max_n"))


def label_sanity(train: DataFrame, show: int = 8) -> DataFrame:
    """No class name is empty or carries the layer prefix; the detail shows the first bad ones."""
    bad = F.col("name").isNull() | (F.col("name") == "") | F.col("name").startswith("bbox_")
    names = train.groupBy("name").agg(F.lit(1).alias("_one"))
    worst = names.where(bad).select(F.coalesce("name", F.lit("")).alias("name")).orderBy("name").limit(show)
    text = worst.agg(F.array_join(F.array_sort(F.collect_list("name")), "|")).scalar()
    a = names.agg(F.count_if(bad).alias("bad"), F.count("*").alias("n")).withColumn("shown", text)
    return _row(a, 9, "label_sanity", F.col("bad") == 0, "bad labels=", F.col("bad"), " of ", F.col("n"),
                F.when(F.col("bad") > 0, F.concat(F.lit(": "), F.col("shown"))).otherwise(""))


def path_leakage(assigned: DataFrame) -> DataFrame:
    """No crop path in both splits."""
    return _row(overlap(assigned, "path").agg(F.count("*").alias("n")), 10, "path_leakage", F.col("n") == 0, "shared paths=", F.col("n"))


def sheet_leakage(pool: DataFrame, split_ids: DataFrame) -> DataFrame:
    """No sheet in both splits, by the split of its request."""
    s = pool.select("rid", "wid").distinct().join(split_ids.select("rid", "split"), "rid")
    return _row(overlap(s, "wid").agg(F.count("*").alias("n")), 11, "wid_leakage", F.col("n") == 0, "shared sheets=", F.col("n"))


def zoom_sanity(pool: DataFrame, zoom: float = EXPECTED_ZOOM) -> DataFrame:
    """All crops were rendered at the expected zoom."""
    bad = F.abs(F.coalesce("zoom", F.lit(0.0)) - zoom) > ZOOM_TOL
    a = pool.agg(F.count_if(bad).alias("bad"), F.min("zoom").alias("lo"), F.max("zoom").alias("hi"))
    return _row(a, 12, "zoom_sanity", F.col("bad") == 0, "other zooms=", F.col("bad"))


def verify(ids: DataFrame, packs: DataFrame, features: DataFrame, crops: DataFrame, pool: DataFrame,
           assigned: DataFrame, split_ids: DataFrame, locked: DataFrame, meta: DataFrame) -> DataFrame:
    """All checks as (pos, name, ok, detail). Missing crops end the report after check 3."""
    train = pool.join(assigned.where(F.col("split") == "train").select("path"), "path", "left_semi")
    head = [source_packs(ids, packs), box_layers(ids, features), crops_exported(ids, crops)]
    tail = [rid_overlap(split_ids), val_locked(split_ids, locked), split_mode(meta), crop_counts(assigned),
            class_stats(train), label_sanity(train), path_leakage(assigned), sheet_leakage(pool, split_ids), zoom_sanity(pool)]
    go_on = crops_exported(ids, crops).select("ok").scalar()
    rest = reduce(DataFrame.unionByName, tail).where(go_on)
    return reduce(DataFrame.unionByName, head).unionByName(rest)


def report_status(checks: DataFrame) -> DataFrame:
    """One row: ok, number of checks, failed check names in order."""
    failed = F.transform(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("pos", "name")))), lambda f: f["name"])
    return checks.agg(F.bool_and("ok").alias("ok"), F.count("*").alias("n_checks"), failed.alias("failed"))


class VerifyFailed(RuntimeError):
    """The dataset is not fit for training."""


def require_ok(checks: DataFrame | None, skip: bool = False) -> None:
    """Gate before training: the report must exist and every check must hold."""
    if skip:
        return
    if checks is None:
        raise VerifyFailed("no verify report; run the checks first or skip them explicitly")
    s = report_status(checks).first()
    if not s.n_checks:
        raise VerifyFailed("no verify report; run the checks first or skip them explicitly")
    if not s.ok:
        raise VerifyFailed(f"failed checks: {list(s.failed)}")


def report_markdown(checks: DataFrame) -> DataFrame:
    """Checklist lines in order, one row per line."""
    mark = F.when(F.col("ok"), "PASS").otherwise("FAIL")
    return checks.select("pos", F.format_string("- **%s** `%s` — %s", mark, F.col("name"), F.col("detail")).alias("line"))
