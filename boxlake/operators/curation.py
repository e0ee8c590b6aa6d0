"""Class filters, leakage-free splits, samples and pools for crop datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.functions.text import draw_key, resolve_path, slugify, strip
from boxlake.operators.ranking import exact_rank, hash_rank, top_n


def class_name(c: str = "name") -> Column:
    return strip(F.coalesce(F.col(c), F.lit("")))


def class_counts(rows: DataFrame, min_per_class: int = 5, name: str = "name") -> DataFrame:
    """Non-blank classes with at least ``min_per_class`` rows."""
    return (rows.select(class_name(name).alias("name")).where(F.col("name") != "")
            .groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= min_per_class))


def class_ids(classes: DataFrame) -> DataFrame:
    """0-based label of each class: its position among the sorted names."""
    return exact_rank(classes, [], [F.asc("name")], "label").withColumn("label", F.col("label") - 1)


def class_summary(rows: DataFrame) -> DataFrame:
    """slug and row count per class; the row with a null name carries the totals."""
    named = rows.select(class_name().alias("name")).where(F.col("name") != "")
    per = named.groupBy("name").agg(F.count("*").alias("n_images"))
    both = per.groupingSets([["name"], []], "name").agg(F.sum("n_images").alias("n_images"), F.count("*").alias("n_classes"))
    return both.select("name", F.when(F.col("name").isNotNull(), slugify(F.col("name"))).alias("slug"), "n_images", "n_classes")


def class_size_stats(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("name").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_classes"), F.min("n").alias("min_n"),
                   F.percentile("n", F.lit(0.5)).cast("bigint").alias("median_n"), F.max("n").alias("max_n"))


# --- splits --------------------------------------------------------------------------


def val_quota(n: Column, frac: float) -> Column:
    """Rows of a class of ``n`` that go to validation: at least one, never all, none of a single."""
    q = F.greatest(F.lit(1), F.rint(n * F.lit(frac))).cast("bigint")
    return F.when((n > 1) & (n - q >= 1), q).otherwise(F.lit(0).cast("bigint"))


def stratified_split(rows: DataFrame, min_per_class: int = 5, frac: float = 0.2, seed: int = 0,
                     id_col: str = "path") -> DataFrame:
    """Rows of kept classes with ``split`` and ``label``; each class gives its quota to val."""
    classes = class_ids(class_counts(rows, min_per_class))
    kept = rows.join(classes.select(F.col("name").alias("_c"), "label"), class_name() == F.col("_c")).drop("_c")
    sizes = kept.groupBy("name").agg(F.count("*").alias("_n"))
    ranked = hash_rank(kept.withColumn("_key", draw_key(seed, F.col(id_col))), ["name"], "_key", "_r")
    return (ranked.join(sizes, "name")
            .withColumn("split", F.when(F.col("_r") <= val_quota(F.col("_n"), frac), "val").otherwise("train"))
            .drop("_key", "_r", "_n"))


def holdout_split(rows: DataFrame, ids: DataFrame, min_per_class: int = 5) -> DataFrame:
    """Split by id list (rid, split): classes are chosen on train alone, val is cut to them."""
    tagged = rows.drop("split").join(ids, "rid")
    classes = class_ids(class_counts(tagged.where(F.col("split") == "train"), min_per_class))
    return tagged.join(classes.select(F.col("name").alias("_c"), "label"), class_name() == F.col("_c")).drop("_c")


def dropped_val_classes(rows: DataFrame, ids: DataFrame, min_per_class: int = 5) -> DataFrame:
    """Class names seen in val that train does not keep."""
    tagged = rows.drop("split").join(ids, "rid").select("split", class_name().alias("name"))
    kept = class_counts(tagged.where(F.col("split") == "train"), min_per_class).select("name")
    return tagged.where(F.col("split") == "val").select("name").subtract(kept)


def split_stats(rows: DataFrame, ids: DataFrame, min_per_class: int = 5) -> DataFrame:
    tagged = rows.drop("split").join(ids, "rid").select("split", class_name().alias("name"))
    per = tagged.groupBy("name").agg(
        F.count_if(F.col("split") == "train").alias("tr"), F.count_if(F.col("split") == "val").alias("va"))
    keep = (F.col("tr") >= min_per_class) & (F.col("name") != "")
    return per.agg(F.sum(F.when(keep, F.col("tr")).otherwise(0)).alias("n_train"),
                   F.sum(F.when(keep, F.col("va")).otherwise(0)).alias("n_val"),
                   F.count_if(keep).alias("n_classes"),
                   F.sum(F.when(keep, 0).otherwise(F.col("va"))).alias("n_val_dropped"))


def per_rid_counts(split_rows: DataFrame) -> DataFrame:
    return split_rows.groupBy("rid", "split").agg(F.count("*").alias("n"))


def sheet_split(rows: DataFrame, frac: float = 0.2, seed: int = 0, sheet: Sequence[str] = ("rid", "wid"),
                fallback: str = "npz") -> DataFrame:
    """Whole sheets go to one side. With a single sheet its crop files are split instead.

    The unit is chosen per plan run by a scalar count, and units are ranked by hash pieces.
    """
    sheet = list(sheet)
    many = rows.select(*sheet).distinct().agg(F.count("*") > 1).scalar()
    by_sheet = F.concat_ws("|", *[F.col(c).cast("string") for c in sheet])
    tagged = rows.withColumn("_unit", F.when(many, by_sheet).otherwise(F.col(fallback).cast("string")))
    return _unit_split(tagged, frac, seed)


def ratio_split(rows: DataFrame, by: str, train_ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """Split whole documents, requests or sheets (``by``) at ``train_ratio``."""
    return _unit_split(rows.withColumn("_unit", F.col(by).cast("string")), 1 - train_ratio, seed)


def _unit_split(tagged: DataFrame, frac: float, seed: int) -> DataFrame:
    units = tagged.select("_unit").distinct().withColumn("_key", draw_key(seed, F.col("_unit")))
    n = units.agg(F.count("*")).scalar()
    n_val = F.greatest(F.lit(1), F.rint(n * F.lit(frac)))
    ranked = hash_rank(units, [], "_key", "_r").withColumn(
        "split", F.when(F.col("_r") <= n_val, "val").otherwise("train"))
    return tagged.drop("split").join(ranked.select("_unit", "split"), "_unit").drop("_unit")


# --- samples -------------------------------------------------------------------------


def cap_per_class(rows: DataFrame, cap: int = 64, seed: int = 0, by: str = "label", id_col: str = "id") -> DataFrame:
    """At most ``cap`` rows per class, drawn by key; 0 keeps all."""
    if cap <= 0:
        return rows
    keyed = rows.withColumn("_key", draw_key(seed, F.col(id_col)))
    return top_n(keyed, [by], [F.asc("_key"), F.asc(id_col)], cap).drop("_key", "rank")


def sample_units(units: DataFrame, n: int, seed: int = 0, by: Sequence[str] = (), id_col: str = "rid",
                 explicit: Sequence[str] | None = None) -> DataFrame:
    """Draw ``n`` units (per group); an explicit id list wins; 0 keeps all."""
    if explicit:
        return units.where(F.col(id_col).isin(list(explicit)))
    if n <= 0:
        return units
    keyed = units.withColumn("_key", draw_key(seed, *[F.col(c) for c in by], F.col(id_col)))
    return top_n(keyed, list(by), [F.asc("_key"), F.asc(id_col)], n).drop("_key", "rank")


def positive_pairs(rows: DataFrame, seed: int = 0, id_col: str = "id", by: str = "label") -> DataFrame:
    """One other row of the same class per row, by cyclic order of keys; a single pairs with itself.

    The successor of rank r is rank r + 1 (the last wraps to 1): an equi-join on
    (class, rank), linear in the rows however large a class is.
    """
    ranked = hash_rank(rows.select(by, id_col).withColumn("_key", draw_key(seed, F.col(id_col))), [by], "_key", "_r")
    n = rows.groupBy(by).agg(F.count("*").alias("_n"))
    nxt = ranked.join(n, by).withColumn("_next", F.when(F.col("_r") == F.col("_n"), F.lit(1)).otherwise(F.col("_r") + 1))
    peer = ranked.select(by, F.col("_r").alias("_next"), F.col(id_col).alias("positive"))
    return nxt.join(peer, [by, "_next"]).select(by, F.col(id_col).alias("anchor"), "positive")


def balance_weights(rows: DataFrame, by: str = "label") -> DataFrame:
    """Weight 1 / class size on every row."""
    n = rows.groupBy(by).agg(F.count("*").alias("_n"))
    return rows.join(n, by).withColumn("weight", 1.0 / F.col("_n")).drop("_n")


def balanced_resample(rows: DataFrame, n: int, seed: int = 0, by: str = "label", id_col: str = "id") -> DataFrame:
    """``n`` draws with replacement, every class equally likely, rows equally likely within it.

    Draw i hashes to a class and to a position in it; (class, position) is an equi-join on ranks.
    """
    spark = rows.sparkSession
    ranked = hash_rank(rows.withColumn("_key", draw_key(seed, F.col(id_col))), [by], "_key", "_r").drop("_key")
    sizes = exact_rank(rows.groupBy(by).agg(F.count("*").alias("_n")), [], [F.asc(by)], "_c")
    n_classes = sizes.agg(F.count("*")).scalar()

    def uniform(tag: str) -> Column:
        h = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), F.col("draw").cast("string"))), 1, 12)
        return F.conv(h, 16, 10).cast("double") / float(16**12)

    draws = (spark.range(n).withColumnRenamed("id", "draw")
             .withColumn("_c", (F.floor(uniform("class") * n_classes) + 1).cast("bigint"))
             .withColumn("_u", uniform("row")))
    placed = draws.join(sizes, "_c").withColumn("_r", (F.floor(F.col("_u") * F.col("_n")) + 1).cast("bigint"))
    return placed.select("draw", by, "_r").join(ranked, [by, "_r"]).drop("_r")


def thin_evenly(rows: DataFrame, n: int, order: str = "id") -> DataFrame:
    """``n`` rows at even strides of the order, first and last included."""
    total = rows.agg(F.count("*")).scalar()
    ranked = exact_rank(rows, [], [F.asc(order)], "_r")
    if n == 1:
        return ranked.where(F.col("_r") == 1).drop("_r")
    i = F.col("id").cast("double")
    at = F.when(F.col("id") == n - 1, total - 1).otherwise(F.floor(i * ((total - 1) / F.lit(float(n - 1)))))
    picks = rows.sparkSession.range(n).select((at + 1).cast("bigint").alias("_r")).distinct()
    return ranked.join(picks, "_r", "left_semi").where(total > n).unionByName(
        ranked.where(total <= n)).drop("_r")


def draw_rows(rows: DataFrame, n: int = 10_000, seed: int = 0, id_col: str = "id") -> DataFrame:
    keyed = rows.withColumn("_key", draw_key(seed, F.col(id_col)))
    return keyed.orderBy("_key", id_col).limit(n).drop("_key")


# --- sets of ids and rows ------------------------------------------------------------


def pool_manifests(manifests: Sequence[tuple[DataFrame, Column]]) -> DataFrame:
    """Bag union of manifests with different columns; paths made absolute."""
    out = None
    for df, base in manifests:
        df = df.withColumn("path", resolve_path(base, F.col("path")))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def resolve_holdout(train: DataFrame, val: DataFrame, allow_empty: bool = False) -> DataFrame:
    """Id lists as (rid, split): ids on both lists belong to val; an empty side is an error unless it is allowed."""
    t = train.select("rid").distinct().join(val.select("rid"), "rid", "left_anti")
    out = t.withColumn("split", F.lit("train")).unionByName(val.select("rid").distinct().withColumn("split", F.lit("val")))
    if allow_empty:
        return out
    n = F.count_if(F.col("split") == "train"), F.count_if(F.col("split") == "val")
    guard = out.agg(F.when(n[0] == 0, F.raise_error(F.lit("no train ids left beside the val ids")))
                    .when(n[1] == 0, F.raise_error(F.lit("no val ids"))).otherwise(F.lit(True))).scalar()
    return out.where(guard)


def overlap(rows: DataFrame, col: str) -> DataFrame:
    """Values of ``col`` present in both splits."""
    return (rows.where(F.col("split") == "train").select(col)
            .intersect(rows.where(F.col("split") == "val").select(col)))


def extend_ids(ids: DataFrame, required: DataFrame) -> DataFrame:
    """Required ids that are not listed yet are added to the list."""
    return ids.select("rid").unionByName(required.select("rid").join(ids, "rid", "left_anti"))


def both_splits(rows: DataFrame, split: str) -> DataFrame:
    return rows if split in (None, "all") else rows.where(F.col("split") == split)


def manifest_filter(rows: DataFrame, split: str | None = None, rid: str | None = None, wid: str | None = None) -> DataFrame:
    """Rows of a split whose ids start with the given prefixes."""
    out = both_splits(rows, split)
    if rid:
        out = out.where(F.col("rid").startswith(rid))
    return out.where(F.col("wid").startswith(wid)) if wid else out


def split_members(manifest: DataFrame, assignment: DataFrame, classes: DataFrame, split: str) -> DataFrame:
    """Manifest rows of a split with their label; unknown classes drop out."""
    member = assignment.where(F.col("split") == split).select("path")
    return manifest.join(member, "path", "left_semi").join(classes.select("name", "label"), "name")


def with_crops(ids: DataFrame, crops: DataFrame) -> DataFrame:
    return ids.join(crops.select("rid"), "rid", "left_semi")


def without_crops(ids: DataFrame, crops: DataFrame) -> DataFrame:
    return ids.join(crops.select("rid"), "rid", "left_anti")


def top_requests(sheets_with_patches: DataFrame, n: int) -> DataFrame:
    """Requests with most patch-bearing sheets, id as tie-break."""
    return (sheets_with_patches.groupBy("rid").agg(F.count_distinct("wid").alias("n_sheets"))
            .orderBy(F.desc("n_sheets"), F.asc("rid")).limit(n))


# --- training history ----------------------------------------------------------------


def best_epochs(history: DataFrame, arm: Sequence[str] = ("arm",), metric: str = "ari") -> DataFrame:
    """Best epoch per arm under the two rules in use: first best wins, and last best wins."""
    m = F.col(metric)
    return history.groupBy(*arm).agg(
        F.max_by("epoch", F.struct(m, -F.col("epoch"))).alias("first_best"),
        F.max_by("epoch", F.struct(m, F.col("epoch"))).alias("last_best"), F.max(m).alias("best"))


def latest_runs(runs: DataFrame, arm: Sequence[str] = ("arm",)) -> DataFrame:
    return runs.groupBy(*arm).agg(F.max_by("run", F.struct("modified", "run")).alias("run"))


def early_stop(history: DataFrame, patience: int = 5, arm: Sequence[str] = ("arm",), metric: str = "ari") -> DataFrame:
    """Epoch at which training stops per arm: ``patience`` epochs after the last strict gain.

    History holds one row per epoch of an arm, so the windows are short.
    """
    arm = list(arm)
    by = Window.partitionBy(*arm).orderBy("epoch")
    before = F.max(metric).over(by.rowsBetween(Window.unboundedPreceding, -1))
    gain = before.isNull() | (F.col(metric) > before)
    h = history.withColumn("_gain", gain).withColumn("_island", F.sum(F.col("_gain").cast("int")).over(by))
    since = F.row_number().over(Window.partitionBy(*arm, "_island").orderBy("epoch")) - 1
    h = h.withColumn("_since", since)
    return h.groupBy(*arm).agg(
        F.coalesce(F.min(F.when(F.col("_since") >= patience, F.col("epoch"))), F.max("epoch")).alias("stop_epoch"),
        F.coalesce(F.bool_or(F.col("_since") >= patience), F.lit(False)).alias("stopped_early"))
