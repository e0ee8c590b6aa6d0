"""Ranks, top-n and running sums that never put a whole group into one task.

A plain ``row_number() over (partition by g order by k)`` sends all of ``g`` to one task. A
third of all rows may share one ``g``, so ranks are built from pieces instead: order the rows
into consecutive pieces, number them inside each piece, add the size of the pieces before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxlake.session import cut

_RUNNING = (Window.unboundedPreceding, -1)


def hash_rank(df: DataFrame, groups: Sequence[str], key: str, out: str = "rank",
              digits: int = 3) -> DataFrame:
    """1-based rank by a hexadecimal hash column inside each group; exact and lazy.

    Leading hex digits are spread evenly and order like the key itself, so each group
    splits into 16**digits pieces of similar size.
    """
    groups = list(groups)
    pieces = df.withColumn("_piece", F.substring(F.col(key), 1, digits))
    sizes = pieces.groupBy(*groups, "_piece").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_piece").rowsBetween(*_RUNNING))
    offsets = sizes.select(*groups, "_piece", F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*groups, "_piece").orderBy(key))
    return (pieces.withColumn("_inner", inner)
            .join(offsets, [*groups, "_piece"])
            .withColumn(out, (F.col("_inner") + F.col("_before")).cast("bigint"))
            .drop("_piece", "_inner", "_before"))


def range_pieces(df: DataFrame, groups: Sequence[str], order: Sequence[Column],
                 pieces: int | None = None) -> DataFrame:
    """Sort by (groups, order) over range partitions; adds ``_piece`` and ``_pos``.

    Range bounds are drawn on the full sort key, so a hot group is cut like any other. The
    result is checkpointed: later passes must see the same pieces, also after a lost executor.
    """
    keys = [F.col(g) for g in groups] + list(order)
    n = [pieces] if pieces else []
    ordered = df.repartitionByRange(*n, *keys).sortWithinPartitions(*keys)
    row = F.monotonically_increasing_id()
    ordered = ordered.withColumn("_row", row)
    return cut(ordered.withColumn("_piece", F.shiftright("_row", 33))
               .withColumn("_pos", F.col("_row").bitwiseAND((1 << 33) - 1)).drop("_row"))


def exact_rank(df: DataFrame, groups: Sequence[str], order: Sequence[Column],
               out: str = "rank", pieces: int | None = None) -> DataFrame:
    """1-based rank in a total order inside each group, for any sort key."""
    groups = list(groups)
    p = range_pieces(df, groups, order, pieces)
    sizes = p.groupBy(*groups, "_piece").agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    w = Window.partitionBy(*groups).orderBy("_piece").rowsBetween(*_RUNNING)
    offsets = sizes.select(*groups, "_piece", "_first",
                           F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    joined = _join_null_safe(p, offsets, [*groups, "_piece"])
    rank = F.col("_pos") - F.col("_first") + F.col("_before") + 1
    return joined.withColumn(out, rank.cast("bigint")).drop("_piece", "_pos", "_first", "_before")


def prefix_sums(df: DataFrame, groups: Sequence[str], order: Sequence[Column],
                values: dict[str, str], pieces: int | None = None) -> DataFrame:
    """Add, for every ``value -> out`` pair, the sum over all rows up to and including this one."""
    groups = list(groups)
    p = range_pieces(df, groups, order, pieces)
    totals = p.groupBy(*groups, "_piece").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    w = Window.partitionBy(*groups).orderBy("_piece").rowsBetween(*_RUNNING)
    offsets = totals.select(*groups, "_piece", *[
        F.coalesce(F.sum(f"_t_{v}").over(w), F.lit(0)).alias(f"_o_{v}") for v in values])
    inner = Window.partitionBy(*groups, "_piece").orderBy("_pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = p.select("*", *[F.sum(v).over(inner).alias(f"_i_{v}") for v in values])
    out = _join_null_safe(out, offsets, [*groups, "_piece"])
    for v, name in values.items():
        out = out.withColumn(name, F.col(f"_i_{v}") + F.col(f"_o_{v}"))
    drop = [f"_{k}_{v}" for v in values for k in "io"]
    return out.drop("_piece", "_pos", *drop)


def top_n(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int,
          out: str = "rank") -> DataFrame:
    """First ``n`` rows of each group in a total order.

    Up to a thousand rows Spark already cuts each map task to its own best ``n``. Above that the
    rank comes from range pieces, so a hot group is cut like any other and none is sorted whole.
    """
    groups = list(groups)
    if n > 1000:
        return exact_rank(df, groups, order, out).where(F.col(out) <= n)
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that treats null keys as equal and keeps the left key columns."""
    r = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cond = c if cond is None else cond & c
    return left.join(r, cond).drop(*[f"_k_{k}" for k in keys])
