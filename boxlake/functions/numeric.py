"""Rounding and ratio helpers that agree with IEEE doubles rounded half-to-even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: 2**27 + 1, splits a double into two halves whose products are exact.
SPLITTER = 134217729.0


def rint(c: Column, dtype: str = "bigint") -> Column:
    """Nearest integer, ties to even."""
    return F.rint(c).cast(dtype)


def round_exact(c: Column, digits: int) -> Column:
    """Round the *binary* value of a double to ``digits`` (at most 5) decimals, ties to even.

    ``bround`` rounds the shortest decimal form instead, which differs for values such as
    1/160 that print as a tie but are not one.
    """
    scale = float(10**digits)
    base = F.floor(c * scale).cast("double")
    big = c * SPLITTER
    hi = big - (big - c)
    lo = c - hi
    over = (hi * (2 * scale) - (base * 2 + 1)) + lo * (2 * scale)
    up = (over > 0) | ((over == 0) & (base % 2 != 0))
    return F.when(up, base + 1).otherwise(base) / scale


def round_exact_sql(c: str, digits: int) -> str:
    """The same rule as SQL text, for the DuckDB checks. ``c`` should be a column name."""
    s = f"{float(10**digits)!r}::DOUBLE"
    b = f"floor({c} * {s})"
    hi = f"({c} * {SPLITTER!r}::DOUBLE - ({c} * {SPLITTER!r}::DOUBLE - {c}))"
    over = f"(({hi} * (2 * {s}) - ({b} * 2 + 1)) + ({c} - {hi}) * (2 * {s}))"
    return f"(CASE WHEN {over} > 0 OR ({over} = 0 AND {b} % 2 <> 0) THEN {b} + 1 ELSE {b} END / {s})"


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` with 0.0 for an empty denominator."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def prf_columns(hits: Column, n_pred: Column, n_gt: Column, prefix: str = "") -> list[Column]:
    """precision / recall / f1 rounded to four decimals; f1 comes from the unrounded pair."""
    p, r = ratio(hits, n_pred), ratio(hits, n_gt)
    return [
        round_exact(p, 4).alias(f"{prefix}precision"),
        round_exact(r, 4).alias(f"{prefix}recall"),
        round_exact(f1(p, r), 4).alias(f"{prefix}f1"),
    ]


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
