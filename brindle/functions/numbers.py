"""Arithmetic of the market panel as Spark columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def ratio(x: Column, y: Column) -> Column:
    """x / y; null for a zero or null denominator."""
    return x / F.nullif(y, F.lit(0.0))


def enterprise_value(market_cap: Column, debt: Column, cash: Column) -> Column:
    return market_cap + debt - cash


def sentiment_index(positive: Column, negative: Column) -> Column:
    return positive - negative


def box_cox(y: Column, power: float) -> Column:
    return F.log(y) if abs(power) < 1e-6 else (F.pow(y, F.lit(power)) - 1) / power


def log1p_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """log_<name> for those of names that df has."""
    return df.withColumns({f"log_{n}": F.log1p(n) for n in names if n in df.columns})


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def newey_west_lag(n: int) -> int:
    """The larger of 1 and the whole part of 0.75 n^(1/3)."""
    return max(1, int(0.75 * n ** (1 / 3)))
