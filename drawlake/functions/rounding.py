"""Rounding that gives the same bits in every IEEE engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round6(value: Column) -> Column:
    return F.floor(value * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)


def rank_key(weight: Column) -> Column:
    """Weight in units of 1e-12 as BIGINT: ordering that ignores last-bit noise of pow()."""
    return F.floor(weight * F.lit(1e12) + F.lit(0.5)).cast("bigint")
