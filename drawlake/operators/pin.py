"""Evaluate costly expressions exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def pin(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later projections and filters read instead of recompute.

    Catalyst substitutes a projected expression into every filter above it; with
    parsing expressions that multiplies work and generated code. A generator of
    one row is a boundary for that substitution and stays a narrow operator.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in columns]
    values = F.struct(*[value.alias(name) for name, value in columns.items()])
    return rows.select(*kept, F.inline(F.array(values)))
