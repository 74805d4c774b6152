"""Percentiles of groups of the size of one flight; ``operators.scans.order_statistics`` has those of any size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear(x: Column, q: float) -> Column:
    """Linear interpolation between order statistics."""
    return F.percentile(x, F.lit(q))


def or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))
