"""Numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(value: Column, digits: int) -> Column:
    """Round with ties to the even neighbour, as published tables do (3.125 becomes 3.12)."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale
