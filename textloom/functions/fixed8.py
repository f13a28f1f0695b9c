"""Scores between 0 and 1 held in 8 bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantise(score: Column) -> Column:
    """0 to 255, rounded half up; values outside 0 to 1 are brought to the nearer end."""
    return F.floor(F.least(F.greatest(score.cast("double"), F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("smallint")


def dequantise(q: Column) -> Column:
    return q.cast("double") / 255


def add(a: Column, b: Column) -> Column:
    """Sum that stays at 255."""
    return F.least(a.cast("int") + b.cast("int"), F.lit(255)).cast("smallint")


def multiply(a: Column, b: Column) -> Column:
    return quantise(dequantise(a) * dequantise(b))
