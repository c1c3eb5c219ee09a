"""Rounding that does not depend on the order in which values were summed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def settle(value: str | Column, places: int) -> Column:
    """Half-up rounding to ``places``, after the noise beyond ten places is dropped."""
    return F.round(F.round(value, 10), places)
