"""Derived flags (FI3, FI4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..layouts import INVESTMENT_GRADES


def is_low_grade(rating: str | Column, grades: Sequence[str] = INVESTMENT_GRADES) -> Column:
    """False for an investment grade; True otherwise, NULL and blank included."""
    r = F.col(rating) if isinstance(rating, str) else rating
    return F.when(r.isin(list(grades)), F.lit(False)).otherwise(F.lit(True))
