"""Operators as named views, so that SQL gets their plans (SK4).

``register_resolution`` turns a dimension into the lookup a SQL statement joins once;
``register_history`` puts the validity columns of ``with_validity`` on any registered view.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from .operators.history import with_validity
from .operators.lookup import resolution_table, resolution_timeline
from .sinks import register_views


def register_resolution(spark: SparkSession, name: str, dim: str, id_col: str, name_col: str,
                        versions: str = "all", start: str = "effective_timestamp",
                        end: str = "end_timestamp", current: str = "iscurrent") -> None:
    """View ``name`` (value, hit, copies) over the dimension view ``dim``: every reference that resolves.

    With ``versions="as_of"`` the view is a timeline and has valid_from and valid_to as well.
    """
    rows = spark.table(dim)
    if versions == "as_of":
        r = resolution_timeline(rows, id_col, name_col, start, end).toDF("value", "valid_from", "valid_to", "hit", "copies")
    elif versions in ("all", "current"):
        r = resolution_table(rows.filter(current) if versions == "current" else rows, id_col, name_col).toDF("value", "hit", "copies")
    else:
        raise ValueError("versions must be all|current|as_of")
    register_views(spark, **{name: r})


def register_history(spark: SparkSession, name: str, source: str, key: str | Sequence[str], start: str,
                     order_by: Sequence[str] = (), copies: str | None = None, **options) -> None:
    """View ``name``: the rows of the view ``source`` with end_timestamp and iscurrent."""
    register_views(spark, **{name: with_validity(spark.table(source), key, start, order_by, copies=copies, **options)})
