"""Union of full and incremental batches (SE1, SE2, PR3, PR4)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..layouts import CDC_COLUMNS


def tag_batch(df: DataFrame, batch_id, batch_col: str = "BatchID",
              drop: Sequence[str] = CDC_COLUMNS) -> DataFrame:
    """Drop the CDC columns (present in incremental batches) and add the batch id."""
    present = [c for c in drop if c in df.columns]
    return df.drop(*present).withColumn(batch_col, F.lit(batch_id))


def union_batches(batches: Sequence[tuple[DataFrame, object]], distinct: bool = False,
                  batch_col: str = "BatchID", drop: Sequence[str] = CDC_COLUMNS) -> DataFrame:
    """UNION ALL (default) or UNION of ``(frame, batch_id)`` pairs, by column name.

    With ``distinct`` the duplicate removal is a hash aggregate whose partial
    step runs before the shuffle, so heavily repeated rows collapse map-side.
    Since the batch id is part of the row, only repeats inside a batch go.
    """
    tagged = [tag_batch(df, bid, batch_col, drop) for df, bid in batches]
    out = reduce(lambda a, b: a.unionByName(b), tagged)
    return out.distinct() if distinct else out
