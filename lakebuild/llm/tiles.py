"""A stated set of vectors against all vectors, in tiles of bounded size.

Both sides are dealt into blocks by a hash of their row; every query block meets every candidate block in a group of its
own. The larger side is copied once per query block, the smaller once per candidate block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiles(queries: DataFrame, rows: DataFrame, n_q: int, n_c: int, by: list[str]):
    """Both sides grouped by (query block, candidate block), for ``applyInArrow``; ``by``: the columns that are hashed."""
    def number(n: int):
        return F.pmod(F.xxhash64(*by), F.lit(n))
    q = queries.select("*", number(n_q).alias("q_block"), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1)).cast("array<long>")).alias("c_block"))
    c = rows.select("*", number(n_c).alias("c_block"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)).cast("array<long>")).alias("q_block"))
    return q.groupBy("q_block", "c_block").cogroup(c.groupBy("q_block", "c_block"))


def matrix(column: pa.ChunkedArray, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) of a list column, rows cut or filled up with zeros to one width (a zero adds nothing)."""
    out = np.zeros((len(column), width))
    at = 0
    for part in column.chunks:
        sizes = part.value_lengths().to_numpy()
        values = np.floor(scale * part.flatten().to_numpy())
        row = at + np.repeat(np.arange(len(part)), sizes)
        col = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        fits = col < width
        out[row[fits], col[fits]] = values[fits]
        at += len(part)
    return out


def longest(table: pa.Table, name: str = "v") -> int:
    """The largest list in a column."""
    return max((int(x.value_lengths().to_numpy().max(initial=0)) for x in table[name].chunks), default=0)
