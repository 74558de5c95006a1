"""SCD type 2 validity intervals (WI1-WI3, FI6, FN8, FN11).

``end = next version's start`` per key (LEAD over the key ordered by the start
and the tie-break columns), ``end = 9999-12-31`` for the last version, and
``iscurrent = (end == 9999-12-31)``.

Two physical shapes, same result:

* ``split=None`` - one Exchange(key) + Sort + Window. A key's whole history
  lands in one task.
* ``split="day"`` (default) - boundary propagation by aggregates; no window
  ever sees a wide row. A version that is not the last of those sharing its
  (key, start) ends where it starts, so only two facts are needed per (key,
  start): which row is its last, and the key's next start.

  1. Equal rows are folded into one row with a count; everything after reads
     this one shuffle, so the source is scanned once.
  2. Per (key, start), how many folded rows share it. Only where it is more
     than one, the last of them by the tie-break (``max_by``, partial before
     the shuffle): a third of all rows on one (key, start) meets as one row per
     task. A start of its own, the usual case, moves no wide column for this.
  3. Next starts over the distinct starts only: within a (key, segment) by a
     narrow window, from segment to segment by ``min(start)`` per (key,
     segment). A hot key is spread over its segments.
  4. The rows take both by one join on (key, start) that sits on two plain
     shuffles, so AQE splits a hot pair. What only serves the join (encoded
     keys, the rows' marks) is worked out beside it and not shuffled; the rows
     that share a start are picked from the same shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import open_end
from .lookup import explode_copies

_SPLITS = {
    "day": lambda ts: F.unix_date(F.to_date(ts)),
    "hour": lambda ts: F.unix_date(F.to_date(ts)) * 24 + F.hour(ts),
    "month": lambda ts: F.year(ts) * 12 + F.month(ts),
    "year": lambda ts: F.year(ts),
}
_LOWEST_SEGMENT = -(2 ** 62)  # segment code for NULL starts (they sort first)
# Segment codes must not decrease as the start grows; all are computed on the
# wall-clock value (no session time zone involved).


def _order(ts: str, order_by: Sequence[str]) -> list[Column]:
    return [F.col(ts).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order_by]]


def _null_free_keys(df: DataFrame, keys: Sequence[str]) -> list[tuple[str, Column]]:
    """Encode possibly-NULL keys as (null bitmask, coalesced values) so that a
    plain equi-join groups exactly like a window's PARTITION BY."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    mask = F.lit(0)
    out = []
    for i, k in enumerate(keys):
        mask = mask + F.when(F.col(k).isNull(), F.lit(1 << i)).otherwise(F.lit(0))
        out.append((f"__k{i}", F.coalesce(F.col(k), _zero(types[k]))))
    return [("__kmask", mask), *out]


def _zero(t: T.DataType) -> Column:
    if isinstance(t, T.StringType):
        return F.lit("")
    if isinstance(t, T.BooleanType):
        return F.lit(False)
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(t)
    return F.lit(0).cast(t)


def with_validity(df: DataFrame, key: str | Sequence[str], start: str,
                  order_by: Sequence[str] = (), end: str = "end_timestamp",
                  current: str = "iscurrent", split: str | None = "day",
                  copies: str | None = None, derived: Mapping[str, Column] | None = None) -> DataFrame:
    """Append ``end`` and ``current`` columns describing each version's interval.

    ``order_by`` must name every column in which versions with the same start
    can differ, so that ties are broken the same way by every engine.

    ``copies`` names a column saying how many identical copies a row stands
    for (e.g. a lookup fan-out). Identical copies sort next to each other, so
    all but the last get an empty interval ``[start, start)`` and the last
    gets the row's real end: the intervals are found on the distinct rows and
    the copies are only materialised in the output.

    ``derived`` are further columns, worked out from those of ``df``; they
    come after these, ``order_by`` may name them, and no shuffle carries them.
    """
    keys = [key] if isinstance(key, str) else list(key)
    derived = dict(derived or {})
    if split is None:
        df = df.select(*[c for c in df.columns if c != copies], *[c.alias(n) for n, c in derived.items()], *([copies] if copies else []))
        if copies:
            df = explode_copies(df, copies).drop("__copy", copies)
        w = Window.partitionBy(*keys).orderBy(*_order(start, [c for c in order_by if c != copies]))
        out = df.withColumn(end, F.coalesce(F.lead(start, 1).over(w), open_end()))
        return out.withColumn(current, F.col(end) == open_end())
    if split not in _SPLITS:
        raise ValueError(f"split must be None or one of {sorted(_SPLITS)}")

    cols = [c for c in df.columns if c != copies]
    order_by = [c for c in order_by if c != copies]
    folded = df.groupBy(*cols).agg((F.sum(copies) if copies else F.count(F.lit(1))).cast("long").alias("__n"))
    kx = _null_free_keys(df, [*keys, start])
    names = [n for n, _ in kx]
    encoded = [c.alias(n) for n, c in kx]
    same_start = reduce(and_, [c == F.col(n) for n, c in kx])
    # A row's own mark among those that share (key, start); the count is part of it.
    mark = F.struct(F.xxhash64(*cols, "__n"), F.xxhash64(F.lit(1), *cols, "__n"))

    # (the filter, true of every pair, keeps all three in all readers of the folded rows and the pairs, so that each is one shuffle)
    pairs = folded.groupBy(*encoded).agg(F.count(F.lit(1)).alias("__rows"), F.max("__n").alias("__most"), F.max(start).alias(start)) \
                  .filter((F.col("__rows") > 0) | F.col("__most").isNotNull() | F.col(start).isNotNull())
    tied = pairs.filter(F.col("__rows") > 1).select(*names)
    tie_break = F.struct(*[derived[c].alias(c) if c in derived else F.col(c) for c in order_by], mark.alias("__mark"))
    last = folded.join(tied, same_start, "left_semi").groupBy(*encoded).agg(F.max_by(mark, tie_break).alias("__last"))
    seg = F.coalesce(_SPLITS[split](F.col(start)).cast("long"), F.lit(_LOWEST_SEGMENT))
    by_key = [n for n in names if n != names[-1] and n != "__kmask"]
    # keys compare by value and by which of them are NULL; a NULL start is its own segment
    key_mask = F.col("__kmask").bitwiseAND(F.lit((1 << len(keys)) - 1))
    pairs = pairs.withColumns({"__keymask": key_mask, "__seg": seg})
    segment = Window.partitionBy("__keymask", *by_key, "__seg").orderBy(F.col(start).asc_nulls_first())
    local = pairs.join(last, names, "left").withColumn("__next", F.lead(start, 1).over(segment))
    firsts = pairs.groupBy("__keymask", *by_key, "__seg").agg(F.min(start).alias("__first"))
    onward = Window.partitionBy("__keymask", *by_key).orderBy("__seg")
    nexts = firsts.select("__keymask", *by_key, "__seg", F.lead("__first", 1).over(onward).alias("__later"))
    found = local.join(nexts, ["__keymask", *by_key, "__seg"], "left") \
                 .select(*names, "__last", F.coalesce("__next", "__later", open_end()).alias("__end"))

    joined = folded.join(found, same_start).withColumn("__at_end", F.col("__last").isNull() | (mark == F.col("__last")))
    earlier = F.coalesce(F.col(start), open_end())  # as LEAD onto a row with the same start would give
    out = explode_copies(joined.withColumns(derived) if derived else joined, "__n")
    is_last = F.col("__at_end") & (F.col("__copy") == F.col("__n"))
    out = out.select(*cols, *derived, F.when(is_last, F.col("__end")).otherwise(earlier).alias(end))
    return out.withColumn(current, F.col(end) == open_end())


def current_only(df: DataFrame, current: str = "iscurrent") -> DataFrame:
    return df.filter(F.col(current))


def as_of(df: DataFrame, at: Column, start: str = "effective_timestamp",
          end: str = "end_timestamp") -> DataFrame:
    """Versions valid at the instant ``at`` (half-open ``[start, end)``)."""
    return df.filter((F.col(start) <= at) & (at < F.col(end)))
