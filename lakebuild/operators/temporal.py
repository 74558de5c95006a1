"""Point-in-time (temporal validity) join (JO4, FI2, FN12, FN14).

Each fact row meets the dimension version whose half-open interval
``[start, end)`` holds the fact's instant. The instant may be a DATE; it is
then compared as midnight (a version starting at 10:00 on day D applies from
D+1), as in the reference.

Plan (``period="year"``, the default): a period-segmented interval join.
Facts carry the period of their instant. One narrow aggregation over the facts
(two columns, sets combined on the map side) gives the periods each key really
has; every version is copied to those of them that its interval touches, and
facts and versions meet on (key, period) with the range as a residual. For a
history that tiles, a key's copies number its versions plus its periods, and a
fact is compared only with the versions alive in its own period, however long
the key's history is. The join sits on two plain shuffles, so AQE splits a hot
(key, period), and a hot key is spread over its periods to begin with.

A finer period means fewer versions to compare and more copies of the versions
that outlive it; ``year`` suits dimensions that change a few times a year per
key, ``month`` or ``day`` histories that change by the day or the hour.

Versions that can match nothing are dropped before any shuffle: empty
intervals (``start >= end``, produced by history fan-out) and, for DATE
instants, intervals that hold no midnight - which leaves a tiling history at
most one version per day.

``period=None`` joins on the key alone: one pass over the facts, each compared
with all versions of its key. It suits short histories, and is the only form
for a streaming fact side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Period codes; none decreases as the instant grows, none involves the session time zone.
PERIODS = {
    "day": lambda ts: F.unix_date(F.to_date(ts)),
    "month": lambda ts: F.year(ts) * 12 + F.month(ts),
    "year": lambda ts: F.year(ts),
}


def _holds_midnight(start: str, end: str) -> Column:
    day = F.to_date(start)
    first = F.when(day.cast("timestamp_ntz") == F.col(start), day).otherwise(F.date_add(day, 1))
    return first.cast("timestamp_ntz") < F.col(end)


def point_in_time_join(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, at: Column | str,
                       dim_cols: Sequence[str | Column] = (), start: str = "effective_timestamp",
                       end: str = "end_timestamp", how: str = "inner",
                       period: str | None = "year") -> DataFrame:
    """Join facts to the version valid at ``at``; ``how`` is inner or left.

    The result does not depend on ``period`` (None, day, month or year), which
    only sets how finely a key's history is cut. ``at`` given as the name of a
    fact column is not copied, so the facts' shuffle carries it once.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner|left")
    if period is not None and period not in PERIODS:
        raise ValueError(f"period must be None or one of {sorted(PERIODS)}")
    f, instant = (facts, at) if isinstance(at, str) else (facts.withColumn("__pit_at", at), "__pit_at")
    live = dim.filter(F.col(start) < F.col(end))
    if isinstance(f.schema[instant].dataType, T.DateType):
        live = live.filter(_holds_midnight(start, end))
    d = live.select(F.col(dim_key).alias("__pit_key"), F.col(start).alias("__pit_s"),
                    F.col(end).alias("__pit_e"), *dim_cols)
    if period is None:
        cond = f[fact_key] == d["__pit_key"]
    else:
        code = PERIODS[period]
        f = f.withColumn("__pit_p", code(F.col(instant)))
        seen = f.filter(F.col(fact_key).isNotNull() & F.col("__pit_p").isNotNull()) \
                .groupBy(F.col(fact_key).alias("__pit_seen")).agg(F.collect_set("__pit_p").alias("__pit_ps"))
        first, last = code(F.col("__pit_s")), code(F.col("__pit_e") - F.expr("INTERVAL '0.000001' SECOND"))
        d = (d.join(seen, F.col("__pit_key") == F.col("__pit_seen"))
              .withColumns({"__pit_first": first, "__pit_last": last})
              .withColumn("__pit_dp", F.explode(F.filter("__pit_ps", lambda p: p.between(F.col("__pit_first"), F.col("__pit_last")))))
              .drop("__pit_seen", "__pit_ps", "__pit_first", "__pit_last"))
        cond = (f[fact_key] == d["__pit_key"]) & (f["__pit_p"] == d["__pit_dp"])
    cond &= (f[instant] >= d["__pit_s"]) & (f[instant] < d["__pit_e"])
    return f.join(d, cond, how).drop("__pit_key", "__pit_s", "__pit_e", "__pit_at", "__pit_p", "__pit_dp")
