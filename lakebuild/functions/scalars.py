"""Scalar helpers shared by the operators (FN7-FN14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..layouts import OPEN_END, PTS_FORMAT


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_timestamp(c: str | Column, fmt: str = PTS_FORMAT, on_error: str = "fail") -> Column:
    """Text -> ``timestamp_ntz`` (no session-zone shift).

    ``on_error="fail"`` raises on malformed text (ANSI); ``"null"`` yields NULL.
    """
    c = col_of(c)
    parsed = F.to_timestamp_ntz(c, F.lit(fmt))
    if on_error == "fail":
        return parsed
    if on_error == "null":
        # try_to_timestamp only decides validity; the value comes from the
        # zone-free NTZ parser, which CASE evaluates for valid rows only.
        return F.when(F.try_to_timestamp(c, F.lit(fmt)).isNotNull(), parsed)
    raise ValueError(f"on_error must be fail|null, not {on_error!r}")


def parse_date(c: str | Column, fmt: str | None = None, on_error: str = "fail") -> Column:
    c = col_of(c)
    if on_error == "fail":
        return F.to_date(c, fmt) if fmt else F.to_date(c)
    if on_error == "null":
        return F.try_to_date(c, fmt) if fmt else F.try_to_date(c)
    raise ValueError(f"on_error must be fail|null, not {on_error!r}")


def open_end() -> Column:
    """The ``9999-12-31 00:00:00`` end of a still-valid version."""
    return F.lit(OPEN_END).cast("timestamp_ntz")


def concat_keys(*cols: str | Column, skip_nulls: bool = False) -> Column:
    """Key concatenation: NULL if any part is NULL, or NULL parts skipped."""
    cs = [col_of(c) for c in cols]
    return F.concat_ws("", *cs) if skip_nulls else F.concat(*cs)


def version_key(pts: str | Column, entity_id: str | Column) -> Column:
    """Version key: the PTS digits without '-' followed by the entity id."""
    return F.concat(F.regexp_replace(col_of(pts), "-", ""), col_of(entity_id))


def iso_text(ts: str | Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text of a ``timestamp_ntz``.

    A plain cast: unlike ``date_format`` it does not pass through the session
    time zone, so wall times inside a DST gap are printed unchanged.
    """
    return col_of(ts).cast("timestamp_ntz").cast("string")


def compact_stamp(ts: str | Column) -> Column:
    """``yyyyMMdd-HHmmss`` text of a ``timestamp_ntz`` (zone-free)."""
    t = iso_text(ts)
    return F.concat(F.substring(t, 1, 4), F.substring(t, 6, 2), F.substring(t, 9, 2), F.lit("-"),
                    F.substring(t, 12, 2), F.substring(t, 15, 2), F.substring(t, 18, 2))


def compact_date(d: str | Column) -> Column:
    """``yyyyMMdd`` text of a date or ``timestamp_ntz`` (zone-free)."""
    return F.regexp_replace(F.to_date(col_of(d)).cast("string"), "-", "")
