"""Fixed-width record parsing compiled to Spark column expressions (CO1, CO2, FN1-FN6).

A layout is turned into ONE ``select`` of ``substring``/``trim``/``try_cast``
expressions, so the whole parse stays inside whole-stage codegen; no Python
touches a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..layouts import RECORD_TYPE_SLICE, FieldSpec

_TO_END = 2147483647  # substring length meaning "rest of the line"

# --- The number grammar of the typed parse (the text is trimmed first). ---
#   digits   one or more 0-9; a single "_" may stand between two digits
#   integer  [+-] digits
#   real     [+-] (digits [. [digits]] | . digits) [(e|E) [+-] digits]
#   special  [+-] (inf | infinity | nan), in any case; real fields only
# Anything else is rejected: the value is NULL, and counted on request.
_DIGITS = r"[0-9](?:_?[0-9])*"
INT_PATTERN = rf"^[+-]?{_DIGITS}$"
FLOAT_PATTERN = rf"^[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"
NAN_PATTERN = r"(?i)^[+-]?nan$"
INFINITY_PATTERN = r"(?i)^[+-]?inf(?:inity)?$"
_INT_TYPES = {"tinyint", "smallint", "int", "bigint"}
_FLOAT_TYPES = {"float", "double"}

WHITESPACE = " \t\r\n\f\v"


def slice_field(line: Column, spec: FieldSpec) -> Column:
    """``line[start:end]`` with 0-based half-open bounds; past the end gives ''."""
    length = _TO_END if spec.end is None else spec.end - spec.start
    return F.substring(line, spec.start + 1, length)


def trim_field(c: Column, trim: str = "spaces") -> Column:
    if trim == "spaces":
        return F.trim(c)
    if trim == "whitespace":
        return F.btrim(c, F.lit(WHITESPACE))
    if trim == "none":
        return c
    raise ValueError(f"trim must be spaces|whitespace|none, not {trim!r}")


def tolerant_cast(c: Column, dtype: str) -> Column:
    """Text -> number by the grammar above; blank, other text, and integers beyond the type give NULL."""
    dtype = dtype.lower()
    plain = F.replace(c, F.lit("_"), F.lit(""))
    if dtype in _INT_TYPES:
        return F.when(c.rlike(INT_PATTERN), plain.try_cast(dtype))
    if dtype in _FLOAT_TYPES:
        return (F.when(c.rlike(FLOAT_PATTERN), plain.try_cast(dtype))
                 .when(c.rlike(INFINITY_PATTERN), F.when(c.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))).cast(dtype))
                 .when(c.rlike(NAN_PATTERN), F.lit(float("nan")).cast(dtype)))
    if dtype == "string":
        return c
    return c.try_cast(dtype)


def record_type(line: Column) -> Column:
    return slice_field(line, RECORD_TYPE_SLICE)


def ascii_slicer(line: Column):
    """A field slicer that cuts bytes when the line is pure ASCII.

    Character ``substring`` walks the UTF-8 text from its start for every
    field; on an ASCII line (byte length == character length) a byte slice of
    the binary form gives the same text in O(field width). Other lines keep
    the character slice, so positions always count characters. Codegen's
    common-subexpression elimination computes the binary form and the ASCII
    test once per row.
    """
    raw = line.cast("binary")
    is_ascii = F.octet_length(line) == F.length(line)

    def cut(spec: FieldSpec) -> Column:
        length = _TO_END if spec.end is None else spec.end - spec.start
        return F.when(is_ascii, F.substring(raw, spec.start + 1, length).cast("string")) \
                .otherwise(slice_field(line, spec))
    return cut


def field_columns(line: Column, layout: Sequence[FieldSpec], typed: bool = False,
                  trim: str = "spaces", rejected: str | None = None) -> list[Column]:
    cut = ascii_slicer(line)
    cols, bad = [], []
    for spec in layout:
        text = trim_field(cut(spec), trim)
        number = typed and spec.dtype != "string"
        if number and trim != "whitespace":
            text = trim_field(text, "whitespace")  # white space never decides whether a number is one
        c = tolerant_cast(text, spec.dtype) if number else text
        if rejected and number:
            bad.append(F.when((text != "") & c.isNull(), F.lit(spec.name)))
        cols.append(c.alias(spec.name))
    if rejected:
        cols.append(F.array_compact(F.array(*bad) if bad else F.array().cast("array<string>")).alias(rejected))
    return cols


def parse_fixed_width(df: DataFrame, layout: Sequence[FieldSpec], record_type_code: str | None = None,
                      line_col: str = "value", typed: bool = False, trim: str = "spaces",
                      keep: Sequence[str] = (), rejected: str | None = None) -> DataFrame:
    """Filter one record type and slice every field of ``layout`` out of ``line_col``.

    ``typed=False`` yields all strings (Spark/DuckDB variants); ``typed=True``
    casts to each field's dtype with NULL on blank/bad text (typed variant).
    ``keep`` carries extra input columns (e.g. a file name) through;
    ``rejected`` names an array column that lists, per record, the numeric
    fields whose text was neither blank nor a number.
    """
    line = F.col(line_col)
    if record_type_code is not None:
        df = df.filter(record_type(line) == F.lit(record_type_code))
    return df.select(*[F.col(k) for k in keep], *field_columns(line, layout, typed, trim, rejected))


def rejected_counts(parsed: DataFrame, rejected: str) -> DataFrame:
    """(field, n): how many values each field rejected; one row per field that did."""
    return parsed.select(F.explode(rejected).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))
