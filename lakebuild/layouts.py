"""Record layouts of the FINWIRE fixed-width feed.

A layout is an ordered tuple of ``FieldSpec``; bounds are 0-based and
half-open ``[start, end)``; ``end=None`` means "to the end of the line".
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FieldSpec:
    start: int
    end: int | None
    name: str
    dtype: str = "string"  # Spark SQL type name used by the typed parse

    @property
    def width(self) -> int | None:
        return None if self.end is None else self.end - self.start


# --- Fixed values: FINWIRE record layouts (TPC-DI FINWIRE positions). ---
# The bounds and names must equal the reference feed; dtypes are those of
# its typed variant (tinyint = 8-bit int).
LAYOUT_CMP = (
    FieldSpec(0, 15, "PTS"),
    FieldSpec(15, 18, "RECTYPE"),
    FieldSpec(18, 78, "COMPANY_NAME"),
    FieldSpec(78, 88, "CIK"),
    FieldSpec(88, 92, "STATUS"),
    FieldSpec(92, 94, "INDUSTRY_ID"),
    FieldSpec(94, 98, "SP_RATING"),
    FieldSpec(98, 106, "FOUNDING_DATE"),
    FieldSpec(106, 186, "ADDR1"),
    FieldSpec(186, 266, "ADDR2"),
    FieldSpec(266, 278, "POSTAL_CODE"),
    FieldSpec(278, 303, "CITY"),
    FieldSpec(303, 323, "STATE_PROVINCE"),
    FieldSpec(323, 347, "COUNTRY"),
    FieldSpec(347, 393, "CEO_NAME"),
    FieldSpec(393, 543, "DESCRIPTION"),
)

LAYOUT_SEC = (
    FieldSpec(0, 15, "PTS"),
    FieldSpec(15, 18, "RECTYPE"),
    FieldSpec(18, 33, "SYMBOL"),
    FieldSpec(33, 39, "ISSUE_TYPE"),
    FieldSpec(39, 43, "STATUS"),
    FieldSpec(43, 113, "NAME"),
    FieldSpec(113, 119, "EX_ID"),
    FieldSpec(119, 132, "SH_OUT", "bigint"),
    FieldSpec(132, 140, "FIRST_TRADE_DATE"),
    FieldSpec(140, 148, "FIRST_TRADE_EXCHG"),
    FieldSpec(148, 160, "DIVIDEND", "double"),
    FieldSpec(160, None, "CO_NAME_OR_CIK"),
)

LAYOUT_FIN = (
    FieldSpec(0, 15, "PTS"),
    FieldSpec(15, 18, "RECTYPE"),
    FieldSpec(18, 22, "YEAR", "int"),
    FieldSpec(22, 23, "QUARTER", "tinyint"),
    FieldSpec(23, 31, "QTR_START_DATE"),
    FieldSpec(31, 39, "POSTING_DATE"),
    FieldSpec(39, 56, "REVENUE", "double"),
    FieldSpec(56, 73, "EARNINGS", "double"),
    FieldSpec(73, 85, "EPS", "double"),
    FieldSpec(85, 97, "DILUTED_EPS", "double"),
    FieldSpec(97, 109, "MARGIN", "double"),
    FieldSpec(109, 126, "INVENTORY", "double"),
    FieldSpec(126, 143, "ASSETS", "double"),
    FieldSpec(143, 160, "LIABILITIES", "double"),
    FieldSpec(160, 173, "SH_OUT", "bigint"),
    FieldSpec(173, 186, "DILUTED_SH_OUT", "bigint"),
    FieldSpec(186, None, "CO_NAME_OR_CIK"),
)

# Record-type code at [15, 18) selects the layout.
RECORD_TYPE_SLICE = FieldSpec(15, 18, "RECTYPE")
LAYOUTS = {"CMP": LAYOUT_CMP, "SEC": LAYOUT_SEC, "FIN": LAYOUT_FIN}

# --- Fixed values: column names of the pipe-delimited feeds. ---
INDUSTRY_COLUMNS = ("IN_ID", "IN_NAME", "IN_SC_ID")
DAILY_MARKET_COLUMNS = ("DM_DATE", "DM_S_SYMB", "DM_CLOSE", "DM_HIGH", "DM_LOW", "DM_VOL")
CDC_COLUMNS = ("CDC_FLAG", "CDC_DSN")

# --- Fixed values: investment-grade S&P ratings (anything else is low grade). ---
INVESTMENT_GRADES = ("AAA", "AA", "A", "AA+", "A+", "AA-", "A-", "BBB", "BBB+", "BBB-")

# --- Fixed values: open-ended validity sentinel and timestamp format. ---
OPEN_END = "9999-12-31 00:00:00"
PTS_FORMAT = "yyyyMMdd-HHmmss"
