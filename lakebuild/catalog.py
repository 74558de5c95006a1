"""The query catalogue: one entry per operator / pipeline of the survey (section 7.3).

Every entry takes ``(spark, sf_dir)``, derives its raw-shaped input from the
test tables with Spark (``fixtures``) and returns a lazy DataFrame. Columns
holding the open-ended ``9999-12-31`` validity end are rendered as ISO text
(``iso_text``) because pandas datetimes cannot hold that year.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import iso_text, parse_fixed_width, parse_timestamp, rejected_counts
from .functions.scalars import concat_keys, version_key
from .layouts import DAILY_MARKET_COLUMNS, INDUSTRY_COLUMNS, LAYOUTS, LAYOUT_CMP, LAYOUT_FIN, LAYOUT_SEC
from .operators import is_low_grade, point_in_time_join, resolve_reference, union_batches, with_validity
from .paths import LakePaths
from .plans import pipelines as pl
from .session import scratch_path
from .sinks import register_views, write_split, write_table
from .sources import read_delimited, read_lines, read_market_batch, read_table, split_corrupt
from .views import register_history, register_resolution

Query = Callable[[SparkSession, str], DataFrame]


def _portable(df: DataFrame, cols=("end_timestamp",)) -> DataFrame:
    return df.withColumns({c: iso_text(c) for c in cols if c in df.columns})


# ------------------------------------------------------------ shared inputs
# The raw layer (text files) is written once per process from the test tables;
# staging queries read it back through the library's own readers, the others
# start from the bronze and silver tables that the library's steps make of it.
def _raw(spark, sf, *feeds):
    return fx.write_raw(spark, sf, feeds=feeds)


def _lines(spark, sf):
    return read_lines(spark, _raw(spark, sf, "finwire").raw(pl.FINWIRE_GLOB), name_regex=pl.FINWIRE_REGEX)


def _parsed(spark, sf, rt, typed=False):
    """A record type cut straight from the raw lines."""
    return parse_fixed_width(_lines(spark, sf), LAYOUTS[rt], rt, typed=typed)


_LAKES: dict[tuple[str, str], tuple[LakePaths, set[str]]] = {}

# The step of the library that writes a table, and the steps before it that it reads from.
_STEP_OF = {"industry": "industry", "finwire_cmp": "finwire", "finwire_sec": "finwire", "finwire_fin": "finwire",
            "dimcompany": "dim_company", "dimsecurity": "dim_security"}
_BEFORE = {"industry": (), "finwire": (), "dim_company": ("industry", "finwire"),
           "dim_security": ("industry", "finwire", "dim_company")}


def _lake(spark, sf, step) -> LakePaths:
    """Bronze and silver up to ``step``, each table written once per process by the library's own step; a query
    starts from the layer below its own, and only the steps that lead there are run for it."""
    raw = _raw(spark, sf)
    if (sf, raw.root) not in _LAKES:
        _LAKES[sf, raw.root] = LakePaths(scratch_path(spark, "catalog-lake", unique=True), raw_root=raw.root), set()
    lake, done = _LAKES[sf, raw.root]
    steps = [s for s in (*_BEFORE[step], step) if s not in done]
    if steps:
        _raw(spark, sf, *[s for s in steps if s in fx.FEEDS])
        pl.run_all(spark, lake, steps=steps)
        done.update(steps)
    return lake


def _bronze(spark, sf, name):
    return read_table(spark, _lake(spark, sf, _STEP_OF[name]).bronze(name))


def _silver(spark, sf, name):
    return read_table(spark, _lake(spark, sf, _STEP_OF[name]).silver(name))


def _industry(spark, sf):
    return _bronze(spark, sf, "industry")


def _cmp(spark, sf):
    return _bronze(spark, sf, "finwire_cmp")


def _sec(spark, sf):
    return _bronze(spark, sf, "finwire_sec")


def _fin(spark, sf):
    return _bronze(spark, sf, "finwire_fin")


def _market(spark, sf, distinct=False, redelivered=False):
    batches = pl.market_batches(spark, _raw(spark, sf, "market"))
    if redelivered:  # batch 1 delivered twice: the repeats a UNION must remove
        batches.insert(1, batches[0])
    return union_batches(batches, distinct=distinct)


# ------------------------------------------------------------ sources / sinks
def q_stg_industry(spark, sf):
    paths = _raw(spark, sf, "industry")
    return read_delimited(spark, paths.batch(1, "Industry.txt"), INDUSTRY_COLUMNS)


def q_scan_lines_by_pattern(spark, sf):
    paths = _raw(spark, sf, "finwire")
    return read_lines(spark, paths.raw(pl.FINWIRE_GLOB), name_regex=pl.FINWIRE_REGEX,
                      with_source=True, line_col="line")


def q_incremental_batch(spark, sf):
    paths = _raw(spark, sf, "market")
    return read_market_batch(spark, paths.batch(2, "DailyMarket.txt"), incremental=True)


def q_split_by_record_type(spark, sf):
    """Four tables from one feed: the record types and, as type NULL, the lines of no known type."""
    paths = _raw(spark, sf, "finwire")
    out = scratch_path(spark, "split", unique=True)
    lines = read_lines(spark, paths.raw(pl.FINWIRE_GLOB), name_regex=pl.FINWIRE_REGEX)
    targets = {"CMP": (LAYOUT_CMP, f"{out}/cmp"), "SEC": (LAYOUT_SEC, f"{out}/sec"),
               "FIN": (LAYOUT_FIN, f"{out}/fin")}
    write_split(lines, targets, staging=f"{out}/_by_type", rejects=f"{out}/rejects")
    keys = {"CMP": "CIK", "SEC": "SYMBOL", "FIN": "CO_NAME_OR_CIK"}
    parts = [read_table(spark, f"{out}/{rt.lower()}").select("RECTYPE", "PTS", F.col(k).alias("record_key"))
             for rt, k in keys.items()]
    null = F.lit(None).cast("string")
    rejects = read_table(spark, f"{out}/rejects").select(null.alias("RECTYPE"), null.alias("PTS"), F.col("line").alias("record_key"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(rejects)


def q_table_overwrite(spark, sf):
    path = scratch_path(spark, "overwrite", unique=True)
    ind = fx.industry_feed(spark, sf)
    write_table(ind.select(F.lower("IN_ID").alias("IN_ID"), F.lower("IN_NAME").alias("IN_NAME"),
                           F.lit("old").alias("IN_SC_ID")), path)
    write_table(ind, path, mode="overwrite")
    return read_table(spark, path)


def q_table_append(spark, sf):
    """Rows appended to the published version of a table that was overwritten before."""
    path = scratch_path(spark, "append", unique=True)
    ind = fx.industry_feed(spark, sf)
    write_table(ind.select("IN_ID", "IN_NAME", F.lit("old").alias("IN_SC_ID")), path)
    write_table(ind, path)
    write_table(ind.select("IN_ID", F.lower("IN_NAME").alias("IN_NAME"), "IN_SC_ID"), path, mode="append")
    return read_table(spark, path)


def q_fact_partition_read(spark, sf):
    path = scratch_path(spark, "fact-by-year", unique=True)
    fact = pl.build_fact_market_history(_market(spark, sf), _silver(spark, sf, "dimsecurity"))
    write_table(fact, path, partition_by=["YearID"])
    return read_table(spark, path).filter(F.col("YearID") == 1997)


def q_market_typed(spark, sf):
    """V11: a delimited feed read with an explicit schema (batch 1)."""
    types = {"DM_DATE": "date", "DM_CLOSE": "decimal(15,2)", "DM_HIGH": "decimal(15,2)", "DM_LOW": "decimal(15,2)", "DM_VOL": "bigint"}
    df = read_delimited(spark, _raw(spark, sf, "market").batch(1, "DailyMarket.txt"), DAILY_MARKET_COLUMNS, types=types)
    return df.select(F.col("DM_DATE").cast("string").alias("DM_DATE"), "DM_S_SYMB",
                     *[(F.col(c) * 100).cast("bigint").alias(c + "_CENTS") for c in ("DM_CLOSE", "DM_HIGH", "DM_LOW")], "DM_VOL")


def q_market_quarantine(spark, sf):
    """SC5: the market lines without exactly the expected fields, whole, by batch."""
    batches = pl.market_batches(spark, _raw(spark, sf, "market"), corrupt="line")
    return split_corrupt(union_batches(batches), "line")[1].select("BatchID", "line")


# ------------------------------------------------------------ parsing
def q_stg_finwire_cmp(spark, sf):
    return _parsed(spark, sf, "CMP")


def q_stg_finwire_sec(spark, sf):
    return _parsed(spark, sf, "SEC")


def q_stg_finwire_fin(spark, sf):
    return _parsed(spark, sf, "FIN")


def _spelled(df):
    """NaN and infinities as text: DataFrames outside Spark confuse NaN with NULL."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    odd = {c: F.isnan(c) | (F.abs(c) == float("inf")) for c in doubles}
    named = F.concat_ws(",", *[F.when(odd[c], F.concat(F.lit(c + "="), F.col(c).cast("string"))) for c in doubles])
    return df.withColumns({"nonfinite": named} | {c: F.when(~odd[c], F.col(c)) for c in doubles})


def q_stg_finwire_sec_typed(spark, sf):
    return _parsed(spark, sf, "SEC", typed=True)


def q_stg_finwire_fin_typed(spark, sf):
    return _spelled(_parsed(spark, sf, "FIN", typed=True))


def q_finwire_rejected_values(spark, sf):
    """FN5, FN6: how many texts of each numeric field were neither blank nor a number."""
    lines = _lines(spark, sf)
    sec, fin = (rejected_counts(parse_fixed_width(lines, lay, rt, typed=True, rejected="bad"), "bad").withColumn("RECTYPE", F.lit(rt))
                for rt, lay in (("SEC", LAYOUT_SEC), ("FIN", LAYOUT_FIN)))
    return sec.unionByName(fin)


def q_stg_finwire_cmp_untrimmed(spark, sf):
    """FN3: fields as they stand in the record."""
    return parse_fixed_width(_lines(spark, sf), LAYOUT_CMP, "CMP", trim="none")


def q_stg_finwire_cmp_stripped(spark, sf):
    """FN3: all white space cut, tabs included; the feed's tabs are put in here."""
    lines = _lines(spark, sf).withColumn("value", F.regexp_replace("value", " Market Street", "\tMarket Street\t"))
    return parse_fixed_width(lines, LAYOUT_CMP, "CMP", trim="whitespace").select("PTS", "CIK", "ADDR1")


# ------------------------------------------------------------ joins, flags, keys
def _company_industry(spark, sf, how):
    cmp = _cmp(spark, sf)
    ind = _industry(spark, sf).select(F.col("IN_ID"), F.col("IN_NAME"))
    return (cmp.join(ind, cmp["INDUSTRY_ID"] == ind["IN_ID"], how)
               .select("PTS", "CIK", "COMPANY_NAME", "INDUSTRY_ID", "IN_NAME"))


def q_company_industry_inner(spark, sf):
    return _company_industry(spark, sf, "inner")


def q_company_industry_left(spark, sf):
    return _company_industry(spark, sf, "left")


def q_low_grade_flag(spark, sf):
    return _cmp(spark, sf).select("PTS", "CIK", "SP_RATING", is_low_grade("SP_RATING").alias("isLowgrade"))


def q_company_version_key(spark, sf):
    return _cmp(spark, sf).select("PTS", "CIK", version_key("PTS", "CIK").alias("sku_company_id"))


def q_history_validity(spark, sf):
    o = fx.table(spark, sf, "orders").select("o_custkey", "o_orderkey",
                                             F.col("o_orderdate").alias("effective_timestamp"))
    return _portable(with_validity(o, "o_custkey", "effective_timestamp", ["o_orderkey"]))


# ------------------------------------------------------------ lookups
def _lookup(spark, sf, versions):
    sec = _sec(spark, sf)
    at = parse_timestamp("PTS")
    r = resolve_reference(sec, "CO_NAME_OR_CIK", _silver(spark, sf, "dimcompany"), "Companyid", "Name",
                          out="SK_CompanyID", versions=versions, at=at)
    return r.select("PTS", "SYMBOL", "CO_NAME_OR_CIK", "SK_CompanyID")


def q_lookup_all_versions(spark, sf):
    return _lookup(spark, sf, "all")


def q_lookup_current(spark, sf):
    return _lookup(spark, sf, "current")


def q_lookup_as_of(spark, sf):
    return _lookup(spark, sf, "as_of")


def _security_key(spark, sf, skip_nulls):
    r = resolve_reference(_sec(spark, sf), "CO_NAME_OR_CIK", _silver(spark, sf, "dimcompany"), "Companyid", "Name",
                          out="SK_CompanyID", versions="current")
    return r.select("PTS", "SYMBOL", "SK_CompanyID",
                    concat_keys("SYMBOL", "EX_ID", "SK_CompanyID", skip_nulls=skip_nulls).alias("SK_SecurityID"))


def q_security_key_null(spark, sf):
    return _security_key(spark, sf, False)


def q_security_key_skip_null(spark, sf):
    return _security_key(spark, sf, True)


# ------------------------------------------------------------ pipelines
def q_dim_company(spark, sf):
    return _portable(pl.build_dim_company(_cmp(spark, sf), _industry(spark, sf)))


def q_dim_company_left(spark, sf):
    return _portable(pl.build_dim_company(_cmp(spark, sf), _industry(spark, sf), how="left"))


def q_dim_security(spark, sf):
    return _portable(pl.build_dim_security(_sec(spark, sf), _silver(spark, sf, "dimcompany")))


def q_financial(spark, sf):
    return pl.build_financial(_fin(spark, sf), _silver(spark, sf, "dimcompany"))


def q_financial_typed(spark, sf):
    return _spelled(pl.build_financial(_parsed(spark, sf, "FIN", typed=True), _silver(spark, sf, "dimcompany")))


def q_market_union_all(spark, sf):
    return _market(spark, sf)


def q_market_union_distinct(spark, sf):
    return _market(spark, sf, distinct=True, redelivered=True)


def _pit(spark, sf, how):
    day = F.to_date("DM_DATE")
    j = point_in_time_join(_market(spark, sf), _silver(spark, sf, "dimsecurity"), "DM_S_SYMB", "SYMBOL", at=day,
                           dim_cols=["SK_SecurityID", "SK_CompanyID"], how=how)
    return j.select("DM_DATE", "DM_S_SYMB", "BatchID", "DM_CLOSE", "SK_SecurityID", "SK_CompanyID")


def q_point_in_time_inner(spark, sf):
    return _pit(spark, sf, "inner")


def q_point_in_time_left(spark, sf):
    return _pit(spark, sf, "left")


def q_fact_market_history(spark, sf):
    return pl.build_fact_market_history(_market(spark, sf), _silver(spark, sf, "dimsecurity"))


def q_fact_market_history_left(spark, sf):
    """V17: keep market rows without a valid security version (NULL keys)."""
    return pl.build_fact_market_history(_market(spark, sf), _silver(spark, sf, "dimsecurity"), how="left")


def q_fact_market_history_distinct(spark, sf):
    """V3: batches combined with UNION (batch 1 delivered twice)."""
    return pl.build_fact_market_history(_market(spark, sf, distinct=True, redelivered=True),
                                        _silver(spark, sf, "dimsecurity"))


def q_dim_security_current(spark, sf):
    """V15 alternative: securities keyed to the current company version only."""
    return _portable(pl.build_dim_security(_sec(spark, sf), _silver(spark, sf, "dimcompany"), versions="current"))


def q_financial_as_of(spark, sf):
    """V15 alternative: figures keyed to the company version valid at the record stamp."""
    return pl.build_financial(_fin(spark, sf), _silver(spark, sf, "dimcompany"), versions="as_of")


def q_sql_view_dim_security(spark, sf):
    """dim_security in Spark SQL over named views (SK4, PR6): one lookup join, then the history view."""
    register_views(spark, finwire_sec=_sec(spark, sf), dimcompany=_silver(spark, sf, "dimcompany"))
    register_resolution(spark, "company_resolution", "dimcompany", "Companyid", "Name")
    keyed = spark.sql("""
        SELECT r.hit AS SK_CompanyID, SYMBOL || EX_ID || SK_CompanyID AS SK_SecurityID,  -- lateral alias
               SYMBOL, ISSUE_TYPE AS Issue, STATUS, NAME, EX_ID AS ExchangeID, SH_OUT AS SharesOutstanding,
               FIRST_TRADE_DATE AS FirstTrade, FIRST_TRADE_EXCHG AS FirstTradeOnExchange, DIVIDEND, 1 AS BatchID,
               to_timestamp_ntz(PTS, 'yyyyMMdd-HHmmss') AS effective_timestamp, nvl(r.copies, 1L) AS copies
        FROM finwire_sec LEFT JOIN company_resolution r ON r.value = CO_NAME_OR_CIK""")
    register_views(spark, security_versions=keyed)
    register_history(spark, "security_history", "security_versions", "SYMBOL", "effective_timestamp",
                     pl.SECURITY_TIEBREAK, copies="copies")
    return _portable(spark.sql("SELECT * FROM security_history"))


def q_run_all(spark, sf):
    """PL1-PL6 end to end through files: raw text -> bronze -> silver."""
    raw = fx.write_raw(spark, sf)
    lake = LakePaths(scratch_path(spark, "lake", unique=True), raw_root=raw.root)
    out = pl.run_all(spark, lake)
    return read_table(spark, out["FactMarketHistory"])


def q_run_all_options(spark, sf):
    """PL1-PL6 with every other choice: company as of the record, unmatched market rows kept,
    NULL-skipping keys, text placeholders, malformed market lines in quarantine."""
    raw = fx.write_raw(spark, sf)
    lake = LakePaths(scratch_path(spark, "lake", unique=True), raw_root=raw.root)
    out = pl.run_all(spark, lake, versions="as_of", fact_how="left", skip_nulls=True, on_error="null", split="month",
                     period="month", trim="whitespace", quarantine=True, placeholders="text",
                     batch_files={n: raw.batch(n, "DailyMarket.txt") for n in (1, 2, 3)})
    return read_table(spark, out["FactMarketHistory"])


def q_dim_security_skip_nulls(spark, sf):
    """V4: the security key leaves out a missing company instead of being NULL."""
    return _portable(pl.build_dim_security(_sec(spark, sf), _silver(spark, sf, "dimcompany"), skip_nulls=True))


def q_parse_timestamp_null(spark, sf):
    """FN7 with on_error="null" over every line of the feed, junk included."""
    line = F.col("value")
    stamp = F.substring(line, 1, 15)
    return _lines(spark, sf).select(stamp.alias("stamp"), parse_timestamp(stamp, on_error="null").alias("ts"))


def q_fact_market_stream(spark, sf):
    """PL6 as an incremental Structured Streaming load over the batch files."""
    from .streaming import stream_fact_market_history
    raw = _raw(spark, sf, "market")
    base = scratch_path(spark, "stream", unique=True)
    write_table(_silver(spark, sf, "dimsecurity"), f"{base}/dimsecurity")
    stream_fact_market_history(spark, raw.raw("Batch*/DailyMarket.txt"), f"{base}/dimsecurity", f"{base}/fact",
                               checkpoint=f"{base}/_checkpoint")
    return read_table(spark, f"{base}/fact").drop("load")


QUERIES: dict[str, Query] = {
    "stg_industry": q_stg_industry,
    "scan_lines_by_pattern": q_scan_lines_by_pattern,
    "stg_finwire_cmp": q_stg_finwire_cmp,
    "stg_finwire_sec": q_stg_finwire_sec,
    "stg_finwire_fin": q_stg_finwire_fin,
    "stg_finwire_sec_typed": q_stg_finwire_sec_typed,
    "stg_finwire_fin_typed": q_stg_finwire_fin_typed,
    "split_by_record_type": q_split_by_record_type,
    "company_industry_inner": q_company_industry_inner,
    "company_industry_left": q_company_industry_left,
    "low_grade_flag": q_low_grade_flag,
    "company_version_key": q_company_version_key,
    "history_validity": q_history_validity,
    "dim_company": q_dim_company,
    "dim_company_left": q_dim_company_left,
    "lookup_all_versions": q_lookup_all_versions,
    "lookup_current": q_lookup_current,
    "lookup_as_of": q_lookup_as_of,
    "security_key_null": q_security_key_null,
    "security_key_skip_null": q_security_key_skip_null,
    "dim_security": q_dim_security,
    "financial": q_financial,
    "financial_typed": q_financial_typed,
    "incremental_batch": q_incremental_batch,
    "market_union_all": q_market_union_all,
    "market_union_distinct": q_market_union_distinct,
    "point_in_time_inner": q_point_in_time_inner,
    "point_in_time_left": q_point_in_time_left,
    "fact_market_history": q_fact_market_history,
    "fact_market_history_left": q_fact_market_history_left,
    "fact_market_history_distinct": q_fact_market_history_distinct,
    "dim_security_current": q_dim_security_current,
    "financial_as_of": q_financial_as_of,
    "fact_partition_read": q_fact_partition_read,
    "table_overwrite": q_table_overwrite,
    "sql_view_dim_security": q_sql_view_dim_security,
    "dim_security_skip_nulls": q_dim_security_skip_nulls,
    "finwire_rejected_values": q_finwire_rejected_values,
    "stg_finwire_cmp_untrimmed": q_stg_finwire_cmp_untrimmed,
    "stg_finwire_cmp_stripped": q_stg_finwire_cmp_stripped,
    "parse_timestamp_null": q_parse_timestamp_null,
    "market_typed": q_market_typed,
    "market_quarantine": q_market_quarantine,
    "table_append": q_table_append,
    "run_all_options": q_run_all_options,
    "run_all": q_run_all,
    "fact_market_stream": q_fact_market_stream,
}
