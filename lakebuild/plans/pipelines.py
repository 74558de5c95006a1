"""The six medallion steps (PL1-PL6).

``build_*`` functions take and return DataFrames: no I/O, no action. The
``stage_*`` / ``run_all`` functions do the reading and writing.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import compact_stamp, concat_keys, parse_date, parse_timestamp, version_key
from ..layouts import INDUSTRY_COLUMNS, LAYOUT_CMP, LAYOUT_FIN, LAYOUT_SEC
from ..operators.batches import union_batches
from ..operators.flags import is_low_grade
from ..operators.history import with_validity
from ..operators.lookup import resolve_reference
from ..operators.temporal import point_in_time_join
from ..paths import LakePaths
from ..sinks import write_split, write_table
from ..sources import list_matching, read_delimited, read_lines, read_market_batch, read_table, split_corrupt

FINWIRE_GLOB = "Batch*/FINWIRE*Q[1-4]"
FINWIRE_REGEX = r"FINWIRE\d{4}Q[1-4]\b"

# Tie-breaks for versions that share a start: every output column in which
# two such versions can differ, so all engines order them the same way.
COMPANY_TIEBREAK = ("Status", "Name", "Industry", "SPrating", "ceo", "AddressLine1",
                    "AddressLine2", "PostalCode", "CITY", "StateProv", "COUNTRY",
                    "DESCRIPTION", "FOUNDING_DATE")
SECURITY_TIEBREAK = ("SK_SecurityID", "Issue", "STATUS", "NAME", "ExchangeID", "SK_CompanyID",
                     "SharesOutstanding", "FirstTrade", "FirstTradeOnExchange", "DIVIDEND")


# ---------------------------------------------------------------- PL3
def build_dim_company(cmp: DataFrame, industry: DataFrame, how: str = "inner",
                      on_error: str = "fail", split: str | None = "day") -> DataFrame:
    """dimcompany: company versions with industry name, grade flag and validity.

    ``how="inner"`` drops companies with an unknown industry code (Spark and
    Polars variants); ``"left"`` keeps them with a NULL industry (DuckDB).
    The industry table is tiny; AQE/auto-broadcast turn this into a broadcast
    join from its measured size, with a shuffle join beyond the threshold.
    """
    ind = industry.select(F.col("IN_ID").alias("__in_id"), F.col("IN_NAME"))
    j = cmp.join(ind, cmp["INDUSTRY_ID"] == ind["__in_id"], how)
    # --- Fixed values: names and order of the dimcompany columns. ---
    at = parse_timestamp("PTS", on_error=on_error)
    dim = j.select(
        F.col("CIK").alias("Companyid"),
        F.col("STATUS").alias("Status"),
        F.col("COMPANY_NAME").alias("Name"),
        F.col("IN_NAME").alias("Industry"),
        F.col("SP_RATING").alias("SPrating"),
        F.col("CEO_NAME").alias("ceo"),
        F.col("ADDR1").alias("AddressLine1"),
        F.col("ADDR2").alias("AddressLine2"),
        F.col("POSTAL_CODE").alias("PostalCode"),
        F.col("CITY"),
        F.col("STATE_PROVINCE").alias("StateProv"),
        F.col("COUNTRY"),
        F.col("DESCRIPTION"),
        F.col("FOUNDING_DATE"),
        at.alias("effective_timestamp"),
        # the record's stamp, where it is not the time in its own format: what follows from other columns need not be shuffled
        F.when(~F.col("PTS").eqNullSafe(compact_stamp(at)), F.col("PTS")).alias("__stamp"),
    )
    derived = {"sku_company_id": version_key(F.coalesce("__stamp", compact_stamp("effective_timestamp")), "Companyid"),
               "isLowgrade": is_low_grade(F.col("SPrating"))}
    return with_validity(dim, "Companyid", "effective_timestamp", COMPANY_TIEBREAK, split=split, derived=derived).drop("__stamp")


# ---------------------------------------------------------------- PL4
def build_dim_security(sec: DataFrame, dim_company: DataFrame, versions: str = "all",
                       skip_nulls: bool = False, on_error: str = "fail",
                       split: str | None = "day", period: str | None = "year") -> DataFrame:
    """dimsecurity: security versions keyed to the company they reference.

    ``versions="all"`` reproduces the reference: the company reference joins
    every company version, so a security row is repeated once per version.
    """
    at = parse_timestamp("PTS", on_error=on_error)
    # The fan-out copies stay a count until after the window (see with_validity).
    r = resolve_reference(sec, "CO_NAME_OR_CIK", dim_company, "Companyid", "Name",
                          out="company_ref_id", versions=versions, at=at, copies="__copies", period=period)
    # --- Fixed values: names and order of the dimsecurity columns. ---
    dim = r.select(
        F.col("SYMBOL"),
        F.col("ISSUE_TYPE").alias("Issue"),
        F.col("STATUS"),
        F.col("NAME"),
        F.col("EX_ID").alias("ExchangeID"),
        F.col("company_ref_id").alias("SK_CompanyID"),
        F.col("SH_OUT").alias("SharesOutstanding"),
        F.col("FIRST_TRADE_DATE").alias("FirstTrade"),
        F.col("FIRST_TRADE_EXCHG").alias("FirstTradeOnExchange"),
        F.col("DIVIDEND"),
        at.alias("effective_timestamp"),
        F.col("__copies"),
    )
    derived = {"SK_SecurityID": concat_keys("SYMBOL", "ExchangeID", "SK_CompanyID", skip_nulls=skip_nulls),
               "BatchID": F.lit(1)}
    out = with_validity(dim, "SYMBOL", "effective_timestamp", SECURITY_TIEBREAK, split=split,
                        copies="__copies", derived=derived)
    plain = [c for c in dim.columns if c not in ("effective_timestamp", "__copies")]
    return out.select("SK_SecurityID", *plain, "BatchID", "effective_timestamp", "end_timestamp", "iscurrent")


# ---------------------------------------------------------------- PL5
# --- Fixed values: FIN fields and their names in the financial table, in order. ---
FINANCIAL_COLUMNS = (
    ("YEAR", "FI_YEAR"), ("QUARTER", "FI_QTR"), ("QTR_START_DATE", "FI_QTR_START_DATE"),
    ("REVENUE", "FI_REVENUE"), ("EARNINGS", "FI_NET_EARN"), ("EPS", "FI_BASIC_EPS"),
    ("DILUTED_EPS", "FI_DILUT_EPS"), ("MARGIN", "FI_MARGIN"), ("INVENTORY", "FI_INVENTORY"),
    ("ASSETS", "FI_ASSETS"), ("LIABILITIES", "FI_LIABILITY"), ("SH_OUT", "FI_OUT_BASIC"),
    ("DILUTED_SH_OUT", "FI_OUT_DILUT"),
)


def build_financial(fin: DataFrame, dim_company: DataFrame, versions: str = "all",
                    on_error: str = "fail", period: str | None = "year") -> DataFrame:
    """financial: quarterly figures keyed to the company they reference."""
    at = parse_timestamp("PTS", on_error=on_error) if versions == "as_of" else None
    r = resolve_reference(fin, "CO_NAME_OR_CIK", dim_company, "Companyid", "Name",
                          out="company_ref_id", versions=versions, at=at, period=period)
    return r.select(F.col("company_ref_id").alias("SK_CompanyID"),
                    *[F.col(s).alias(t) for s, t in FINANCIAL_COLUMNS])


# ---------------------------------------------------------------- PL6
PLACEHOLDER_MEASURES = ("PERatio", "Yield", "FiftyTwoWeekHigh", "SK_FiftyTwoWeekHighDate",
                        "FiftyTwoWeekLow", "SK_FiftyTwoWeekLowDate")


def build_fact_market_history(market: DataFrame, dim_security: DataFrame, how: str = "inner",
                              on_error: str = "fail", period: str | None = "year",
                              placeholders: str = "int") -> DataFrame:
    """FactMarketHistory: each market row with the security version valid on its day.

    ``market`` is the batch union (see ``union_batches``) with ``BatchID``;
    ``period`` is that of ``point_in_time_join``. The placeholder measures are
    the number 1, or the text '1' with ``placeholders="text"``.
    """
    if placeholders not in ("int", "text"):
        raise ValueError("placeholders must be int|text")
    # The join's shuffle carries the day; its text only where the day is written in another way.
    text, day = F.col("DM_DATE"), F.col("__day")
    dated = market.withColumn("__day", parse_date(text, on_error=on_error)) \
                  .withColumn("DM_DATE", F.when(~text.eqNullSafe(day.cast("string")), text))
    j = point_in_time_join(dated, dim_security, "DM_S_SYMB", "SYMBOL", at="__day",
                           dim_cols=["SK_SecurityID", "SK_CompanyID"], how=how, period=period)
    # --- Fixed values: names and order of the FactMarketHistory columns. ---
    return j.select(
        F.col("SK_SecurityID"),
        F.col("SK_CompanyID"),
        F.coalesce(text, day.cast("string")).alias("SK_DateID"),
        F.year(day).alias("YearID"),
        *[F.lit(1 if placeholders == "int" else "1").alias(m) for m in PLACEHOLDER_MEASURES],
        F.col("DM_CLOSE").alias("ClosePrice"),
        F.col("DM_HIGH").alias("DayHigh"),
        F.col("DM_LOW").alias("DayLow"),
        F.col("DM_VOL").alias("Volume"),
        F.col("BatchID"),
    )


# ---------------------------------------------------------------- I/O steps
def stage_industry(spark: SparkSession, paths: LakePaths, fmt: str = "parquet") -> None:
    """PL1: raw Industry.txt -> bronze industry."""
    df = read_delimited(spark, paths.batch(1, "Industry.txt"), INDUSTRY_COLUMNS)
    write_table(df, paths.bronze("industry"), fmt)


def stage_finwire(spark: SparkSession, paths: LakePaths, typed: bool = False, fmt: str = "parquet",
                  glob: str = FINWIRE_GLOB, name_regex: str | None = FINWIRE_REGEX,
                  staged: bool = True, trim: str = "spaces") -> dict[str, int]:
    """PL2: raw FINWIRE<yyyy>Q<n> files -> bronze finwire_cmp / _sec / _fin / _rejects.

    ``staged`` reads the raw text once into record-type partitions, so each
    of the tables is cut from its own partition (see ``write_split``). Returns
    the lines written per table; every line read is in one of them.
    """
    lines = read_lines(spark, paths.raw(glob), name_regex=name_regex)
    targets = {"CMP": (LAYOUT_CMP, paths.bronze("finwire_cmp")),
               "SEC": (LAYOUT_SEC, paths.bronze("finwire_sec")),
               "FIN": (LAYOUT_FIN, paths.bronze("finwire_fin"))}
    return write_split(lines, targets, typed=typed, fmt=fmt, trim=trim, rejects=paths.bronze("finwire_rejects"),
                       staging=paths.bronze("_finwire_by_type") if staged else None)


def _found_batches(spark: SparkSession, paths: LakePaths) -> dict[int, str]:
    found = {}
    for p in list_matching(spark, paths.raw("Batch*/DailyMarket.txt")):
        if m := re.search(r"/Batch(\d+)/DailyMarket\.txt/?$", p):
            found[int(m[1])] = paths.batch(int(m[1]), "DailyMarket.txt")
    if sorted(found) != list(range(1, len(found) + 1)) or not found:
        raise FileNotFoundError(f"DailyMarket batches must be numbered 1, 2, ... without a gap; found {sorted(found)}")
    return found


def market_batches(spark: SparkSession, paths: LakePaths, batch_files: Mapping[int, str] | None = None,
                   corrupt: str | None = None) -> list[tuple[DataFrame, str]]:
    """(frame, BatchID) per DailyMarket batch; batch 1 is full, later ones incremental.

    ``batch_files`` maps batch number to its path; by default every
    ``BatchN/DailyMarket.txt`` found is a batch, and a gap in the numbers is an error.
    ``corrupt`` names a column that keeps lines of a wrong field count whole.
    """
    files = batch_files or _found_batches(spark, paths)
    return [(read_market_batch(spark, p, incremental=n > 1, corrupt=corrupt), str(n)) for n, p in sorted(files.items())]


def run_all(spark: SparkSession, paths: LakePaths, fmt: str = "parquet", typed: bool = False,
            distinct_batches: bool = False, company_join: str = "inner",
            steps: Sequence[str] = ("industry", "finwire", "dim_company", "dim_security",
                                    "financial", "fact"),
            parallel: bool = True, timings: dict | None = None, *,
            versions: str = "all", fact_how: str = "inner", skip_nulls: bool = False,
            on_error: str = "fail", split: str | None = "day", period: str | None = "year",
            glob: str = FINWIRE_GLOB, name_regex: str | None = FINWIRE_REGEX, trim: str = "spaces",
            batch_files: Mapping[int, str] | None = None, quarantine: bool = False,
            placeholders: str = "int") -> dict[str, str]:
    """Run PL1-PL6, every step reading what the previous one wrote.

    The options are those of the steps: ``versions`` of the company lookups,
    ``fact_how`` of the point-in-time join, ``skip_nulls`` of the security
    key, ``on_error`` of all date and timestamp parsing, ``split`` and
    ``period`` of the histories and interval joins, ``glob`` / ``name_regex``
    / ``trim`` of the FINWIRE feed, ``batch_files`` and ``placeholders`` of
    the fact. With ``quarantine`` market lines without exactly the expected
    fields go to the bronze table ``dailymarket_rejects`` instead of being
    loaded with NULLs.

    Steps that do not depend on each other (industry and finwire; financial
    and dim_security -> fact) are submitted as concurrent Spark jobs, each in
    its own fair-scheduler pool, so one step's tail tasks overlap the next
    step's work. ``timings`` (if given) receives each step's wall seconds.
    """
    import time
    from concurrent.futures import ThreadPoolExecutor

    def industry():
        stage_industry(spark, paths, fmt)

    def finwire():
        stage_finwire(spark, paths, typed=typed, fmt=fmt, glob=glob, name_regex=name_regex, trim=trim)

    def dim_company():
        dc = build_dim_company(read_table(spark, paths.bronze("finwire_cmp"), fmt),
                               read_table(spark, paths.bronze("industry"), fmt), how=company_join,
                               on_error=on_error, split=split)
        write_table(dc, paths.silver("dimcompany"), fmt)

    def dim_security():
        ds = build_dim_security(read_table(spark, paths.bronze("finwire_sec"), fmt),
                                read_table(spark, paths.silver("dimcompany"), fmt), versions=versions,
                                skip_nulls=skip_nulls, on_error=on_error, split=split, period=period)
        write_table(ds, paths.silver("dimsecurity"), fmt)

    def financial():
        fi = build_financial(read_table(spark, paths.bronze("finwire_fin"), fmt),
                             read_table(spark, paths.silver("dimcompany"), fmt), versions=versions,
                             on_error=on_error, period=period)
        write_table(fi, paths.silver("financial"), fmt)

    def fact():
        mark = "corrupt_line" if quarantine else None
        market = union_batches(market_batches(spark, paths, batch_files, corrupt=mark), distinct=distinct_batches)
        if quarantine:
            market, bad = split_corrupt(market, mark)
            write_table(bad.select("BatchID", F.col(mark).alias("line")), paths.bronze("dailymarket_rejects"), fmt)
        f = build_fact_market_history(market, read_table(spark, paths.silver("dimsecurity"), fmt), how=fact_how,
                                      on_error=on_error, period=period, placeholders=placeholders)
        write_table(f, paths.silver("FactMarketHistory"), fmt, partition_by=["YearID"])

    fns = {"industry": industry, "finwire": finwire, "dim_company": dim_company,
           "dim_security": dim_security, "financial": financial, "fact": fact}

    def run(chain):
        for name in chain:
            if name in steps:
                spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
                t = time.perf_counter()
                fns[name]()
                if timings is not None:
                    timings[name] = round(time.perf_counter() - t, 3)

    # waves of independent chains; each chain runs in order
    waves = [[["industry"], ["finwire"]], [["dim_company"]], [["dim_security", "fact"], ["financial"]]]
    for wave in waves:
        if parallel and len(wave) > 1:
            with ThreadPoolExecutor(max_workers=len(wave)) as pool:
                list(pool.map(run, wave))
        else:
            for chain in wave:
                run(chain)
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    out = {}
    for name in ("industry", "finwire_cmp", "finwire_sec", "finwire_fin", "finwire_rejects",
                 *(["dailymarket_rejects"] if quarantine else [])):
        out[name] = paths.bronze(name)
    for name in ("dimcompany", "dimsecurity", "financial", "FactMarketHistory"):
        out[name] = paths.silver(name)
    return out
