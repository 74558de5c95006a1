"""Raw-shaped feeds derived from the test tables (FIXTURES.md section 4).

Every feed is a Spark job over the given Parquet tables, so its size grows
with the scale factor. Text is built with ``lpad``/``rpad``; numbers are
printed from integer cents so every engine prints them the same way.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .layouts import LAYOUT_CMP, LAYOUT_FIN, LAYOUT_SEC, FieldSpec
from .paths import LakePaths
from .session import DROP_SHUFFLES, ensure_checkpoint_dir, held, open_files, scratch_path
from .functions.scalars import compact_date, compact_stamp, iso_text
from .sinks import write_delimited, write_lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c: Column) -> Column:
    return c.cast("string")


def zpad(c: Column, n: int) -> Column:
    return F.lpad(_s(c), n, "0" * n)  # Spark copies a pad of the full width at once, a single character once per place


def money(cents: Column) -> Column:
    """Integer cents -> '<whole>.<two digits>'."""
    return F.concat(_s(F.floor(cents / 100)), F.lit("."), F.lpad(_s(cents % 100), 2, "0"))


def cents(x: Column) -> Column:
    return F.round(x * 100).cast("bigint")


def stamp_time(ts: Column, key: Column) -> Column:
    return F.timestamp_add("SECOND", (key % 86400).cast("int"), ts)


def pts(ts: Column, key: Column) -> Column:
    """Record stamp: the day plus ``key % 86400`` seconds, as yyyyMMdd-HHmmss."""
    return compact_stamp(stamp_time(ts, key))


def fixed_line(layout: tuple[FieldSpec, ...], values: dict[str, Column],
               right_align: tuple[str, ...] = ()) -> Column:
    parts = []
    for spec in layout:
        v = values[spec.name]
        if spec.end is None:
            parts.append(v)
        elif spec.name in right_align:
            parts.append(F.lpad(v, spec.width, " " * spec.width))
        else:
            parts.append(F.rpad(v, spec.width, " " * spec.width))
    return F.concat(*parts)


def symbol(partkey: Column) -> Column:
    return F.concat(F.lit("S"), zpad(partkey, 9))


def company_ref(k: Column, companies: int) -> Column:
    """CO_NAME_OR_CIK rule: k % 7 == 0 -> unresolvable; even -> CIK; odd -> name."""
    c = k % max(1, companies)
    return (F.when(k % 7 == 0, F.lit("NOBODY"))
             .when(k % 2 == 0, zpad(c, 10))
             .otherwise(F.concat(F.lit("Customer#"), zpad(c, 9))))


# --- Fixed values: SP rating per order-priority digit (5 = blank). ---
RATING_BY_PRIORITY = {"1": "AAA", "2": "BBB-", "3": "BB+", "4": "CCC", "5": ""}


# --- Fixed values: texts that stand in a FIN figure where o_orderkey % 50 has the given value. ---
ODD_FIGURES = {7: "n/a", 11: "nan", 21: "inf", 31: "1_000", 41: "-Infinity", 1: "1e3", 14: "1__0", 24: "+25"}


def industry_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(zpad(F.col("n_nationkey"), 2).alias("IN_ID"), F.col("n_name").alias("IN_NAME"),
                    zpad(F.col("n_regionkey"), 2).alias("IN_SC_ID"))


def cmp_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    prio = F.substring(F.col("o_orderpriority"), 1, 1)
    rating = F.coalesce(*[F.when(prio == k, F.lit(v)) for k, v in RATING_BY_PRIORITY.items()], F.lit(""))
    vals = {
        "PTS": pts(F.col("o_orderdate"), F.col("o_orderkey")),
        "RECTYPE": F.lit("CMP"),
        "COMPANY_NAME": F.col("c_name"),
        "CIK": zpad(F.col("o_custkey"), 10),
        "STATUS": F.when(F.col("o_orderstatus") == "F", F.lit("INAC")).otherwise(F.lit("ACTV")),
        "INDUSTRY_ID": F.when(F.col("o_custkey") % 10 == 0, F.lit("ZZ"))
                        .otherwise(zpad(F.col("c_nationkey"), 2)),
        "SP_RATING": rating,
        "FOUNDING_DATE": F.lit("19900101"),
        "ADDR1": F.concat(_s(F.col("c_custkey")), F.lit(" Market Street")),
        "ADDR2": F.lit(""),
        "POSTAL_CODE": zpad(F.col("c_nationkey"), 5),
        "CITY": F.concat(F.lit("City "), _s(F.col("c_nationkey"))),
        "STATE_PROVINCE": F.lit("State"),
        "COUNTRY": F.concat(F.lit("Country "), _s(F.col("c_nationkey"))),
        "CEO_NAME": F.concat(F.lit("CEO of "), F.col("c_name")),
        "DESCRIPTION": F.col("c_mktsegment"),
    }
    return j.select(fixed_line(LAYOUT_CMP, vals).alias("value"))


def sec_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    n = table(spark, sf_dir, "customer").count()
    day = compact_date(F.col("o_orderdate"))
    vals = {
        "PTS": pts(F.col("o_orderdate"), F.col("o_orderkey")),
        "RECTYPE": F.lit("SEC"),
        "SYMBOL": symbol(F.col("o_custkey")),
        "ISSUE_TYPE": F.lit("COMMON"),
        "STATUS": F.lit("ACTV"),
        "NAME": F.concat(F.lit("Security "), _s(F.col("o_custkey"))),
        "EX_ID": F.lit("NYSE"),
        "SH_OUT": _s(F.col("o_orderkey")),
        "FIRST_TRADE_DATE": day,
        "FIRST_TRADE_EXCHG": day,
        "DIVIDEND": money(F.col("o_orderkey") % 1000),
        "CO_NAME_OR_CIK": company_ref(F.col("o_custkey"), n),
    }
    return o.select(fixed_line(LAYOUT_SEC, vals, right_align=("SH_OUT", "DIVIDEND")).alias("value"))


def fin_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    c = cents(F.col("o_totalprice"))

    n = table(spark, sf_dir, "customer").count()

    def gappy(v: Column) -> Column:  # some figures are missing, junk, or numbers in an unusual spelling
        odd = F.coalesce(*[F.when(k % 50 == r, F.lit(text)) for r, text in ODD_FIGURES.items()])
        return F.coalesce(odd, F.when(k % 20 == 3, F.lit("")), v)

    vals = {
        "PTS": pts(F.col("o_orderdate"), k),
        "RECTYPE": F.lit("FIN"),
        "YEAR": _s(F.year(F.to_date("o_orderdate"))),
        "QUARTER": _s(F.quarter(F.to_date("o_orderdate"))),
        "QTR_START_DATE": compact_date(F.trunc(F.to_date("o_orderdate"), "quarter")),
        "POSTING_DATE": compact_date(F.col("o_orderdate")),
        "REVENUE": gappy(money(c)),
        "EARNINGS": gappy(money(F.floor(c / 10))),
        "EPS": gappy(money(F.floor(c / 1000))),
        "DILUTED_EPS": gappy(money(F.floor(c / 1100))),
        "MARGIN": F.lit("0.25"),
        "INVENTORY": money(c * 2),
        "ASSETS": money(c * 3),
        "LIABILITIES": money(c * 4),
        "SH_OUT": gappy(_s(k)),
        "DILUTED_SH_OUT": _s(k + 1),
        "CO_NAME_OR_CIK": company_ref(F.col("o_custkey"), n),
    }
    right = ("REVENUE", "EARNINGS", "EPS", "DILUTED_EPS", "MARGIN", "INVENTORY", "ASSETS",
             "LIABILITIES", "SH_OUT", "DILUTED_SH_OUT")
    return o.select(fixed_line(LAYOUT_FIN, vals, right_align=right).alias("value"))


def junk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines no layout covers, one per supplier, with the file each lies in: unknown codes, too short, blank."""
    k = F.col("s_suppkey")
    value = (F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.concat(F.lit("short "), _s(k)))
              .when(k % 5 == 2, F.concat(F.lit("19970101-000000cmp"), F.col("s_name")))
              .when(k % 5 == 3, F.concat(F.lit("19970101-000000/.."), F.col("s_name")))
              .otherwise(F.concat(F.lit("19970101-000000ZZZ"), F.col("s_name"))))
    fname = F.concat(F.lit("FINWIRE1997Q"), _s(k % 4 + 1))
    return table(spark, sf_dir, "supplier").select(value.alias("value"), fname.alias("fname"))


def finwire_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the FINWIRE feed: CMP, SEC and FIN in one line column."""
    return cmp_lines(spark, sf_dir).unionByName(sec_lines(spark, sf_dir)).unionByName(fin_lines(spark, sf_dir))


def quarter_file(stamp: Column, month_at: int = 5) -> Column:
    """The FINWIRE file that a record with this stamp (or line) lies in; the month is written from ``month_at`` on."""
    quarter = F.floor((F.substring(stamp, month_at, 2).cast("int") - 1) / 3) + 1
    return F.concat(F.lit("FINWIRE"), F.substring(stamp, 1, 4), F.lit("Q"), _s(quarter))


def finwire_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(time, rt) per line of ``finwire_lines``, without building the lines: the time of its stamp as ISO text; both are
    null where the line is, which is where a column that stands in it is null."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    used = {"CMP": (o.join(c, o["o_custkey"] == c["c_custkey"]), ("o_orderdate", "o_orderkey", "c_name", "c_nationkey", "c_mktsegment")),
            "SEC": (o, ("o_orderdate", "o_orderkey", "o_custkey")),
            "FIN": (o, ("o_orderdate", "o_orderkey", "o_custkey", "o_totalprice"))}
    parts = []
    for rt, (rows, columns) in used.items():
        whole = reduce(and_, [F.col(x).isNotNull() for x in columns])
        parts.append(rows.select(F.when(whole, iso_text(stamp_time(F.col("o_orderdate"), F.col("o_orderkey")))).alias("time"),
                                 F.when(whole, F.lit(rt)).alias("rt")))
    return reduce(DataFrame.unionByName, parts)


def market_batch_no(line_number: Column) -> Column:
    """The DailyMarket batch a lineitem row goes to; every row goes to one."""
    return F.when(line_number <= 3, 1).when(line_number <= 5, 2).otherwise(3)


def market_feed(spark: SparkSession, sf_dir: str, batch: int) -> DataFrame:
    """The text lines of one DailyMarket batch; some are quoted, some lack a field or a value, some have one too many."""
    li = table(spark, sf_dir, "lineitem").filter(market_batch_no(F.col("l_linenumber")) == batch)
    c = cents(F.col("l_extendedprice"))
    k = F.col("l_orderkey") % 40
    close = money(c)
    volume = F.concat(F.lit("|"), _s(F.col("l_quantity").cast("bigint")))
    fields = [
        F.to_date("l_shipdate").cast("string"),
        symbol(F.col("l_partkey")),
        F.when(k == 11, F.concat(F.lit('"'), close, F.lit('"'))).otherwise(close),
        F.when(k == 13, F.lit("")).otherwise(money(F.floor(c * 101 / 100))),
        money(F.floor(c * 99 / 100)),
    ]
    if batch > 1:
        fields = [F.lit("I"), _s(F.col("l_orderkey") * 10 + F.col("l_linenumber")), *fields]
    last = F.when(k == 7, F.lit("|")).when(k == 17, F.lit("")).when(k == 23, F.concat(volume, F.lit("|extra"))).otherwise(volume)
    return li.select(F.concat(F.concat_ws("|", *fields), last).alias("value"))


# ------------------------------------------------------------ raw files
_WRITTEN: dict[tuple[str, str], tuple[LakePaths, set[str]]] = {}

#: The feeds of the raw layer, each written on its own.
FEEDS = ("industry", "finwire", "market")
#: Codec of the FINWIRE and DailyMarket text: padded records, which shrink to a small part; Spark's readers undo it by the file's suffix.
CODEC = "gzip"
#: The codec's Hadoop setting: the fastest level, as the text is read once or twice; records still shrink to a ninth.
CODEC_LEVEL = ("zlib.compress.level", "BEST_SPEED")
#: Lines of a part file at most: a compressed file is read by one task.
LINES_PER_FILE = 250_000
#: Quarter files that a task keeps open at most; lines of any further ones are sorted by file first.
OPEN_QUARTERS = 64


def _rename_partition_dirs(spark: SparkSession, parent: str, column: str) -> None:
    """``parent/column=VALUE`` -> ``parent/VALUE`` (metadata-only renames)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(parent)
    fs = p.getFileSystem(conf)
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith(column + "="):
            fs.rename(st.getPath(), jvm.org.apache.hadoop.fs.Path(p, name[len(column) + 1:]))


def write_raw(spark: SparkSession, sf_dir: str, root: str | None = None, feeds: Sequence[str] = FEEDS) -> LakePaths:
    """Write the raw layer: Batch1/Industry.txt, Batch1/FINWIRE<yyyy>Q<n> (plus
    ``_audit`` companions that a name-pattern scan must skip) and
    BatchN/DailyMarket.txt. Each "file" is a directory of part files, those of the
    large feeds compressed. ``feeds`` names those needed; each is written once per process.
    """
    key = (sf_dir, root or ensure_checkpoint_dir(spark))
    if key not in _WRITTEN:
        _WRITTEN[key] = LakePaths(root or scratch_path(spark, "raw-feeds", unique=True)), set()
    paths, done = _WRITTEN[key]
    write = {"industry": _write_industry, "finwire": _write_finwire, "market": _write_market}
    for feed in feeds:
        if feed not in done:
            write[feed](spark, sf_dir, paths)
            done.add(feed)
    return paths


def _write_industry(spark: SparkSession, sf_dir: str, paths: LakePaths) -> None:
    write_delimited(industry_feed(spark, sf_dir), paths.batch(1, "Industry.txt"))


def _write_finwire(spark: SparkSession, sf_dir: str, paths: LakePaths) -> None:
    lines = finwire_lines(spark, sf_dir)
    staged = paths.raw("_finwire_staging")
    with held(spark, open_files(OPEN_QUARTERS) | DROP_SHUFFLES):
        (lines.select("value", quarter_file(F.col("value")).alias("fname")).unionByName(junk_lines(spark, sf_dir))
              .write.mode("overwrite").option("compression", CODEC).option(*CODEC_LEVEL).option("maxRecordsPerFile", LINES_PER_FILE)
              .partitionBy("fname").text(staged))
    # Audit companions: record counts per quarter file, same directory level.
    (finwire_stamps(spark, sf_dir).groupBy(quarter_file(F.col("time"), 6).alias("fname"), "rt").count()
          .select(F.concat_ws("|", F.col("fname"), F.col("rt"), _s(F.col("count"))).alias("value"),
                  F.concat(F.col("fname"), F.lit("_audit")).alias("fname"))
          .write.mode("append").partitionBy("fname").text(staged))
    _rename_partition_dirs(spark, staged, "fname")
    jvm = spark.sparkContext._jvm
    src = jvm.org.apache.hadoop.fs.Path(staged)
    fs = src.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for st in fs.listStatus(src):
        if st.isDirectory():
            fs.rename(st.getPath(), jvm.org.apache.hadoop.fs.Path(paths.batch(1), st.getPath().getName()))


def _write_market(spark: SparkSession, sf_dir: str, paths: LakePaths) -> None:
    for n in (1, 2, 3):
        write_lines(market_feed(spark, sf_dir, n), paths.batch(n, "DailyMarket.txt"), compression=CODEC, max_lines=LINES_PER_FILE,
                    options=dict([CODEC_LEVEL]))
