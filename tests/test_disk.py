"""What a step leaves on disk, shuffles and does twice."""

import datetime as dt
import re
import threading

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from lakebuild import fixtures as fx
from lakebuild.layouts import LAYOUT_CMP
from lakebuild.operators import point_in_time_join, union_batches, with_validity
from lakebuild.plans import pipelines as pl
from lakebuild.session import held
from lakebuild.sinks import write_split, write_table
from lakebuild.sources import parse_market_lines

SF = "/root/testdata/sf0.001"
T = dt.datetime
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


@pytest.fixture
def plain_plans(spark):
    with held(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        yield


def _shuffle_inputs(spark, df):
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_path):
    before = _shuffle_files(spark)
    df = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count()
    write_table(df, f"file:{tmp_path}/t")
    write_table(df.withColumn("p", F.col("k") % 3), f"file:{tmp_path}/u", partition_by=["p"])
    for _ in range(50):  # removed in the background
        left = _shuffle_files(spark) - before
        if not left:
            break
        threading.Event().wait(0.2)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_rows_of_folders_are_not_sorted_before_they_are_written(spark, tmp_path, monkeypatch):
    seen = []
    for how in ("text", "parquet"):
        write = getattr(DataFrameWriter, how)
        monkeypatch.setattr(DataFrameWriter, how, lambda self, *a, _w=write, **k: (seen.append(spark.conf.get(OPEN_FILES)), _w(self, *a, **k))[1])
    raw = fx.write_raw(spark, SF, root=f"file:{tmp_path}/landing", feeds=["finwire"])
    assert int(seen[0]) > 1
    seen.clear()
    lines = spark.read.text(raw.raw(pl.FINWIRE_GLOB))
    counts = write_split(lines, {"CMP": (LAYOUT_CMP, f"file:{tmp_path}/cmp")}, staging=f"file:{tmp_path}/by", rejects=f"file:{tmp_path}/no")
    assert seen[0] == "2" and counts["CMP"] + counts["rejected"] == counts["lines"] == lines.count()
    assert spark.conf.get(OPEN_FILES) == "0"


def test_settings_of_overlapping_writes_are_put_back(spark):
    key, inside, go = "spark.sql.maxMetadataStringLength", threading.Event(), threading.Event()
    old = spark.conf.get(key)

    def other():
        with held(spark, {key: "77"}):
            inside.set()
            go.wait(10)

    t = threading.Thread(target=other)
    t.start()
    inside.wait(10)
    with held(spark, {key: "77"}):
        pass
    assert spark.conf.get(key) == "77"  # still needed by the other
    go.set()
    t.join()
    assert spark.conf.get(key) == old


def _dim(spark):
    dim = spark.createDataFrame([("S1", "S1NYSE1", "1", T(1960, 1, 1)), ("S1", "S1NYSE2", "2", T(2020, 6, 1)), ("S2", "S2NYSE2", "2", T(2020, 1, 1))],
                                "SYMBOL string, SK_SecurityID string, SK_CompanyID string, effective_timestamp timestamp_ntz")
    return with_validity(dim, "SYMBOL", "effective_timestamp", ["SK_SecurityID"])


def test_a_market_line_is_parsed_once_per_reading(spark):
    lines = spark.range(6).select(F.concat(F.lit("2020-01-0"), F.col("id") + 1, F.lit("|S1|1.00|1.10|0.90|10")).alias("value"))
    market = union_batches([(parse_market_lines(lines, False), "1")])
    fact = pl.build_fact_market_history(market, _dim(spark))
    # one reading for the facts, one for the periods they fall in
    assert spark._jvm.PythonSQLUtils.explainString(fact._jdf.queryExecution(), "simple").count("from_csv") == 2
    assert fact.count() == 6


def test_facts_are_shuffled_with_one_date(spark, plain_plans, tmp_path):
    rows = [("2020-01-02", "S1", "a"), ("2020-1-3", "S1", "b"), (" 2020-07-01", "S1", "c"), ("1959-01-01", "S1", "d"), (None, "S1", "e"), ("no date", "S2", "f")]
    spark.createDataFrame([(d, s, v, v, v, v, "1") for d, s, v in rows],
                          "DM_DATE string, DM_S_SYMB string, DM_CLOSE string, DM_HIGH string, DM_LOW string, DM_VOL string, BatchID string") \
         .write.parquet(f"{tmp_path}/m")
    fact = pl.build_fact_market_history(spark.read.parquet(f"{tmp_path}/m"), _dim(spark), how="left", on_error="null")
    wide = [i for i in _shuffle_inputs(spark, fact) if "DM_CLOSE#" in i]
    assert len(wide) == 1 and "__pit_at#" not in wide[0], wide
    got = {r.Volume: (r.SK_DateID, r.YearID, r.SK_CompanyID) for r in fact.collect()}
    assert got == {"a": ("2020-01-02", 2020, "1"), "b": ("2020-1-3", 2020, "1"), "c": (" 2020-07-01", 2020, "2"),
                   "d": ("1959-01-01", 1959, None), "e": (None, None, None), "f": ("no date", None, None)}


def test_repeats_are_removed_for_the_facts_only(spark, plain_plans, tmp_path):
    """The set of a key's periods is the same with repeats in, so that reading shuffles no whole rows."""
    lines = [f"2020-01-0{d}|S1|1.00|1.10|0.90|10" for d in (1, 2, 2, 3)]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(f"{tmp_path}/m")
    one = parse_market_lines(spark.read.text(f"{tmp_path}/m"), False)
    fact = pl.build_fact_market_history(union_batches([(one, "1"), (one, "1")], distinct=True), _dim(spark))
    assert sum("DM_CLOSE#" in i for i in _shuffle_inputs(spark, fact)) == 2
    assert fact.count() == 3


@pytest.mark.parametrize("how", ["inner", "left"])
def test_periods_of_any_size_give_the_same_rows(spark, how):
    days = [dt.date(1969, 12, 30) + dt.timedelta(days=n) for n in (-4000, -64, -1, 0, 1, 2, 63, 64, 65, 700, 18000, 18413, 18414)]
    facts = spark.createDataFrame([(s, d) for s in ("S1", "S2", None) for d in [*days, None]], "k string, d date")
    want = None
    for period in (None, "day", "month", "year"):
        out = point_in_time_join(facts, _dim(spark), "k", "SYMBOL", F.col("d"), ["SK_SecurityID"], how=how, period=period)
        got = sorted(map(str, out.collect()))
        want = want or got
        assert got == want
        assert sorted(map(str, point_in_time_join(facts, _dim(spark), "k", "SYMBOL", "d", ["SK_SecurityID"], how=how, period=period).collect())) == want


@pytest.mark.parametrize("split", [None, "day"])
@pytest.mark.parametrize("copies", [None, "n"])
def test_derived_columns_are_those_of_the_rows_and_not_shuffled(spark, plain_plans, tmp_path, copies, split):
    day = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    spark.range(80).select((F.col("id") % 5).alias("k"), F.when(F.col("id") % 9 > 0, day + F.make_dt_interval(F.col("id") % 3)).alias("ts"),
                           (F.col("id") * 7 % 11).alias("v"), (F.col("id") % 3).alias("n")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    df = df if copies else df.drop("n")
    made = F.concat(F.lit("x"), F.format_string("%03d", 100 - F.col("v")))
    stored = df.withColumn("w", made)
    out = with_validity(df, "k", "ts", ["w", "v"], split=split, copies=copies, derived={"w": made})
    want = with_validity(stored, "k", "ts", ["w", "v"], split=split, copies=copies).select(out.columns)
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    if split:
        assert not any(re.search(r"\bw#", i) for i in _shuffle_inputs(spark, out))


def test_stamps_that_are_no_time_stay_in_the_version_key(spark):
    fields = [f.name for f in LAYOUT_CMP]
    stamps = ["19970101-000000", "19970102-101112", "1997-bad", "", None]
    cmp = spark.createDataFrame([tuple({"PTS": s, "CIK": "7", "INDUSTRY_ID": "01", "SP_RATING": "BB"}.get(f, f) for f in fields) for s in stamps],
                                ", ".join(f"{f} string" for f in fields))
    industry = spark.createDataFrame([("01", "Metal")], "IN_ID string, IN_NAME string")
    got = pl.build_dim_company(cmp, industry, on_error="null")
    assert sorted(str(r.sku_company_id) for r in got.collect()) == sorted(["199701010000007", "199701021011127", "1997bad7", "7", "None"])
    assert got.columns[-5:] == ["effective_timestamp", "sku_company_id", "isLowgrade", "end_timestamp", "iscurrent"]
