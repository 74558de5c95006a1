import os

from pyspark.sql import functions as F

from lakebuild.layouts import LAYOUT_CMP, LAYOUT_FIN, LAYOUT_SEC
from lakebuild.sinks import split_by_record_type, write_delimited, write_split, write_table
from lakebuild.sources import list_matching, read_delimited, read_lines, read_market_batch, read_table


def _write_text(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_read_delimited_all_strings(spark, tmp_path):
    p = str(tmp_path / "Industry.txt")
    _write_text(p, ["AB|Airlines|IN", "01|Banks|FI", "02|Short"])
    df = read_delimited(spark, p, ["IN_ID", "IN_NAME", "IN_SC_ID"])
    assert df.dtypes == [("IN_ID", "string"), ("IN_NAME", "string"), ("IN_SC_ID", "string")]
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [("01", "Banks", "FI"), ("02", "Short", None), ("AB", "Airlines", "IN")]


def test_incremental_batch_drops_cdc(spark, tmp_path):
    p = str(tmp_path / "DailyMarket.txt")
    _write_text(p, ["I|123|2020-01-02|S1|1.00|1.10|0.90|100"])
    df = read_market_batch(spark, p, incremental=True)
    assert df.columns == ["DM_DATE", "DM_S_SYMB", "DM_CLOSE", "DM_HIGH", "DM_LOW", "DM_VOL"]
    assert tuple(df.collect()[0]) == ("2020-01-02", "S1", "1.00", "1.10", "0.90", "100")


def test_read_lines_by_name_pattern(spark, tmp_path):
    for name, line in [("Batch1/FINWIRE1995Q1", "a|b"), ("Batch1/FINWIRE1995Q2", 'c"d'),
                       ("Batch1/FINWIRE1995Q1_audit", "audit"), ("Batch2/FINWIRE1996Q4", "e"),
                       ("Batch1/FINWIRE1995Q5", "bad quarter"), ("Batch1/Other.txt", "x")]:
        _write_text(str(tmp_path / name), [line])
    glob = str(tmp_path / "Batch*/FINWIRE*")
    names = [p.rsplit("/", 1)[-1] for p in list_matching(spark, glob, r"FINWIRE\d{4}Q[1-4]\b")]
    assert names == ["FINWIRE1995Q1", "FINWIRE1995Q2", "FINWIRE1996Q4"]
    df = read_lines(spark, glob, name_regex=r"FINWIRE\d{4}Q[1-4]\b", with_source=True, line_col="line")
    assert sorted(tuple(r) for r in df.collect()) == [
        ("a|b", "FINWIRE1995Q1"), ('c"d', "FINWIRE1995Q2"), ("e", "FINWIRE1996Q4")]
    # the Hadoop glob alone selects the same files
    assert read_lines(spark, str(tmp_path / "Batch*/FINWIRE*Q[1-4]")).count() == 3


def test_write_delimited_round_trip(spark, tmp_uri):
    df = spark.createDataFrame([("01", "Banks", "FI")], "IN_ID string, IN_NAME string, IN_SC_ID string")
    write_delimited(df, tmp_uri + "/ind")
    back = read_delimited(spark, tmp_uri + "/ind", df.columns)
    assert back.collect() == df.collect()


def test_partitioned_write_and_pruned_read(spark, tmp_uri):
    df = spark.range(0, 1000).select((F.col("id") % 5 + 1995).cast("int").alias("YearID"), F.col("id"))
    write_table(df, tmp_uri + "/fact", partition_by=["YearID"])
    back = read_table(spark, tmp_uri + "/fact").filter(F.col("YearID") == 1997)
    assert back.count() == 200
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(YearID" in plan and "(YearID#" in plan


def test_overwrite_replaces(spark, tmp_uri):
    write_table(spark.range(5), tmp_uri + "/t")
    write_table(spark.range(2), tmp_uri + "/t", mode="overwrite")
    assert read_table(spark, tmp_uri + "/t").count() == 2


def test_split_write_branches_add_up(spark, tmp_uri):
    from lakebuild import fixtures as fx
    lines = fx.finwire_lines(spark, "/root/testdata/sf0.001")
    parts = split_by_record_type(lines, {"CMP": LAYOUT_CMP, "SEC": LAYOUT_SEC, "FIN": LAYOUT_FIN})
    assert sum(p.count() for p in parts.values()) == lines.count()
    targets = {rt: (lay, f"{tmp_uri}/{rt}") for rt, lay in
               {"CMP": LAYOUT_CMP, "SEC": LAYOUT_SEC, "FIN": LAYOUT_FIN}.items()}
    write_split(lines, targets, staging=f"{tmp_uri}/_staged")
    for rt, df in parts.items():
        back = read_table(spark, f"{tmp_uri}/{rt}")
        assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0
