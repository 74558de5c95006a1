import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakebuild.operators import point_in_time_join, resolve_reference, union_batches, with_validity

T = dt.datetime


@pytest.fixture()
def dim(spark):
    data = [("0000000001", "Acme", T(2020, 1, 1)), ("0000000001", "Acme", T(2021, 1, 1)),
            ("0000000002", "Beta", T(2020, 1, 1)),
            ("0000000003", "0000000002", T(2020, 1, 1))]  # a name that looks like an id
    df = spark.createDataFrame(data, "Companyid string, Name string, effective_timestamp timestamp_ntz")
    return with_validity(df, "Companyid", "effective_timestamp", ["Name"])


def _facts(spark):
    return spark.createDataFrame(
        [("f1", "0000000001", T(2020, 6, 1)),   # id hit, two versions
         ("f2", "Beta", T(2020, 6, 1)),         # name hit
         ("f3", "0000000002", T(2020, 6, 1)),   # id hit AND name hit (company 3's name)
         ("f4", "NOBODY", T(2020, 6, 1)),       # none
         ("f5", None, T(2020, 6, 1))],          # null reference
        "fid string, ref string, at timestamp_ntz")


def test_all_versions_fans_out(spark, dim):
    r = resolve_reference(_facts(spark), "ref", dim, "Companyid", "Name", out="cid", versions="all")
    got = sorted((x.fid, x.cid) for x in r.collect())
    assert got == [("f1", "0000000001"), ("f1", "0000000001"), ("f2", "0000000002"),
                   ("f3", "0000000002"), ("f4", None), ("f5", None)]


def test_current_and_as_of_one_row_each(spark, dim):
    for versions in ("current", "as_of"):
        r = resolve_reference(_facts(spark), "ref", dim, "Companyid", "Name", out="cid",
                              versions=versions, at=F.col("at"))
        got = sorted((x.fid, x.cid) for x in r.collect())
        assert got == [("f1", "0000000001"), ("f2", "0000000002"), ("f3", "0000000002"),
                       ("f4", None), ("f5", None)], versions


def test_as_of_before_first_version_is_unresolved(spark, dim):
    f = spark.createDataFrame([("f", "0000000001", T(2019, 1, 1))], "fid string, ref string, at timestamp_ntz")
    r = resolve_reference(f, "ref", dim, "Companyid", "Name", out="cid", versions="as_of", at=F.col("at"))
    assert [x.cid for x in r.collect()] == [None]


def _security_dim(spark):
    data = [("S1", T(2020, 1, 1, 10), "v1"), ("S1", T(2020, 3, 1), "v2"),
            ("S1", T(2020, 3, 1), "v2dup")]  # tie: empty interval for one of them
    df = spark.createDataFrame(data, "SYMBOL string, effective_timestamp timestamp_ntz, SK string")
    return with_validity(df, "SYMBOL", "effective_timestamp", ["SK"])


def test_point_in_time_edges(spark):
    dim = _security_dim(spark)
    facts = spark.createDataFrame(
        [("2020-01-01",), ("2020-01-02",), ("2020-02-29",), ("2020-03-01",), ("2019-12-31",)], "d string")
    facts = facts.withColumn("sym", F.lit("S1"))
    j = point_in_time_join(facts, dim, "sym", "SYMBOL", at=F.to_date("d"), dim_cols=["SK"])
    got = sorted((r.d, r.SK) for r in j.collect())
    # the 10:00 start on 2020-01-01 applies from the next day (date = midnight)
    assert got == [("2020-01-02", "v1"), ("2020-02-29", "v1"), ("2020-03-01", "v2dup")]
    left = point_in_time_join(facts, dim, "sym", "SYMBOL", at=F.to_date("d"), dim_cols=["SK"], how="left")
    assert left.count() == 5 and left.filter(F.col("SK").isNull()).count() == 2


def test_point_in_time_at_most_one_match(spark):
    dim = _security_dim(spark)
    facts = spark.range(0, 400).select(F.date_add(F.lit("2019-12-01").cast("date"), F.col("id").cast("int")).alias("d"),
                                       F.lit("S1").alias("sym"))
    j = point_in_time_join(facts, dim, "sym", "SYMBOL", at=F.col("d"), dim_cols=["SK"])
    assert j.groupBy("d").count().filter("count > 1").count() == 0


def test_union_batches(spark):
    b1 = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2")], "x string, y string")
    b2 = spark.createDataFrame([("I", "9", "a", "1")], "CDC_FLAG string, CDC_DSN string, x string, y string")
    all_ = union_batches([(b1, "1"), (b2, "2")])
    assert all_.columns == ["x", "y", "BatchID"] and all_.count() == 4
    dist = union_batches([(b1, "1"), (b2, "2")], distinct=True)
    assert sorted(tuple(r) for r in dist.collect()) == [("a", "1", "1"), ("a", "1", "2"), ("b", "2", "1")]
