import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lakebuild.operators import as_of, current_only, with_validity

OPEN = dt.datetime(9999, 12, 31)
T = dt.datetime


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("split", [None, "day", "hour"])
def test_one_two_many_versions(spark, split):
    data = [("a", T(2020, 1, 1), 1),
            ("b", T(2020, 1, 1), 1), ("b", T(2020, 2, 1), 2),
            ("c", T(2020, 1, 1, 10), 1), ("c", T(2020, 1, 1, 12), 2), ("c", T(2021, 1, 1), 3)]
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, v int")
    out = {(r.k, r.v): (r.end_timestamp, r.iscurrent)
           for r in with_validity(df, "k", "ts", ["v"], split=split).collect()}
    assert out[("a", 1)] == (OPEN, True)
    assert out[("b", 1)] == (T(2020, 2, 1), False) and out[("b", 2)] == (OPEN, True)
    assert out[("c", 1)] == (T(2020, 1, 1, 12), False)
    assert out[("c", 2)] == (T(2021, 1, 1), False) and out[("c", 3)] == (OPEN, True)


@pytest.mark.parametrize("split", [None, "day"])
def test_ties_broken_by_order_columns(spark, split):
    data = [("k", T(2020, 1, 1), "x"), ("k", T(2020, 1, 1), "y"), ("k", T(2020, 3, 1), "z")]
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, v string")
    out = {r.v: r.end_timestamp for r in with_validity(df, "k", "ts", ["v"], split=split).collect()}
    assert out == {"x": T(2020, 1, 1), "y": T(2020, 3, 1), "z": OPEN}


def test_split_equals_plain_window_on_random_histories(spark):
    rnd = random.Random(7)
    data = []
    for i in range(600):
        k = rnd.choice(["hot"] * 5 + ["a", "b", "c", None])
        ts = None if rnd.random() < 0.03 else T(2020, 1, 1) + dt.timedelta(hours=rnd.randrange(0, 24 * 40))
        data.append((k, ts, rnd.randrange(0, 3), i))
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, g int, id int")
    plain = with_validity(df, ["k", "g"], "ts", ["id"], split=None)
    for split in ("day", "hour", "month"):
        assert _rows(with_validity(df, ["k", "g"], "ts", ["id"], split=split)) == _rows(plain)


def test_invariants_no_overlap_one_current(spark):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    v = with_validity(o.select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("s")),
                      "o_custkey", "s", ["o_orderkey"])
    assert v.groupBy("o_custkey").agg(F.sum(F.col("iscurrent").cast("int")).alias("n")) \
            .filter("n != 1").count() == 0
    # intervals of a key tile time: each end is the next start
    assert v.filter(F.col("end_timestamp") < F.col("s")).count() == 0
    assert v.count() == o.count()


def test_current_and_as_of(spark):
    data = [("k", T(2020, 1, 1), 1), ("k", T(2020, 6, 1), 2)]
    v = with_validity(spark.createDataFrame(data, "k string, ts timestamp_ntz, n int"), "k", "ts", ["n"])
    assert [r.n for r in current_only(v).collect()] == [2]
    at = F.lit("2020-03-01 00:00:00").cast("timestamp_ntz")
    assert [r.n for r in as_of(v, at, "ts").collect()] == [1]
    at_start = F.lit("2020-06-01 00:00:00").cast("timestamp_ntz")
    assert [r.n for r in as_of(v, at_start, "ts").collect()] == [2]


def test_split_plan_shuffles_big_side_once(spark):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    v = with_validity(o, "o_custkey", "o_orderdate", ["o_orderkey"])
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("split", [None, "day"])
def test_copies_equal_expanding_first(spark, split):
    from lakebuild.operators.lookup import expand_copies
    data = [("k", T(2020, 1, 1), "a", 3), ("k", T(2020, 1, 1), "b", 2), ("k", T(2020, 2, 1), "a", 1),
            ("k", T(2020, 2, 1), "a", 2),  # identical to the next row apart from its count
            ("j", T(2020, 1, 5), "z", 4), ("j", None, "n", 2)]
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, v string, n int")
    compact = with_validity(df, "k", "ts", ["v"], split=split, copies="n")
    expanded = with_validity(expand_copies(df, "n"), "k", "ts", ["v"], split=split)
    assert _rows(compact) == _rows(expanded)
    assert compact.count() == sum(r[3] for r in data)
