"""with_validity moves its wide rows twice (folded, and to their interval), whoever else reads them."""

import re

import pytest
from pyspark.sql import functions as F

from lakebuild.operators import with_validity
from lakebuild.operators.lookup import expand_copies

PLAN = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}


@pytest.fixture
def plain_plans(spark):
    old = {k: spark.conf.get(k) for k in PLAN}
    for k, v in PLAN.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _versions(spark, n=60):
    day = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    return spark.range(n).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
                                 F.when(F.col("id") % 5 > 0, day + F.make_dt_interval(F.col("id") % 5)).alias("ts"),
                                 (F.col("id") % 4).alias("v"), F.repeat(F.lit("wide"), 9).alias("w"),
                                 F.when(F.col("id") % 11 > 0, F.col("id") % 3 - 1).alias("n"))


@pytest.mark.parametrize("copies", [None, "n"])
def test_wide_rows_are_shuffled_twice(spark, plain_plans, tmp_path, copies):
    _versions(spark).write.parquet(str(tmp_path / "t"))  # a column of one value would be folded out of the plan
    df = spark.read.parquet(str(tmp_path / "t"))
    out = with_validity(df if copies else df.drop("n"), "k", "ts", ["v", "w"], copies=copies)
    formatted = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    inputs = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", formatted)
    assert sum("w#" in i for i in inputs) == 2, inputs


@pytest.mark.parametrize("split", ["day", "month"])
def test_ties_nulls_and_no_copies_equal_one_window(spark, split):
    df = _versions(spark)
    got = with_validity(df, "k", "ts", ["v", "w"], split=split, copies="n").collect()
    want = with_validity(expand_copies(df, "n"), "k", "ts", ["v", "w"], split=None).collect()
    assert len(got) == len(want)  # rows of no copies vanish
    plain = df.drop("n")
    assert sorted(map(repr, with_validity(plain, "k", "ts", ["v", "w"], split=split).collect())) == \
           sorted(map(repr, with_validity(plain, "k", "ts", ["v", "w"], split=None).collect()))
