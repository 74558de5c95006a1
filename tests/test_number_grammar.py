"""The typed parse accepts what the declared grammar accepts, checked against Python's own readers of ASCII numbers."""
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lakebuild.functions import parse_fixed_width, rejected_counts, tolerant_cast
from lakebuild.layouts import LAYOUT_FIN

TEXTS = ["", "0", "7", "-7", "+7", "007", "1_000", "1__0", "_1", "1_", "1.5", "1.", ".5", ".", "1e3", "1E-3", "1e", "e3", "1_0.0_1e1_0", "nan", "NaN", "-nan",
         "+NAN", "inf", "Infinity", "-iNf", "infin", "0x10", "1.5d", "1,5", "12 3", "--1", "+-1", "1.5.2", "9" * 25, "-9223372036854775808", "9223372036854775808",
         "128", "-129", "1e400", "true", "null", "n/a"]


def python_int(t):
    try:
        return int(t) if t else None
    except ValueError:
        return None


def python_float(t):
    try:
        return float(t) if t else None
    except ValueError:
        return None


def same(a, b):
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


def texts():
    rng = random.Random(1)
    made = ["".join(rng.choice("01_.e+-") for _ in range(rng.randint(1, 7))) for _ in range(1500)]
    return TEXTS + made + ["".join(x) for x in itertools.product("1_.", repeat=3)]


@pytest.mark.parametrize("dtype,low,high", [("tinyint", -128, 127), ("int", -2 ** 31, 2 ** 31 - 1), ("bigint", -2 ** 63, 2 ** 63 - 1)])
def test_integers(spark, dtype, low, high):
    df = spark.createDataFrame([(t,) for t in texts()], "t string").select("t", tolerant_cast(F.col("t"), dtype).alias("n"))
    for r in df.collect():
        want = python_int(r.t)
        assert r.n == (want if want is not None and low <= want <= high else None), r.t


def test_reals(spark):
    df = spark.createDataFrame([(t,) for t in texts()], "t string").select("t", tolerant_cast(F.col("t"), "double").alias("n"))
    for r in df.collect():
        assert same(r.n, python_float(r.t)), r.t


def test_rejected_values_are_named_and_counted(spark):
    def line(revenue, eps, sh_out, ref="x"):
        return ("20200101-000000FIN" + "2020" + "1" + "20200101" + "20200201" + revenue.rjust(17) + " " * 17 + eps.rjust(12) + " " * 12 + "0.25".rjust(12)
                + "1".rjust(17) * 3 + sh_out.rjust(13) + "5".rjust(13) + ref)
    rows = [line("1_000", "nan", "7"), line("n/a", "1__0", "inf"), line("", "\t", "1e3"), line("\t12\t", "-inf", "+3")]
    df = parse_fixed_width(spark.createDataFrame([(x,) for x in rows], "value string"), LAYOUT_FIN, "FIN", typed=True, rejected="bad")
    got = df.select("REVENUE", "EPS", "SH_OUT", "bad").collect()
    assert [r.bad for r in got] == [[], ["REVENUE", "EPS", "SH_OUT"], ["SH_OUT"], []]
    assert got[0].REVENUE == 1000.0 and math.isnan(got[0].EPS) and got[0].SH_OUT == 7
    assert got[2].REVENUE is None and got[2].EPS is None and got[3].REVENUE == 12.0 and got[3].SH_OUT == 3
    assert sorted(tuple(r) for r in rejected_counts(df, "bad").collect()) == [("EPS", 1), ("REVENUE", 1), ("SH_OUT", 2)]
