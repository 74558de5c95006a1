"""As-of resolution and point-in-time joins on overlapping, touching and very long histories, by brute force."""
import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakebuild.operators import point_in_time_join, resolve_reference, with_validity
from lakebuild.operators.lookup import expand_copies, resolution_table, resolution_timeline

BASE = dt.datetime(2020, 1, 1)
OPEN = dt.datetime(9999, 12, 31)


def hours(n):
    return BASE + dt.timedelta(hours=n)


def versions_of(rng, n=160):
    """(id, name, start, end): overlaps, empty intervals, names that are ids, nulls, open ends."""
    out = []
    for _ in range(n):
        a = rng.randint(0, 2000)
        b = rng.choice([hours(a + rng.randint(0, 900)), OPEN, hours(a)])
        out.append((rng.choice(["1", "2", "3", "4", None]), rng.choice(["Acme", "Beta", "2", "3", "9", None]), hours(a), b))
    return out


def resolve_brute(facts, dim, alive):
    """The two left joins and their coalesce, row by row."""
    out = Counter()
    for fid, ref, at in facts:
        by_id = [i for i, _, s, e in dim if ref is not None and i == ref and alive(s, e, at)]
        by_name = [i for i, n, s, e in dim if ref is not None and n == ref and alive(s, e, at)]
        for i in by_id or [None]:
            for n in by_name or [None]:
                out[(fid, i if i is not None else n)] += 1
    return out


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("period", ["month", "day", "year", None])
def test_as_of_equals_the_two_joins(spark, seed, period):
    rng = random.Random(seed)
    dim = versions_of(rng)
    facts = [(k, rng.choice(["1", "2", "3", "4", "9", "Acme", "Beta", "NOBODY", None]),
              rng.choice([hours(rng.randint(-50, 3000)), hours(rng.randint(0, 60) * 24), None])) for k in range(250)]
    d = spark.createDataFrame(dim, "cid string, name string, s timestamp_ntz, e timestamp_ntz")
    f = spark.createDataFrame(facts, "fid int, ref string, at timestamp_ntz")
    got = resolve_reference(f, "ref", d, "cid", "name", out="hit", versions="as_of", at=F.col("at"), start="s", end="e", period=period)
    assert got.columns == ["fid", "ref", "at", "hit"]
    want = resolve_brute(facts, dim, lambda s, e, at: at is not None and s <= at < e)
    assert Counter((r.fid, r.hit) for r in got.collect()) == want


@pytest.mark.parametrize("seed", range(3))
def test_all_versions_equal_the_two_joins(spark, seed):
    rng = random.Random(seed)
    dim = versions_of(rng, 40)
    facts = [(k, rng.choice(["1", "2", "3", "9", "Acme", "NOBODY", None]), BASE) for k in range(30)]
    d = spark.createDataFrame(dim, "cid string, name string, s timestamp_ntz, e timestamp_ntz")
    f = spark.createDataFrame(facts, "fid int, ref string, at timestamp_ntz")
    got = resolve_reference(f, "ref", d, "cid", "name", out="hit")
    assert Counter((r.fid, r.hit) for r in got.collect()) == resolve_brute(facts, dim, lambda *_: True)
    counted = resolve_reference(f, "ref", d, "cid", "name", out="hit", copies="n")
    assert dict(counted.dtypes)["n"] == "bigint"
    assert sum((Counter({(r.fid, r.hit): r.n}) for r in counted.collect()), Counter()) == resolve_brute(facts, dim, lambda *_: True)


def test_timeline_of_an_unbroken_history_is_one_row(spark):
    """10,000 versions that tile collapse to one interval before the sweep."""
    v = spark.range(10_000).select(F.lit("7").alias("cid"), F.lit("Acme").alias("name"),
                                   (F.lit(BASE).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id"))).alias("s"))
    dim = with_validity(v, "cid", "s", [], end="e")
    rows = resolution_timeline(dim, "cid", "name", "s", "e").collect()
    assert sorted((r["__v"], r["__s"], r["__hit"], r["__mult"]) for r in rows) == [("7", BASE, "7", 1), ("Acme", BASE, "7", 1)]


def test_one_name_borne_by_100_000_companies(spark):
    """The resolution table of a hot name is spread over tasks and exact."""
    n = 100_000
    dim = spark.range(n).select(F.lpad(F.col("id").cast("string"), 10, "0").alias("cid"), F.lit("Acme Holding").alias("name"))
    f = spark.createDataFrame([(1, "Acme Holding"), (2, "0000000005"), (3, "x")], "fid int, ref string")
    got = resolve_reference(f, "ref", dim, "cid", "name", out="hit").groupBy("fid").agg(F.count("*"), F.countDistinct("hit")).collect()
    assert sorted(tuple(r) for r in got) == [(1, n, n), (2, 1, 1), (3, 1, 0)]
    plan = resolution_table(dim, "cid", "name")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect" not in plan


def test_copies_are_64_bit_and_in_blocks(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 200_000), ("d", 0), ("e", -1)], "k string, n long")
    got = expand_copies(df, "n").groupBy("k").count().collect()
    assert sorted(tuple(r) for r in got) == [("a", 1), ("b", 3), ("c", 200_000)]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("dates", [True, False])
def test_point_in_time_brute_force(spark, how, dates):
    """Overlapping histories, intervals without a midnight, keys and instants that are NULL; any period gives the same rows."""
    rng = random.Random(11)
    dim = [(i, n or "-", s, e) for i, n, s, e in versions_of(rng, 120)]
    dim += [("4", f"short{k}", hours(24 * k + 3), hours(24 * k + rng.choice([5, 20, 21, 22]))) for k in range(30)]
    facts = [(k, rng.choice(["1", "2", "4", "8", None]), rng.choice([hours(rng.randint(-40, 2500)), hours(24 * rng.randint(0, 90)), None])) for k in range(200)]
    d = spark.createDataFrame(dim, "cid string, v string, s timestamp_ntz, e timestamp_ntz")
    f = spark.createDataFrame(facts, "fid int, key string, at timestamp_ntz")
    at = F.to_date("at") if dates else F.col("at")
    want = Counter()
    for fid, key, t in facts:
        t = t and (dt.datetime(t.year, t.month, t.day) if dates else t)
        hits = [v for i, v, s, e in dim if key is not None and i == key and t is not None and s <= t < e]
        for v in hits or ([None] if how == "left" else []):
            want[(fid, v)] += 1
    for period in ("month", "day", "year", None):
        got = point_in_time_join(f, d, "key", "cid", at=at, dim_cols=["v"], start="s", end="e", how=how, period=period)
        assert got.columns == ["fid", "key", "at", "v"]
        assert Counter((r.fid, r.v) for r in got.collect()) == want, period


def test_long_history_is_not_compared_with_every_fact(spark):
    """A key with 10,000 versions: candidate pairs of the join stay near the facts, not facts x versions."""
    v = spark.range(10_000).select(F.lit("HOT").alias("k"), (F.lit(BASE).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id") * 6)).alias("s"))
    dim = with_validity(v, "k", "s", [], end="e")
    facts = spark.range(20_000).select("id", F.lit("HOT").alias("k"), F.date_add(F.lit(BASE).cast("date"), (F.col("id") % 2400).cast("int")).alias("d"))
    j = point_in_time_join(facts, dim, "k", "k", at=F.col("d"), dim_cols=[F.col("s").alias("from")], start="s", end="e", period="month")
    assert j.count() == 20_000 and j.where("`from` > d").count() == 0
    # versions without a midnight are gone, the others lie in the one month of the fact
    kept = dim.filter("s < e").filter("date_trunc('day', e - interval 1 microsecond) >= s or date_trunc('day', s) = s")
    per_month = kept.groupBy(F.year("s"), F.month("s")).count().agg(F.max("count")).first()[0]
    assert per_month <= 32


def test_refuses_unknown_choices(spark):
    df = spark.createDataFrame([("1", "a", BASE, OPEN)], "cid string, name string, s timestamp_ntz, e timestamp_ntz")
    with pytest.raises(ValueError):
        point_in_time_join(df, df, "cid", "cid", at=F.col("s"), start="s", end="e", period="week")
    with pytest.raises(ValueError):
        resolve_reference(df, "name", df, "cid", "name", versions="as_of")
