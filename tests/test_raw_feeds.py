"""The raw layer holds what a query needs, compressed; a query runs only the steps that lead to it."""

import glob
import os

from lakebuild import catalog, fixtures as fx

SF = "/root/testdata/sf0.001"


def _files(root, name):
    return [p for p in glob.glob(f"{root}/raw/{name}/part-*")]


def test_feeds_are_written_on_demand_compressed_and_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fx, "LINES_PER_FILE", 100)
    root = str(tmp_path / "landing")
    raw = fx.write_raw(spark, SF, root="file:" + root, feeds=["market"])
    assert not os.path.exists(f"{root}/raw/Batch1/Industry.txt") and not glob.glob(f"{root}/raw/Batch1/FINWIRE*")
    raw = fx.write_raw(spark, SF, root="file:" + root)
    assert _files(root, "Batch1/Industry.txt")
    for n in (1, 2, 3):
        made = fx.market_feed(spark, SF, n)
        stored = spark.read.text(raw.batch(n, "DailyMarket.txt"))
        assert sorted(r.value for r in stored.collect()) == sorted(r.value for r in made.collect())
        files = _files(root, f"Batch{n}/DailyMarket.txt")
        assert all(p.endswith(".gz") for p in files) and len(files) >= made.count() / 100
    stored = spark.read.text(raw.raw("Batch1/FINWIRE????Q[1-4]"))
    lines = fx.finwire_lines(spark, SF).unionByName(fx.junk_lines(spark, SF).select("value"))
    assert sorted(r.value for r in stored.collect()) == sorted(r.value for r in lines.collect())
    assert all(p.endswith(".gz") for p in _files(root, "Batch1/FINWIRE1997Q1"))


def test_a_query_runs_only_the_steps_before_it(spark, monkeypatch):
    ran = []
    monkeypatch.setattr(catalog, "_LAKES", {})
    run_all = catalog.pl.run_all
    monkeypatch.setattr(catalog.pl, "run_all", lambda spark, lake, steps: (ran.append(tuple(steps)), run_all(spark, lake, steps=steps)))
    assert catalog.QUERIES["company_industry_inner"](spark, SF).count() > 0
    assert ran == [("finwire",), ("industry",)]
    assert catalog.QUERIES["security_key_null"](spark, SF).count() > 0
    assert ran[2:] == [("dim_company",)]
    assert catalog.QUERIES["dim_security"](spark, SF).count() > 0 and len(ran) == 3
    assert catalog.QUERIES["point_in_time_inner"](spark, SF).count() > 0
    assert ran[3:] == [("dim_security",)]


def _some_nulls(spark, folder):
    """Small tables in which every column that stands in a FINWIRE record is null in some row."""
    from pyspark.sql import functions as F
    for name, cols in (("orders", ("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority")),
                       ("customer", ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        n = F.pmod(F.xxhash64(*df.columns), F.lit(40))
        df.withColumns({c: F.when(n != i, F.col(c)) for i, c in enumerate(cols)}).write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_audit_counts_every_line_without_building_it(spark, tmp_path):
    for sf in (SF, _some_nulls(spark, f"file:{tmp_path}")):
        stamps = fx.finwire_stamps(spark, sf)
        got = stamps.groupBy(fx.quarter_file(stamps["time"], 6).alias("fname"), "rt").count().collect()
        lines = fx.finwire_lines(spark, sf)
        made = lines.groupBy(fx.quarter_file(lines["value"]).alias("fname"), lines["value"].substr(16, 3).alias("rt")).count().collect()
        assert sorted(map(str, got)) == sorted(map(str, made)) and len(got) > 60
        assert "pad(" not in stamps._jdf.queryExecution().optimizedPlan().toString()


def test_pads_are_laid_on_at_once(spark):
    plan = fx.cmp_lines(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "pad(" in plan and ",  )" not in plan and ", 0)" not in plan  # a pad of one character is copied once per place
