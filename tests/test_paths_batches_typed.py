from pyspark.sql import functions as F

from lakebuild import fixtures as fx
from lakebuild.paths import LakePaths
from lakebuild.plans import pipelines as pl
from lakebuild.sources import read_table

SF = "/root/testdata/sf0.001"


def test_lake_paths_layers():
    p = LakePaths("abfss://c@acct.dfs.core.windows.net/sf10/")
    assert p.raw("Batch1", "Industry.txt") == "abfss://c@acct.dfs.core.windows.net/sf10/raw/Batch1/Industry.txt"
    assert p.bronze("finwire_cmp") == "abfss://c@acct.dfs.core.windows.net/sf10/bronze/spark/finwire_cmp"
    assert p.silver("dimcompany") == "abfss://c@acct.dfs.core.windows.net/sf10/silver/spark/dimcompany"
    q = LakePaths("s3a://lake/sf1", engine="x", raw_root="s3a://landing/sf1")
    assert q.batch(2, "DailyMarket.txt") == "s3a://landing/sf1/raw/Batch2/DailyMarket.txt"
    assert q.silver("f") == "s3a://lake/sf1/silver/x/f"


def test_batch_file_mapping(spark, tmp_path):
    raw = fx.write_raw(spark, SF, root="file:" + str(tmp_path / "landing"))
    default = pl.market_batches(spark, raw)
    assert [b for _, b in default] == ["1", "2", "3"]
    n = {b: df.count() for df, b in default}
    # the reference read Batch2's file for batch 3; reproducible only on request
    slip = pl.market_batches(spark, raw, batch_files={1: raw.batch(1, "DailyMarket.txt"),
                                                     2: raw.batch(2, "DailyMarket.txt"),
                                                     3: raw.batch(2, "DailyMarket.txt")})
    m = {b: df for df, b in slip}
    assert m["3"].count() == n["2"] and m["3"].exceptAll(m["2"]).count() == 0
    assert all(df.columns == ["DM_DATE", "DM_S_SYMB", "DM_CLOSE", "DM_HIGH", "DM_LOW", "DM_VOL"]
               for df, _ in default)


def test_typed_run_all(spark, tmp_path):
    raw = fx.write_raw(spark, SF, root="file:" + str(tmp_path / "landing"))
    lake = LakePaths("file:" + str(tmp_path / "lake"), raw_root=raw.root)
    out = pl.run_all(spark, lake, typed=True, steps=("industry", "finwire", "dim_company",
                                                     "dim_security", "financial"))
    fin = read_table(spark, out["financial"])
    types = dict(fin.dtypes)
    assert types["FI_YEAR"] == "int" and types["FI_QTR"] == "tinyint"
    assert types["FI_REVENUE"] == "double" and types["FI_OUT_BASIC"] == "bigint"
    # junk and blanks became NULL, everything else parsed
    assert fin.filter(F.col("FI_REVENUE").isNull()).count() > 0
    assert fin.filter(F.col("FI_OUT_DILUT").isNull()).count() == 0
    sec = dict(read_table(spark, out["dimsecurity"]).dtypes)
    assert sec["SharesOutstanding"] == "bigint" and sec["DIVIDEND"] == "double"
