"""Print the final (post-AQE) physical plan tree of each pipeline step.

Usage: python tools/show_plans.py [sf_dir] > PLANS.md
Each step is run (written to a scratch table) first, so the adaptive plan shown
is the one that actually executed.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from lakebuild import fixtures as fx  # noqa: E402
from lakebuild.paths import LakePaths  # noqa: E402
from lakebuild.plans import pipelines as pl  # noqa: E402
from lakebuild.session import get_spark, scratch_path  # noqa: E402
from lakebuild.sources import read_lines, read_table  # noqa: E402
from lakebuild.catalog import QUERIES  # noqa: E402
from lakebuild.functions import parse_fixed_width, record_type  # noqa: E402
from lakebuild.layouts import LAYOUT_CMP  # noqa: E402


def tree(df, width: int = 150) -> str:
    txt = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    return "\n".join(line if len(line) <= width else line[:width] + " ..." for line in txt.strip().splitlines())


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=8)
    raw = fx.write_raw(spark, sf_dir)
    lake = LakePaths(scratch_path(spark, "plans", unique=True), raw_root=raw.root)
    pl.run_all(spark, lake)
    at = scratch_path(spark, "plans-staged", unique=True)
    lines = read_lines(spark, lake.raw(pl.FINWIRE_GLOB), name_regex=pl.FINWIRE_REGEX)
    lines.select(F.col("value").alias("line"), record_type(F.col("value")).alias("rt")).filter(F.col("rt").isin("CMP", "SEC", "FIN")) \
         .write.partitionBy("rt").parquet(at)
    staged = spark.read.parquet(at)
    steps = {
        "PL2 stg_finwire (CMP branch over the staged record-type partitions)":
            lambda: parse_fixed_width(staged.filter("rt = 'CMP'"), LAYOUT_CMP, "CMP", line_col="line"),
        "PL2 raw scan by name pattern":
            lambda: read_lines(spark, lake.raw(pl.FINWIRE_GLOB), name_regex=pl.FINWIRE_REGEX),
        "PL3 dim_company": lambda: pl.build_dim_company(read_table(spark, lake.bronze("finwire_cmp")),
                                                        read_table(spark, lake.bronze("industry"))),
        "PL4 dim_security": lambda: pl.build_dim_security(read_table(spark, lake.bronze("finwire_sec")),
                                                          read_table(spark, lake.silver("dimcompany"))),
        "PL5 financial": lambda: pl.build_financial(read_table(spark, lake.bronze("finwire_fin")),
                                                    read_table(spark, lake.silver("dimcompany"))),
        "PL6 fact_market_history": lambda: pl.build_fact_market_history(
            pl.union_batches(pl.market_batches(spark, lake)), read_table(spark, lake.silver("dimsecurity"))),
        "JO3 financial, company as of the record": lambda: pl.build_financial(
            read_table(spark, lake.bronze("finwire_fin")), read_table(spark, lake.silver("dimcompany")), versions="as_of"),
        "SK4 dim_security in SQL over the operators' views": lambda: QUERIES["sql_view_dim_security"](spark, sf_dir),
        "SK2 partition-pruned read of the fact table": lambda: read_table(
            spark, lake.silver("FactMarketHistory")).filter("YearID = 1997"),
    }
    print(f"# Physical plans\n\nFinal adaptive plans at `{sf_dir}`, local[8], generated by "
          f"`tools/show_plans.py`. At this size AQE turns most joins into broadcasts from measured "
          f"sizes; beyond the threshold the same plans stay sort-merge.\n")
    for title, make in steps.items():
        df = make()
        df.collect()  # run this very plan so AQE's final plan is shown
        print(f"## {title}\n\n```\n{tree(df)}\n```\n")


if __name__ == "__main__":
    main(sys.argv)
