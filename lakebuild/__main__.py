"""Run pipeline steps from the command line.

    python -m lakebuild --root s3a://bucket/sf10 industry finwire dim_company
    python -m lakebuild --root file:/data/sf1 all --fmt parquet --typed

Each step reads what the previous one wrote under ``--root`` (raw/ must hold
the landed feeds).
"""

from __future__ import annotations

import argparse

from .paths import LakePaths
from .plans.pipelines import FINWIRE_GLOB, FINWIRE_REGEX, run_all
from .session import get_spark

STEPS = ("industry", "finwire", "dim_company", "dim_security", "financial", "fact")


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="lakebuild")
    ap.add_argument("steps", nargs="+", choices=(*STEPS, "all"))
    ap.add_argument("--root", required=True, help="lake root URI (raw/, bronze/, silver/ below it)")
    ap.add_argument("--raw-root", default=None, help="raw layer root if not under --root")
    ap.add_argument("--fmt", default="parquet", help="table format (parquet, delta, ...)")
    ap.add_argument("--typed", action="store_true", help="typed FINWIRE parse (numbers, NULL on bad text)")
    ap.add_argument("--distinct-batches", action="store_true", help="UNION instead of UNION ALL of batches")
    ap.add_argument("--company-join", default="inner", choices=("inner", "left"))
    ap.add_argument("--versions", default="all", choices=("all", "current", "as_of"), help="company versions a reference resolves to")
    ap.add_argument("--fact-how", default="inner", choices=("inner", "left"), help="keep market rows without a security version")
    ap.add_argument("--skip-nulls", action="store_true", help="security keys leave out a missing company")
    ap.add_argument("--on-error", default="fail", choices=("fail", "null"), help="malformed dates and timestamps")
    ap.add_argument("--split", default="day", choices=("day", "hour", "month", "year", "none"), help="segments of a history")
    ap.add_argument("--period", default="year", choices=("day", "month", "year", "none"), help="segments of the interval joins")
    ap.add_argument("--glob", default=FINWIRE_GLOB, help="FINWIRE files below raw/")
    ap.add_argument("--name-regex", default=FINWIRE_REGEX, help="FINWIRE file names ('' for all that the glob finds)")
    ap.add_argument("--trim", default="spaces", choices=("spaces", "whitespace", "none"), help="what is cut from FINWIRE fields")
    ap.add_argument("--batch-file", action="append", default=[], metavar="N=PATH", help="path of DailyMarket batch N (repeatable)")
    ap.add_argument("--quarantine", action="store_true", help="malformed market lines go to bronze dailymarket_rejects")
    ap.add_argument("--placeholders", default="int", choices=("int", "text"), help="type of the placeholder measures")
    ap.add_argument("--master", default=None)
    a = ap.parse_args(argv)
    steps = STEPS if "all" in a.steps else tuple(s for s in STEPS if s in a.steps)
    spark = get_spark(a.master)
    out = run_all(spark, LakePaths(a.root, raw_root=a.raw_root), fmt=a.fmt, typed=a.typed,
                  distinct_batches=a.distinct_batches, company_join=a.company_join, steps=steps,
                  versions=a.versions, fact_how=a.fact_how, skip_nulls=a.skip_nulls, on_error=a.on_error,
                  split=None if a.split == "none" else a.split, period=None if a.period == "none" else a.period,
                  glob=a.glob, name_regex=a.name_regex or None, trim=a.trim, quarantine=a.quarantine, placeholders=a.placeholders,
                  batch_files={int(n): p for n, p in (x.split("=", 1) for x in a.batch_file)} or None)
    for name, path in out.items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
