"""Benchmark: the six medallion steps end to end through files.

Setup (not timed): the raw layer (Industry.txt, FINWIRE quarter files,
DailyMarket batches 1-3) is written once from the test tables at
``$BENCH_SF_DIR``. Timed: ``run_all`` (PL1-PL6, each step reading what the
previous one wrote; independent steps run concurrently) on
``local[$BENCH_CPUS]``; one warm-up run, then the median wall time of
``$BENCH_RUNS`` (default 5) runs. Per-step times overlap. Then the other forms
of the lookups, the fact and its incremental load are timed once each, on the
last run's tables. ``calibration_sec`` is a fixed loop on one core, so that two
machines, or one machine on two days, can be compared. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lakebuild import fixtures as fx  # noqa: E402
from lakebuild.paths import LakePaths  # noqa: E402
from lakebuild.operators import union_batches  # noqa: E402
from lakebuild.plans import pipelines as pl  # noqa: E402
from lakebuild.session import get_spark, scratch_path, size_input_splits  # noqa: E402
from lakebuild.sinks import write_table  # noqa: E402
from lakebuild.sources import read_table  # noqa: E402
from lakebuild.streaming import stream_fact_market_history  # noqa: E402


def raw_bytes(spark, root: str) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def calibration() -> float:
    """Seconds for a fixed amount of work on one core, the best of three."""
    best = float("inf")
    for _ in range(3):
        s = time.perf_counter()
        sum(i * i % 7 for i in range(5_000_000))
        best = min(best, time.perf_counter() - s)
    return best


def variants(spark, lake: LakePaths) -> dict[str, float]:
    """Seconds of the forms that ``run_all`` leaves out by default, each written to a table of its own."""
    sec, fin = (read_table(spark, lake.bronze(f"finwire_{t}")) for t in ("sec", "fin"))
    company, security = (read_table(spark, lake.silver(t)) for t in ("dimcompany", "dimsecurity"))
    market = union_batches(pl.market_batches(spark, lake))
    frames = {
        "dim_security_as_of": lambda: pl.build_dim_security(sec, company, versions="as_of"),
        "financial_as_of": lambda: pl.build_financial(fin, company, versions="as_of"),
        "fact_left": lambda: pl.build_fact_market_history(market, security, how="left"),
        "fact_distinct": lambda: pl.build_fact_market_history(union_batches(pl.market_batches(spark, lake), distinct=True), security),
    }
    out = {}
    for name, build in frames.items():
        s = time.perf_counter()
        write_table(build(), scratch_path(spark, "bench-variant", unique=True))
        out[name] = round(time.perf_counter() - s, 3)
    s = time.perf_counter()
    stream_fact_market_history(spark, lake.raw("Batch*/DailyMarket.txt"), lake.silver("dimsecurity"), scratch_path(spark, "bench-stream", unique=True))
    out["fact_stream"] = round(time.perf_counter() - s, 3)
    return out


def one_run(spark, raw: LakePaths) -> tuple[float, dict[str, float], LakePaths]:
    """One end-to-end run of PL1-PL6; returns (wall seconds, per-step seconds, its lake).

    Independent steps run concurrently inside ``run_all``, so per-step times
    overlap and do not add up to the wall time.
    """
    lake = LakePaths(scratch_path(spark, "bench-lake", unique=True), raw_root=raw.root)
    steps: dict[str, float] = {}
    s = time.perf_counter()
    pl.run_all(spark, lake, timings=steps)
    return time.perf_counter() - s, steps, lake


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(cpus)))
    spark = get_spark(f"local[{cpus}]", app_name="lakebuild-bench", shuffle_partitions=parts,
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    s = time.perf_counter()
    raw = fx.write_raw(spark, sf_dir)
    setup = time.perf_counter() - s
    nbytes = raw_bytes(spark, raw.raw())
    # Input splits sized to the data (about three per core, 4 MB..128 MB).
    split = size_input_splits(spark, nbytes, cpus)
    one_run(spark, raw)  # warm-up: JIT, file-system caches
    results = [one_run(spark, raw) for _ in range(runs)]
    per_step = {k: round(statistics.median(r[1][k] for r in results), 3) for k in results[0][1]}
    totals = [r[0] for r in results]
    total = round(statistics.median(totals), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "pipeline_wall_sec",
        "value": total,
        "unit": "sec",
        "queries": per_step,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "raw_input_mb": round(nbytes / 1e6, 2),
        "input_mb_per_sec": round(nbytes / 1e6 / total, 2),
        "runs": runs,
        "all_totals": [round(x, 3) for x in totals],
        "setup_sec": round(setup, 1),
        "cpus": cpus,
        "split_bytes": split,
        "spark": spark.version,
        "calibration_sec": round(calibration(), 3),
        "variants": variants(spark, results[-1][2]),
    }))


if __name__ == "__main__":
    main()
