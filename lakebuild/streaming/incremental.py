"""Incremental fact loading with Structured Streaming.

DailyMarket batches land as files (``Batch1`` full, ``Batch2..`` incremental
with two leading CDC columns). Instead of re-reading every batch, a file
stream picks up each new file once. Every micro-batch is a small batch job:
it reads the dimension as it is at that moment, takes the same parser and the
same point-in-time join as the batch load, and writes its rows to a partition
of its own (``load``), which a repeated micro-batch overwrites. Together with
the checkpoint (under the shared ``spark.checkpoint.dir``) a restarted or
failed run resumes without loss or duplicates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.pipelines import build_fact_market_history
from ..session import DROP_SHUFFLES, held, scratch_path
from ..sources import parse_market_lines, read_table, split_corrupt

#: Partition column that names the micro-batch a fact row came with.
LOAD = "load"


def market_line_stream(spark: SparkSession, glob: str, sep: str = "|",
                       max_files_per_trigger: int | None = None, corrupt: str | None = None) -> DataFrame:
    """Stream of market rows from full and incremental batch files alike.

    ``BatchID`` comes from the ``BatchN`` path part; batch 1 is full, later
    ones are incremental. Lines are parsed as in ``read_market_batch``.
    """
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    batch = F.regexp_extract(F.col("_metadata.file_path"), r"/Batch(\d+)/", 1)
    lines = r.load(glob).select("value", batch.alias("BatchID"))
    df = parse_market_lines(lines, F.col("BatchID") != "1", sep, corrupt=corrupt, keep=["BatchID"])
    return df.select(*[c for c in df.columns if c != "BatchID"], "BatchID")


def stream_fact_market_history(spark: SparkSession, market_glob: str,
                               dim_security: DataFrame | str | Callable[[SparkSession], DataFrame],
                               sink: str, checkpoint: str | None = None,
                               max_files_per_trigger: int | None = None, wait: bool = True,
                               how: str = "inner", on_error: str = "fail", quarantine: str | None = None):
    """Append FactMarketHistory rows for every batch file not yet loaded.

    ``dim_security`` is the path of the stored table, or a function that
    returns it: both are read anew for every micro-batch, so a refreshed
    dimension is picked up. A DataFrame is used as it is. With ``quarantine``
    lines without exactly the expected fields go there (same ``load``
    partitions) and not into the fact. Runs with ``availableNow``: processes
    what is there, then stops.
    """
    # default: one stable checkpoint per sink, so every run continues the last one
    checkpoint = checkpoint or scratch_path(spark, "stream-checkpoints",
                                            hashlib.sha1(sink.encode()).hexdigest()[:16])
    run = hashlib.sha1(checkpoint.encode()).hexdigest()[:8]
    mark = "corrupt_line" if quarantine else None

    def dimension(session: SparkSession) -> DataFrame:
        if isinstance(dim_security, str):
            return read_table(session, dim_security)
        return dim_security(session) if callable(dim_security) else dim_security

    def load(rows: DataFrame, batch: int) -> None:
        at = f"{LOAD}={run}-{batch}"
        if quarantine:
            rows, bad = split_corrupt(rows, mark)
            bad.select("BatchID", F.col(mark).alias("line")).write.mode("overwrite").parquet(f"{quarantine}/{at}")
        fact = build_fact_market_history(rows, dimension(rows.sparkSession), how=how, on_error=on_error)
        with held(fact.sparkSession, DROP_SHUFFLES):
            (fact.hint("rebalance", "YearID").write.mode("overwrite").partitionBy("YearID").parquet(f"{sink}/{at}"))

    market = market_line_stream(spark, market_glob, max_files_per_trigger=max_files_per_trigger, corrupt=mark)
    q = (market.writeStream.foreachBatch(load)
               .option("checkpointLocation", checkpoint)
               .outputMode("append")
               .trigger(availableNow=True)
               .start())
    if wait:
        q.awaitTermination()
    return q
