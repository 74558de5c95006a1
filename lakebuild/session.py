"""SparkSession construction and the shared scratch location."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every lakebuild job relies on. ANSI stays on (Spark 4 default) so a
# malformed value fails loudly unless an operator asks for ``on_error="null"``.
DEFAULT_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "static",
    "spark.scheduler.mode": "FAIR",  # independent pipeline steps share executors
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app_name: str = "lakebuild",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the lakebuild defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; size
    ``shuffle_partitions`` to the input (AQE coalesces small ones anyway).
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only when nothing is configured (local runs, tests) is a private folder
    created and registered, so ``DataFrame.checkpoint()`` and our scratch
    tables always land somewhere every executor can read.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="lakebuild-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, *parts: str, unique: bool = False) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    segs = ["lakebuild", *parts]
    if unique:
        segs.append(uuid.uuid4().hex[:12])
    return "/".join([root, *segs])


#: A job's shuffle files go as soon as the job's rows are written, and not when the driver next collects its garbage.
DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def open_files(n: int) -> dict[str, str]:
    """A task that writes to at most ``n`` folders keeps a file open in each and need not sort (and spill) its rows by folder first."""
    return {"spark.sql.maxConcurrentOutputFileWriters": str(n)}


_HELD: dict[tuple[int, str], list] = {}  # (session, setting) -> [users, value before the first]
_HELD_LOCK = threading.Lock()


@contextmanager
def held(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings for the time of a block; blocks of several threads may overlap, the last one puts the old values back."""
    at = [(spark._jsparkSession.hashCode(), k) for k in conf]
    with _HELD_LOCK:
        for x in at:
            if x not in _HELD:
                _HELD[x] = [0, spark.conf.get(x[1], None)]
            _HELD[x][0] += 1
            spark.conf.set(x[1], conf[x[1]])
    try:
        yield
    finally:
        with _HELD_LOCK:
            for x in at:
                _HELD[x][0] -= 1
                if not _HELD[x][0]:
                    _, before = _HELD.pop(x)
                    spark.conf.unset(x[1]) if before is None else spark.conf.set(x[1], before)


def size_input_splits(spark: SparkSession, input_bytes: int, cores: int | None = None,
                      splits_per_core: int = 3) -> int:
    """Set ``spark.sql.files.maxPartitionBytes`` from the input size.

    About ``splits_per_core`` read tasks per core, between 4 MB and 128 MB:
    small inputs still use every core (downstream stages inherit the file
    count), large inputs keep Spark's usual 128 MB splits.
    """
    cores = cores or spark.sparkContext.defaultParallelism
    split = min(128 << 20, max(4 << 20, input_bytes // max(1, splits_per_core * cores)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    return split
