"""Writers: overwrite / partitioned table writes, split write, SQL views (SK1-SK4)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_width import parse_fixed_width, record_type
from ..layouts import FieldSpec
from ..session import DROP_SHUFFLES, held, open_files
from ..versions import VERSION, discard, new_version, publish, resolve_version


#: Codec of the Parquet files written here; feeds repeat themselves much, which it finds better than Spark's default.
PARQUET_CODEC = "zstd"


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = (), rebalance: bool = True) -> None:
    """Write ``df`` as a table directory (SK1), optionally partitioned (SK2).

    An overwrite writes a new version beside the old one and publishes it by
    switching one pointer last (``versions``), so a write that fails half-way
    leaves the old table readable, and a table may be overwritten by rows read
    from itself. ``read_table`` resolves the pointer. ``append`` adds files to
    the published version; ``error`` / ``errorifexists`` and ``ignore`` act on
    whether there is one. Delta tables version themselves and are written as
    they are.

    For a partitioned write the rows first go through a REBALANCE on the
    partition columns: AQE then splits a hot partition value (a year holding a
    third of the rows) over several tasks and merges small ones, so the file
    count stays near ``size / advisoryPartitionSizeInBytes`` instead of
    ``tasks x partition values``.
    """
    if mode not in ("overwrite", "append", "error", "errorifexists", "ignore"):
        raise ValueError(f"mode must be overwrite|append|error|errorifexists|ignore, not {mode!r}")
    if partition_by and rebalance:
        df = df.hint("rebalance", *partition_by)

    def save(at: str, how: str) -> None:
        w = df.write.format(fmt).mode(how)
        if fmt == "parquet":
            w = w.option("compression", PARQUET_CODEC)
        if partition_by:
            w = w.partitionBy(*partition_by)
        with held(spark, DROP_SHUFFLES):
            w.save(at)

    spark = df.sparkSession
    if fmt == "delta":
        save(path, mode)
        return
    current = resolve_version(spark, path)
    if current and mode != "overwrite":
        save(current, mode)
        return
    name = new_version()
    at = f"{path.rstrip('/')}/{VERSION}{name}"
    try:
        save(at, "errorifexists")
    except BaseException:
        discard(spark, at)
        raise
    publish(spark, path, name)


def write_lines(df: DataFrame, path: str, mode: str = "overwrite", line_col: str = "value",
                compression: str | None = None, max_lines: int = 0, options: Mapping[str, str] | None = None) -> None:
    """One text column as text files, of at most ``max_lines`` lines each if given; ``options`` go to the writer."""
    w = df.select(F.col(line_col).alias("value")).write.mode(mode).options(**(options or {}))
    if compression:
        w = w.option("compression", compression)
    if max_lines:
        w = w.option("maxRecordsPerFile", max_lines)
    w.text(path)


def write_delimited(df: DataFrame, path: str, sep: str = "|", mode: str = "overwrite") -> None:
    """Headerless delimited text of all columns (values must not contain ``sep``)."""
    line = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    df.select(line.alias("value")).write.mode(mode).text(path)


def split_by_record_type(lines: DataFrame, layouts: Mapping[str, Sequence[FieldSpec]],
                         typed: bool = False, line_col: str = "value") -> dict[str, DataFrame]:
    """One lazily parsed table per record type from one mixed feed (SK3)."""
    return {rt: parse_fixed_width(lines, lay, rt, line_col=line_col, typed=typed)
            for rt, lay in layouts.items()}


def rejected_lines(lines: DataFrame, codes: Sequence[str], line_col: str = "value") -> DataFrame:
    """The lines whose record type is none of ``codes`` (short and blank lines included)."""
    return lines.filter(~F.coalesce(record_type(F.col(line_col)).isin(list(codes)), F.lit(False)))


REJECTED = "rejected"


def write_split(lines: DataFrame, targets: Mapping[str, tuple[Sequence[FieldSpec], str]],
                typed: bool = False, fmt: str = "parquet", staging: str | None = None,
                line_col: str = "value", parallel: bool = True, rejects: str | None = None,
                trim: str = "spaces") -> dict[str, int]:
    """Write each record type of a mixed feed to its own table (SK3); returns the lines written per table.

    Lines of no known record type go to the table ``rejects`` (column
    ``line``), if one is named. The writes count their rows as they go
    (``DataFrame.observe``, no extra pass); with ``staging`` and ``rejects`` the
    tables must account for every line read, otherwise an error is raised.

    Without ``staging`` every branch scans the feed and keeps its own record
    type (the text source cannot push the filter down). With ``staging`` the
    feed is read once and written as Parquet, one partition per known record
    type and one for all other lines; each branch then reads only its
    partition (partition pruning), so the raw text is scanned once instead of
    once per record type. The staging folder is removed at the end, also on
    failure.

    The branch writes are independent jobs; with ``parallel`` they are
    submitted together from driver threads and share the executors.
    """
    spark = lines.sparkSession
    codes = list(targets)
    if REJECTED in codes:
        raise ValueError(f"{REJECTED!r} cannot be a record type")
    counts: dict[str, int] = {}

    def counted(df: DataFrame, name: str, write) -> None:
        seen = Observation(f"split-{name}")
        write(df.observe(seen, F.count(F.lit(1)).alias("n")))
        counts[name] = seen.get["n"]

    try:
        if staging:
            code = record_type(F.col(line_col))
            route = F.when(code.isin(codes), code).otherwise(F.lit(REJECTED))
            staged = lines.select(F.col(line_col).alias("line"), route.alias("rt"))
            with held(spark, open_files(len(codes) + 1)):
                counted(staged, "lines", lambda df: df.write.mode("overwrite").partitionBy("rt").parquet(staging, compression=PARQUET_CODEC))
            source = spark.read.schema("line string, rt string").parquet(staging)
        else:
            source = lines.withColumnRenamed(line_col, "line")

        def one(rt: str) -> None:
            if rt == REJECTED:
                part = source.filter(F.col("rt") == REJECTED) if staging else rejected_lines(source, codes, "line")
                counted(part.select("line"), rt, lambda df: write_table(df, rejects, fmt))
                return
            layout, path = targets[rt]
            part = source.filter(F.col("rt") == rt) if staging else source
            counted(parse_fixed_width(part, layout, rt, line_col="line", typed=typed, trim=trim), rt, lambda df: write_table(df, path, fmt))

        names = [*codes, *([REJECTED] if rejects else [])]
        if parallel and len(names) > 1:
            with ThreadPoolExecutor(max_workers=len(names)) as pool:
                list(pool.map(one, names))
        else:
            for name in names:
                one(name)
        if staging and rejects and sum(counts[n] for n in names) != counts["lines"]:
            raise RuntimeError(f"the split does not account for every line: {counts}")
    finally:
        if staging:
            discard(spark, staging)
    return counts


def register_views(spark: SparkSession, **frames: DataFrame) -> None:
    """Name table values for SQL (SK4)."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
