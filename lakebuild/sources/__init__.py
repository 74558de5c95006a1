"""Readers: delimited text, whole lines by file-name pattern, stored tables (SC1-SC5)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..layouts import CDC_COLUMNS, DAILY_MARKET_COLUMNS
from ..versions import resolve_version


def string_schema(columns: Sequence[str], types: Mapping[str, str] | None = None) -> T.StructType:
    """All strings, but for the columns that ``types`` gives a Spark SQL type."""
    types = types or {}
    return T.StructType([T.StructField(c, T._parse_datatype_string(types[c]) if c in types else T.StringType(), True) for c in columns])


def read_delimited(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str],
                   sep: str = "|", types: Mapping[str, str] | None = None, **options) -> DataFrame:
    """Headerless delimited text, columns named by position, every value a string
    unless ``types`` names a type for it (a text that is no such value is NULL).

    The schema is given, so nothing is inferred and no extra pass is made over
    the input; files are split into ``spark.sql.files.maxPartitionBytes``
    chunks and read in parallel.
    """
    reader = (spark.read.schema(string_schema(columns, types))
              .option("sep", sep).option("header", "false"))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.csv(path if isinstance(path, str) else list(path))


def parse_delimited(lines: DataFrame, columns: Sequence[str], sep: str = "|", line_col: str = "value",
                    corrupt: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Headerless delimited lines -> string columns, for batch and streaming line sources alike.

    Spark's CSV parser in PERMISSIVE mode: an empty field is NULL, a quoted
    field may hold the separator, a short line leaves its last columns NULL, a
    long one loses its surplus. Lines of white space and control characters
    only are skipped, as the file reader does. With ``corrupt`` every line
    that does not have exactly ``columns`` fields is also kept whole in a
    column of that name (NULL for good lines), so nothing is lost unseen.
    """
    return _cut(lines.filter(_not_blank(line_col)), columns, sep, line_col, corrupt, keep)


def _not_blank(line_col: str) -> Column:
    return F.col(line_col).rlike(r"[^\x00-\x20]")


def _cut(lines: DataFrame, columns: Sequence[str], sep: str, line_col: str, corrupt: str | None, keep: Sequence[str]) -> DataFrame:
    """The fields of lines that are not blank. The record comes out of a generator: through a plain column, filters on
    fields would move down to the lines and parse each line once more per field they test."""
    mark = corrupt or "__corrupt"
    schema = ", ".join(f"`{c}` string" for c in (*columns, mark))
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": mark}
    rec = F.from_csv(F.col(line_col), schema, options)
    rows = lines.select(*keep, F.explode(F.array(rec)).alias("__rec"))
    return rows.select(*keep, *[F.col(f"__rec.`{c}`").alias(c) for c in (*columns, *([corrupt] if corrupt else []))])


def parse_market_lines(lines: DataFrame, incremental: Column | bool, sep: str = "|", line_col: str = "value",
                       corrupt: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """DailyMarket lines -> the market columns (SC5), whatever kind of batch they come from.

    A line of an incremental batch leads with CDC_FLAG and CDC_DSN, which are
    never applied; a line of a full batch is read as one with both empty, so
    that one parser serves both. ``incremental`` may differ from line to line.
    """
    inc = incremental if isinstance(incremental, Column) else F.lit(incremental)
    led = F.when(inc, F.col(line_col)).otherwise(F.concat(F.lit(sep * 2), F.col(line_col)))
    same = lines.filter(_not_blank(line_col)).withColumns({"__line": led, "__inc": inc})
    df = _cut(same, (*CDC_COLUMNS, *DAILY_MARKET_COLUMNS), sep, "__line", corrupt, keep=[*keep, "__inc"])
    if corrupt:
        df = df.withColumn(corrupt, F.when(F.col("__inc"), F.col(corrupt)).otherwise(F.substr(F.col(corrupt), F.lit(2 * len(sep) + 1))))
    return df.drop(*CDC_COLUMNS, "__inc")


def read_market_batch(spark: SparkSession, path: str, incremental: bool, sep: str = "|",
                      corrupt: str | None = None) -> DataFrame:
    """A DailyMarket batch; incremental batches lead with CDC_FLAG, CDC_DSN (SC5)."""
    return parse_market_lines(spark.read.text(path), incremental, sep, corrupt=corrupt)


def split_corrupt(df: DataFrame, corrupt: str) -> tuple[DataFrame, DataFrame]:
    """(the good rows, without the corrupt-record column; the corrupt rows, with it)."""
    return df.filter(F.col(corrupt).isNull()).drop(corrupt), df.filter(F.col(corrupt).isNotNull())


def list_matching(spark: SparkSession, glob: str, name_regex: str | None = None) -> list[str]:
    """Paths matching a Hadoop glob whose last segment matches ``name_regex``.

    Only the file listing runs on the driver (as Spark's own listing does).
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(glob)
    statuses = p.getFileSystem(conf).globStatus(p) or []
    rx = re.compile(name_regex) if name_regex else None
    out = []
    for st in statuses:
        path = st.getPath()
        if rx is None or rx.search(path.getName()):
            out.append(path.toString())
    return sorted(out)


def read_lines(spark: SparkSession, glob: str, name_regex: str | None = None,
               with_source: bool = False, line_col: str = "value",
               allow_empty: bool = False) -> DataFrame:
    """Every line of every file (or directory of part files) matching ``glob``
    and, when given, whose name matches ``name_regex`` (SC2, SC3).

    Lines are read whole with the text source, so a separator or quote inside
    a record cannot cut it. ``with_source`` adds ``source_file``, the matched
    file or directory name.
    """
    paths = list_matching(spark, glob, name_regex) if name_regex else [glob]
    if not paths:
        # a mistyped root must not overwrite good tables with empty ones
        if not allow_empty:
            raise FileNotFoundError(f"nothing matches {glob} with {name_regex}")
        return spark.createDataFrame([], T.StructType([T.StructField(line_col, T.StringType())]))
    df = spark.read.text(paths)
    if line_col != "value":
        df = df.withColumnRenamed("value", line_col)
    if with_source:
        # the file, or the folder that holds it as part files
        src = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+?)(?:/part-[^/]*)?$", 1)
        df = df.select(F.col(line_col), src.alias("source_file"))
    return df


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored table by path (SC4): the published version where the table has versions
    (see ``sinks.write_table``), else the folder itself; ``fmt="delta"`` where the Delta
    jar is present."""
    return spark.read.format(fmt).load(path if fmt == "delta" else resolve_version(spark, path) or path)
