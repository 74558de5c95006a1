"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakebuild.session import ensure_checkpoint_dir

#: A word everywhere in this subpackage: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder of the cluster."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def text_of(col: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words_of(text: str | None) -> list[bytes]:
    """The words as UTF-8; ``bytes.split`` cuts at exactly 0x20 and 0x09-0x0D."""
    return text.encode().split() if text else []


def group_count(rows: int, per_group: int) -> int:
    """How many hash groups give about ``per_group`` rows each."""
    return max(1, -(-rows // per_group))


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


# ------------------------------------------------------- native text measures

def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, whatever the optimizer inlines."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spaced(text: Column) -> Column:
    """The text with every ASCII white space turned into a space."""
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def word_array(text: Column) -> Column:
    """The words of a text as an array."""
    return F.array_remove(F.split(spaced(text), " "), "")


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")
