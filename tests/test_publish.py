"""Overwrites are published whole or not at all."""
import os

import pytest
from pyspark.sql import functions as F

from lakebuild.sinks import write_table
from lakebuild.sources import read_table
from lakebuild.versions import published


def _local(uri):
    return uri.removeprefix("file:")


def _failing(spark, n=2000):
    """Rows whose last task fails after others have written theirs."""
    return spark.range(0, n, 1, 8).select(F.when(F.col("id") < n - 1, F.col("id")).otherwise(F.raise_error(F.lit("half-way")).cast("long")).alias("id"))


def test_a_write_that_fails_half_way_leaves_the_old_table(spark, tmp_uri):
    at = tmp_uri + "/t"
    write_table(spark.range(5), at)
    before = published(spark, at)
    with pytest.raises(Exception, match="half-way"):
        write_table(_failing(spark), at)
    assert published(spark, at) == before
    assert sorted(r.id for r in read_table(spark, at).collect()) == list(range(5))
    assert [d for d in os.listdir(_local(at)) if d.startswith("version=")] == [f"version={before}"]


def test_a_first_write_that_fails_leaves_nothing_readable(spark, tmp_uri):
    with pytest.raises(Exception, match="half-way"):
        write_table(_failing(spark), tmp_uri + "/t")
    assert published(spark, tmp_uri + "/t") is None
    with pytest.raises(Exception):
        read_table(spark, tmp_uri + "/t")


def test_a_crash_before_the_switch_is_invisible_and_cleaned_up(spark, tmp_uri):
    """Files of a version that was never published (the driver died) are not read, and go with the next overwrite."""
    at = tmp_uri + "/t"
    write_table(spark.range(5), at)
    spark.range(100).write.parquet(at + "/version=00000000000000000001-dead")
    assert read_table(spark, at).count() == 5
    write_table(spark.range(7), at)
    assert read_table(spark, at).count() == 7
    assert "version=00000000000000000001-dead" not in os.listdir(_local(at))


def test_a_table_may_be_overwritten_by_its_own_rows(spark, tmp_uri):
    at = tmp_uri + "/t"
    write_table(spark.range(6), at)
    for _ in range(3):
        rows = read_table(spark, at)
        write_table(rows.select((F.col("id") + 1).alias("id")), at)
        assert rows.count() == 6  # a reader that resolved the table before the switch still has its files
    assert sorted(r.id for r in read_table(spark, at).collect()) == [3, 4, 5, 6, 7, 8]
    assert len([d for d in os.listdir(_local(at)) if d.startswith("version=")]) == 2


def test_modes(spark, tmp_uri):
    at = tmp_uri + "/t"
    write_table(spark.range(2), at, mode="append")
    write_table(spark.range(3), at, mode="append")
    write_table(spark.range(9), at, mode="ignore")
    assert read_table(spark, at).count() == 5
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        write_table(spark.range(1), at, mode="error")
    with pytest.raises(ValueError):
        write_table(spark.range(1), at, mode="upsert")
    assert read_table(spark, at).count() == 5


def test_plain_folders_become_versioned(spark, tmp_uri):
    """A folder written by plain Spark is read as it is, and replaced by the first overwrite."""
    at = tmp_uri + "/t"
    spark.range(4).write.parquet(at)
    assert read_table(spark, at).count() == 4
    write_table(spark.range(6), at)
    assert read_table(spark, at).count() == 6
    assert all(f.startswith(("version=", "_current", "._current")) for f in os.listdir(_local(at)))
