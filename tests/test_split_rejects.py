"""The split of a mixed feed accounts for every line."""
import os

import pytest
from pyspark.sql import functions as F

from lakebuild.layouts import LAYOUTS, LAYOUT_CMP, LAYOUT_SEC
from lakebuild.sinks import write_split
from lakebuild.sources import read_lines, read_table

JUNK = ["", "short", " " * 30, "20200101-000000cmp lower case", "20200101-000000/.. a path", "20200101-000000*** stars", "20200101-000000日本語 wide",
        "20200101-000000rejected"]


def _feed(spark):
    good = spark.range(300).select(F.concat(F.lit("20200101-000000"), F.when(F.col("id") % 3 == 0, "CMP").when(F.col("id") % 3 == 1, "SEC").otherwise("FIN"), F.col("id").cast("string")).alias("value"))
    return good.unionByName(spark.createDataFrame([(x,) for x in JUNK], "value string"))


@pytest.mark.parametrize("staged", [True, False])
def test_outputs_and_rejects_add_up(spark, tmp_uri, staged):
    targets = {rt: (lay, f"{tmp_uri}/{rt}") for rt, lay in LAYOUTS.items()}
    counts = write_split(_feed(spark), targets, staging=tmp_uri + "/_stage" if staged else None, rejects=tmp_uri + "/rejects")
    assert {k: v for k, v in counts.items() if k != "lines"} == {"CMP": 100, "SEC": 100, "FIN": 100, "rejected": len(JUNK)}
    assert sorted(r.line for r in read_table(spark, tmp_uri + "/rejects").collect()) == sorted(JUNK)
    assert all(read_table(spark, f"{tmp_uri}/{rt}").count() == 100 for rt in LAYOUTS)
    assert not os.path.exists(tmp_uri.removeprefix("file:") + "/_stage")
    assert sorted(os.listdir(tmp_uri.removeprefix("file:"))) == ["CMP", "FIN", "SEC", "rejects"]


def test_unknown_types_never_become_folders(spark, tmp_uri):
    write_split(_feed(spark), {"CMP": (LAYOUT_CMP, tmp_uri + "/CMP")}, staging=tmp_uri + "/_stage", rejects=tmp_uri + "/rejects")
    assert read_table(spark, tmp_uri + "/rejects").count() == 200 + len(JUNK)


def test_staging_goes_on_failure_too(spark, tmp_uri):
    bad = tmp_uri + "/file"
    with open(bad.removeprefix("file:"), "w") as f:
        f.write("in the way")
    with pytest.raises(Exception):
        write_split(_feed(spark), {"CMP": (LAYOUT_CMP, tmp_uri + "/CMP"), "SEC": (LAYOUT_SEC, bad)}, staging=tmp_uri + "/_stage", rejects=tmp_uri + "/rejects")
    assert not os.path.exists(tmp_uri.removeprefix("file:") + "/_stage")


def test_a_split_of_nothing(spark, tmp_uri):
    counts = write_split(spark.createDataFrame([], "value string"), {"CMP": (LAYOUT_CMP, tmp_uri + "/CMP")}, staging=tmp_uri + "/_stage", rejects=tmp_uri + "/rejects")
    assert set(counts.values()) == {0} and read_table(spark, tmp_uri + "/CMP").count() == 0


def test_source_name_is_the_files_own(spark, tmp_path):
    """A parent folder that also matches the pattern is not taken for the file."""
    at = tmp_path / "FINWIRE1990Q1_old" / "Batch1"
    os.makedirs(at)
    (at / "FINWIRE1995Q2").write_text("x\n")
    df = read_lines(spark, str(tmp_path / "*" / "Batch*" / "FINWIRE*"), name_regex=r"FINWIRE\d{4}Q[1-4]\b", with_source=True)
    assert [r.source_file for r in df.collect()] == ["FINWIRE1995Q2"]
