"""Missing input and gaps are errors, and later batches are found."""
import os

import pytest

from lakebuild.paths import LakePaths
from lakebuild.plans import market_batches
from lakebuild.sources import read_lines


def _batches(root, numbers):
    for n in numbers:
        os.makedirs(root / "raw" / f"Batch{n}", exist_ok=True)
        (root / "raw" / f"Batch{n}" / "DailyMarket.txt").write_text("x\n")


def test_no_match_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_lines(spark, str(tmp_path / "nothing*"), name_regex="FINWIRE")
    assert read_lines(spark, str(tmp_path / "nothing*"), name_regex="FINWIRE", allow_empty=True).count() == 0


def test_batches_are_found_by_listing(spark, tmp_path):
    _batches(tmp_path, (1, 2, 3, 4))
    paths = LakePaths("file:" + str(tmp_path))
    assert [n for _, n in market_batches(spark, paths)] == ["1", "2", "3", "4"]


def test_gap_is_an_error(spark, tmp_path):
    _batches(tmp_path, (1, 3))
    with pytest.raises(FileNotFoundError):
        market_batches(spark, LakePaths("file:" + str(tmp_path)))
