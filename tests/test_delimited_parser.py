"""One parser for market lines: against the CSV file reader, and batch against stream."""
import os

import pytest
from pyspark.sql import functions as F

from lakebuild.layouts import CDC_COLUMNS, DAILY_MARKET_COLUMNS
from lakebuild.plans import market_batches
from lakebuild.paths import LakePaths
from lakebuild.operators import union_batches
from lakebuild.sources import parse_delimited, read_delimited, read_market_batch, split_corrupt
from lakebuild.streaming.incremental import market_line_stream

LINES = ["2020-01-02|S1|1.00|1.10|0.90|10", "2020-01-02|S1||1.10||10", '2020-01-02|"S|1"|"1.00"|1.10|0.90|""', "2020-01-03|S2|1|2|3",
         "2020-01-03|S2|1|2|3|4|surplus", "   ", "", "\t", "2020-01-04|Ünïcode 日本|1|2|3|4", '2020-01-05|say \\"hi\\"|1|2|3|4', "|||||",
         '2020-01-06|"open|1|2|3|4', "2020-01-07| padded |1|2|3|4", "#2020|x|1|2|3|4"]


def _write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_same_rows_as_the_file_reader(spark, tmp_path):
    p = str(tmp_path / "f.txt")
    _write(p, LINES)
    want = _rows(read_delimited(spark, p, DAILY_MARKET_COLUMNS))
    assert len(want) == len(LINES) - 3
    assert _rows(parse_delimited(spark.read.text(p), DAILY_MARKET_COLUMNS)) == want
    assert _rows(read_market_batch(spark, p, incremental=False)) == want
    led = str(tmp_path / "g.txt")
    _write(led, [f"I|{k}|{line}" if line.strip() else line for k, line in enumerate(LINES)])
    inc = read_delimited(spark, led, [*CDC_COLUMNS, *DAILY_MARKET_COLUMNS]).drop(*CDC_COLUMNS)
    assert _rows(read_market_batch(spark, led, incremental=True)) == _rows(inc) == want


def test_corrupt_lines_are_kept_whole(spark, tmp_path):
    p = str(tmp_path / "f.txt")
    _write(p, LINES)
    good, bad = split_corrupt(read_market_batch(spark, p, incremental=False, corrupt="line"), "line")
    assert good.columns == list(DAILY_MARKET_COLUMNS)
    assert {r.line for r in bad.collect()} == {"2020-01-03|S2|1|2|3", "2020-01-03|S2|1|2|3|4|surplus", '2020-01-06|"open|1|2|3|4'}
    assert good.count() + bad.count() == len(LINES) - 3
    with_cdc = str(tmp_path / "g.txt")
    _write(with_cdc, ["I|1|2020-01-03|S2|1|2|3"])
    assert read_market_batch(spark, with_cdc, incremental=True, corrupt="line").first().line == "I|1|2020-01-03|S2|1|2|3"


def test_batch_and_stream_agree(spark, tmp_path):
    for b in (1, 2, 11):
        _write(str(tmp_path / "raw" / f"Batch{b}" / "DailyMarket.txt"), [f"I|{k}|{x}" if b > 1 and x.strip() else x for k, x in enumerate(LINES)])
    lake = LakePaths("file:" + str(tmp_path))
    files = {b: lake.batch(b, "DailyMarket.txt") for b in (1, 2, 11)}
    batch = union_batches(market_batches(spark, lake, batch_files=files, corrupt="line"))
    stream = market_line_stream(spark, lake.raw("Batch*/DailyMarket.txt"), corrupt="line")
    q = stream.writeStream.format("memory").queryName("market_lines").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("market_lines")
    assert got.columns == batch.columns
    assert _rows(got) == _rows(batch)


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_other_separators(spark, sep):
    df = spark.createDataFrame([(f'a{sep}"b{sep}c"{sep}',)], "value string")
    assert tuple(parse_delimited(df, ["x", "y", "z"], sep).first()) == ("a", f"b{sep}c", None)


def test_typed_read(spark, tmp_path):
    p = str(tmp_path / "f.txt")
    _write(p, ["2020-01-02|S1|1.00|x", "bad|S2||7"])
    df = read_delimited(spark, p, ["d", "s", "c", "n"], types={"d": "date", "c": "decimal(15,2)", "n": "bigint"})
    assert df.dtypes == [("d", "date"), ("s", "string"), ("c", "decimal(15,2)"), ("n", "bigint")]
    assert sorted((str(r.d), r.s, r.n) for r in df.collect()) == [("2020-01-02", "S1", None), ("None", "S2", 7)]
    assert df.where(F.col("c").isNull()).count() == 1
