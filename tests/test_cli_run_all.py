from lakebuild import fixtures as fx
from lakebuild.__main__ import main
from lakebuild.catalog import QUERIES
from lakebuild.sources import read_table

SF = "/root/testdata/sf0.001"


def test_cli_runs_every_step_through_files(spark, tmp_path, capsys):
    raw = fx.write_raw(spark, SF, root="file:" + str(tmp_path / "landing"))
    root = "file:" + str(tmp_path / "lake")
    main(["all", "--root", root, "--raw-root", raw.root])
    out = dict(line.split("\t") for line in capsys.readouterr().out.strip().splitlines())
    fact = read_table(spark, out["FactMarketHistory"])
    expected = QUERIES["fact_market_history"](spark, SF)
    n = fact.count()
    assert n == expected.count() > 0
    assert fact.exceptAll(expected.select(*fact.columns)).count() == 0
    # running the same step again overwrites rather than appends
    main(["fact", "--root", root, "--raw-root", raw.root])
    assert read_table(spark, out["FactMarketHistory"]).count() == n
