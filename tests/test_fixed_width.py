from pyspark.sql import functions as F

from lakebuild.functions import parse_fixed_width, slice_field, tolerant_cast
from lakebuild.layouts import LAYOUT_CMP, LAYOUT_FIN, LAYOUT_SEC, FieldSpec


def _line(layout, values):
    out = ""
    for f in layout:
        v = values.get(f.name, "")
        out += v if f.end is None else v.ljust(f.end - f.start)[: f.end - f.start]
    return out


def test_layouts_are_contiguous():
    for layout in (LAYOUT_CMP, LAYOUT_SEC, LAYOUT_FIN):
        assert layout[0].start == 0
        for a, b in zip(layout, layout[1:]):
            assert a.end == b.start
    assert LAYOUT_CMP[-1].end == 543
    assert LAYOUT_SEC[-1].end is None and LAYOUT_FIN[-1].end is None


def test_every_field_at_its_bounds(spark):
    for layout, rt in ((LAYOUT_CMP, "CMP"), (LAYOUT_SEC, "SEC"), (LAYOUT_FIN, "FIN")):
        # fill each field with a distinct marker that exactly fills its width
        vals = {}
        for i, f in enumerate(layout):
            w = (f.end - f.start) if f.end else 7
            vals[f.name] = (chr(ord("A") + i % 26) * w)
        vals["RECTYPE"] = rt
        line = _line(layout, vals)
        df = spark.createDataFrame([(line,)], "value string")
        row = parse_fixed_width(df, layout, rt).collect()[0].asDict()
        assert row == vals


def test_short_line_blank_fields_and_record_filter(spark):
    line_cmp = "20240131-101500CMPACME"
    rows = [(line_cmp,), ("20240131-101500SECS1",), ("x",)]
    df = spark.createDataFrame(rows, "value string")
    out = parse_fixed_width(df, LAYOUT_CMP, "CMP").collect()
    assert len(out) == 1
    r = out[0]
    assert r.COMPANY_NAME == "ACME" and r.CIK == "" and r.DESCRIPTION == ""


def test_pipe_and_quote_inside_a_record_survive(spark):
    vals = {"PTS": "20240131-101500", "RECTYPE": "SEC", "SYMBOL": 'AB|"C', "NAME": 'He said "hi" | bye',
            "CO_NAME_OR_CIK": 'Name | with "quotes"'}
    df = spark.createDataFrame([(_line(LAYOUT_SEC, vals),)], "value string")
    r = parse_fixed_width(df, LAYOUT_SEC, "SEC").collect()[0]
    assert r.SYMBOL == 'AB|"C' and r.NAME == 'He said "hi" | bye'
    assert r.CO_NAME_OR_CIK == 'Name | with "quotes"'


def test_trim_modes(spark):
    df = spark.createDataFrame([("\t ab \t",)], "value string")
    spec = FieldSpec(0, None, "F")
    from lakebuild.functions import trim_field
    r = df.select(trim_field(slice_field(F.col("value"), spec), "spaces").alias("s"),
                  trim_field(slice_field(F.col("value"), spec), "whitespace").alias("w"),
                  trim_field(slice_field(F.col("value"), spec), "none").alias("n")).collect()[0]
    assert r.s == "\t ab \t" and r.w == "ab" and r.n == "\t ab \t"


def test_tolerant_casts(spark):
    vals = ["12", "-3", "+5", "12.0", "1e3", "1.5d", "n/a", "", " 7", ".5", "1.", "abc"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    out = df.select("s", tolerant_cast(F.col("s"), "int").alias("i"),
                    tolerant_cast(F.col("s"), "bigint").alias("l"),
                    tolerant_cast(F.col("s"), "double").alias("d")).collect()
    got = {r.s: (r.i, r.l, r.d) for r in out}
    # Python int()/float() semantics (blank/bad -> None)
    assert got["12"] == (12, 12, 12.0)
    assert got["-3"] == (-3, -3, -3.0)
    assert got["+5"] == (5, 5, 5.0)
    assert got["12.0"] == (None, None, 12.0)
    assert got["1e3"] == (None, None, 1000.0)
    assert got["1.5d"] == (None, None, None)
    assert got["n/a"] == (None, None, None)
    assert got[""] == (None, None, None)
    assert got[" 7"] == (None, None, None)  # callers trim first
    assert got[".5"] == (None, None, 0.5)
    assert got["1."] == (None, None, 1.0)
    assert got["abc"] == (None, None, None)


def test_typed_parse_schema(spark):
    vals = {"PTS": "20240131-101500", "RECTYPE": "FIN", "YEAR": "2024", "QUARTER": "1",
            "REVENUE": "   123.45", "EPS": "n/a", "SH_OUT": "", "DILUTED_SH_OUT": "99",
            "CO_NAME_OR_CIK": "0000000001"}
    df = spark.createDataFrame([(_line(LAYOUT_FIN, vals),)], "value string")
    out = parse_fixed_width(df, LAYOUT_FIN, "FIN", typed=True)
    types = dict(out.dtypes)
    assert types["YEAR"] == "int" and types["QUARTER"] == "tinyint"
    assert types["REVENUE"] == "double" and types["SH_OUT"] == "bigint"
    r = out.collect()[0]
    assert (r.YEAR, r.QUARTER, r.REVENUE, r.EPS, r.SH_OUT, r.DILUTED_SH_OUT) == (2024, 1, 123.45, None, None, 99)


def test_parse_is_one_projection_without_python(spark):
    df = spark.createDataFrame([("x",)], "value string")
    plan = parse_fixed_width(df, LAYOUT_FIN, "FIN", typed=True)._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "EvalPython" not in plan


def test_non_ascii_lines_slice_by_characters(spark):
    # Python slicing counts code points; a multi-byte character must not shift later fields
    vals = {"PTS": "20240131-101500", "RECTYPE": "CMP", "COMPANY_NAME": "Société Générale ÄÖÜ 株式会社",
            "CIK": "0000000042", "STATUS": "ACTV", "INDUSTRY_ID": "AB", "DESCRIPTION": "naïve café"}
    line = _line(LAYOUT_CMP, vals)
    ascii_line = _line(LAYOUT_CMP, dict(vals, COMPANY_NAME="Plain Name", DESCRIPTION="plain"))
    df = spark.createDataFrame([(line,), (ascii_line,)], "value string")
    rows = {r.CIK + r.COMPANY_NAME: r for r in parse_fixed_width(df, LAYOUT_CMP, "CMP").collect()}
    r = rows["0000000042Société Générale ÄÖÜ 株式会社"]
    assert (r.STATUS, r.INDUSTRY_ID, r.DESCRIPTION) == ("ACTV", "AB", "naïve café")
    assert rows["0000000042Plain Name"].DESCRIPTION == "plain"
    expected = {f.name: (line[f.start:f.end] if f.end else line[f.start:]).strip(" ") for f in LAYOUT_CMP}
    assert r.asDict() == expected
