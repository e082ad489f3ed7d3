"""S1-S3 with faulty rows, N4/N5 with the column's own format."""

import datetime as dt

import pytest
from pyspark.sql import types as T

from shopfloor.operators.formats import format_votes, parse_dates
from shopfloor.sources.quarantine import read_checked, reject_counts

SHEET = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "name", "outcome")])


def lines(tmp_path, name, *texts):
    path = tmp_path / name
    path.mkdir()
    for i, t in enumerate(texts):
        (path / f"part{i}").write_text(t, encoding="utf-8")
    return str(path)


def test_csv_lines_are_kept_or_rejected(spark, tmp_path):
    path = lines(tmp_path, "csv", 'id,name,outcome\n1,"a, b",x\n2,b\n\n3,c,x,y\n', 'id,name,outcome\n4,,\n5,"",x\n6,ä,\n')
    kept, rejects = read_checked(spark, path, SHEET, "csv", required=["name"])
    assert kept.columns == SHEET.names  # a column may be called like the outcome
    assert sorted(map(tuple, kept.collect())) == [("1", "a, b", "x"), ("6", "ä", None)]
    got = {(r["reason"], r["record"]) for r in rejects.collect()}
    assert ("malformed", "2,b") in got and ("malformed", "3,c,x,y") in got and len(got) == 4
    assert {r for r, _ in got} == {"malformed", "missing name"}
    assert {(r["file"].rsplit("/", 1)[1], r["reason"]): r["rows"] for r in reject_counts(rejects).collect()} == {
        ("part0", "malformed"): 2, ("part1", "missing name"): 2}
    assert kept.select("id").count() + rejects.count() == 6  # six lines that aren't blank or a header


def test_a_header_of_another_sheet_is_an_error(spark, tmp_path):
    path = lines(tmp_path, "other", "id,title,outcome\n1,a,x\n")
    with pytest.raises(Exception, match="header"):
        read_checked(spark, path, SHEET, "csv")


def test_json_lines_are_kept_or_rejected(spark, tmp_path):
    path = lines(tmp_path, "json", '{"id": 1, "name": "a"}\n{"id": 2, "name"\n\n"text"\n{"id": 3, "more": 1}\n')
    kept, rejects = read_checked(spark, path, SHEET, "json", required=["name"])
    assert [tuple(r) for r in kept.collect()] == [("1", "a", None)]
    assert sorted((r["reason"], r["record"]) for r in rejects.collect()) == [
        ("malformed", '"text"'), ("malformed", '{"id": 2, "name"'), ("missing name", '{"id":"3"}')]


def test_empty_sheet_and_clashing_names(spark, tmp_path):
    clash = T.StructType([T.StructField(c, T.StringType()) for c in ("_corrupt", "_file", "_record", "_reason", "a.b")])
    kept, rejects = read_checked(spark, lines(tmp_path, "clash", "1,2,3,4,5\n1,2\n"), clash, "csv", required=["a.b"], header="false")
    assert [tuple(r) for r in kept.collect()] == [("1", "2", "3", "4", "5")]
    assert [(r["record"], r["reason"]) for r in rejects.collect()] == [("1,2", "malformed")]
    for fmt in ("csv", "json"):
        kept, rejects = read_checked(spark, lines(tmp_path, f"empty_{fmt}", ""), SHEET, fmt)
        assert kept.columns == SHEET.names and kept.count() == 0 and rejects.count() == 0


DATES = ["03/04/2001", "13/04/2001", "04/13/2001", "14/04/2001", "2001-04-03", "April 3, 2001", "31/31/2001", "soon", " ", None,
         "03/04/2001 10:20:30"]


def test_votes_of_a_column(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(DATES)], "i int, `when.` string")
    v = format_votes(df, ["when."]).first().asDict()
    assert v == {"column_name": "when.", "n_values": 11, "blank": 2, "day_first": 2, "month_first": 1, "either": 2,
                 "other_formats": 2, "no_date": 2, "slash_order": "day first"}
    none = format_votes(df.limit(0), ["when."]).first()
    assert none["n_values"] == 0 and none["slash_order"] == "day first"


def read(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in parse_dates(df, {"t": "d"}, **options).orderBy("i").select("d").collect()]


def test_dates_are_read_by_the_columns_order(spark):
    day = read(spark, DATES)
    assert day[0] == dt.datetime(2001, 4, 3) and day[1] == dt.datetime(2001, 4, 13) and day[2] is None
    assert day[4] == day[5] == dt.datetime(2001, 4, 3) and day[6:10] == [None] * 4
    assert day[10] == dt.datetime(2001, 4, 3, 10, 20, 30)
    month = read(spark, ["03/04/2001", "04/13/2001", "13/04/2001", "12/31/2001"])
    assert month == [dt.datetime(2001, 3, 4), dt.datetime(2001, 4, 13), None, dt.datetime(2001, 12, 31)]


def test_first_value_fixes_the_format(spark):
    first = read(spark, [None, "soon", "2001-04-03", "03/04/2001", "April 3, 2001", "2002-01-31"], rule="first", order_by="i")
    assert first == [None, None, dt.datetime(2001, 4, 3), None, None, dt.datetime(2002, 1, 31)]
    assert read(spark, ["04/13/2001", "13/04/2001"], rule="first", order_by="i") == [dt.datetime(2001, 4, 13), None]
    assert read(spark, ["soon", None], rule="first", order_by="i") == [None, None]
    with pytest.raises(ValueError):
        read(spark, ["x"], rule="first")
