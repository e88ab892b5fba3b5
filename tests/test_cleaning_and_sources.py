from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tabscope.functions.columns import parse_number
from tabscope.operators import cleaning
from tabscope.sources import delimited, sinks


@pytest.mark.parametrize("text,value", [
    ("$1,200", 1200.0), ("(12)", -12.0), ("72%", 72.0), ("+5", 5.0), (" 1 000 ", 1000.0), ("€3.5", 3.5), ("1e3", 1000.0),
    ("abc", None), ("", None), ("1.2.3", None), ("5d", None), ("NaN", None), ("Infinity", None), (".5", 0.5), ("-", None)])
def test_number_text(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_number(F.col("t"))).first()[0] == value


def dirty(spark):
    return spark.createDataFrame([("$1,200", "n/a", 1, True), ("(12)", "b", None, None), ("72%", "b", 2, False),
                                  ("+5", "a", None, False), ("x", "a", 4, False), ("x", "a", 4, False)],
                                 "amt string, t string, k int, f boolean")


def test_cleaning_steps_and_audit(spark):
    got = cleaning.clean(dirty(spark), normalize_markers=True, numeric_columns=["amt"], remove_duplicates=True, missing="fill")
    audit = rows(got.audit)
    assert [(a["cells_changed"], a["rows_removed"]) for a in audit] == [(1, 0), (6, 0), (0, 1), (5, 0)]
    data = rows(got.frame)
    assert len(data) == 5 and all(v is not None for r in data for v in r.values())
    assert sorted(r["amt"] for r in data) == [-12.0, 5.0, 38.5, 72.0, 1200.0]
    assert dict(got.frame.dtypes)["k"] == "int"


def test_fractional_median_widens_whole_numbers(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    got = cleaning.clean(df, missing="fill").frame
    assert dict(got.dtypes)["k"] == "double" and sorted(r["k"] for r in rows(got)) == [1.0, 1.5, 2.0]


def test_drop_rows_all_null_column_and_bad_arguments(spark):
    assert cleaning.clean(dirty(spark), missing="drop_rows").frame.count() == 4
    df = spark.createDataFrame([(None, 1), (None, 2)], "a string, b int")
    assert rows(cleaning.clean(df, missing="fill").frame)[0]["a"] is None
    with pytest.raises(ValueError):
        cleaning.clean(df, missing="guess")
    with pytest.raises(ValueError):
        cleaning.clean(df, numeric_columns=["nope"])


def test_nothing_to_do_leaves_no_audit(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")
    got = cleaning.clean(df, normalize_markers=True, remove_duplicates=True, missing="fill")
    assert rows(got.audit) == [] and got.frame.count() == 2 and rows(got.totals())[0]["cells_changed"] == 0
    assert cleaning.cleaned_name("dir\\a/b.csv") == "b_cleaned.csv"


@pytest.fixture
def write(tmp_path):
    def write(name, content, encoding="utf-8"):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode(encoding))
        return str(path)
    return write


def read(spark, path, **options):
    got = delimited.read_delimited(spark, path, **options)
    return got, {n["note_code"]: n for n in rows(got.notes)}


def test_semicolons_and_types(spark, write):
    got, _ = read(spark, write("a.csv", "a;b;c;d\n1;2.5;true;x\n3;4;false;007\n"))
    assert got.delimiter == ";" and got.frame.dtypes == [("a", "bigint"), ("b", "double"), ("c", "boolean"), ("d", "string")]


def test_messy_headers_blank_lines_and_trimming(spark, write):
    got, notes = read(spark, write("b.csv", " age , age ,name\n1,2,bob \n\n3,4, amy\n"))
    assert got.frame.columns == ["age", "age_duplicate_1", "name"]
    assert [r["name"] for r in rows(got.frame)] == ["bob", "amy"] and notes["values_trimmed"]["n"] == 1


def test_index_column_is_dropped(spark, write):
    got, notes = read(spark, write("c.csv", ",value\n0,1.5\n1,2.5\n"))
    assert got.frame.columns == ["value"] and "index_column_dropped" in notes


def test_malformed_rows(spark, write):
    got, notes = read(spark, write("d.csv", 'a,b,c\n1,2,3\n1,2\n1,2,3,4\n"x,y",2,3\n,,\nNA,n/a,\n'))
    assert [tuple(r.values()) for r in rows(got.frame)] == [("1", 2, 3), ("1", 2, None), ("x,y", 2, 3)]
    assert (notes["rows_too_long"]["n"], notes["rows_too_short"]["n"], notes["rows_empty"]["n"]) == (1, 1, 2)


@pytest.mark.parametrize("content", ["", "\n\n", "a,b\n", b"\x89PNG\r\n\x1a\n\x00\x00"])
def test_unreadable_files(spark, write, content):
    with pytest.raises(delimited.LoadError):
        delimited.read_delimited(spark, write("e.csv", content))


def test_missing_path(spark):
    with pytest.raises(delimited.LoadError):
        delimited.read_delimited(spark, "/nonexistent/file.csv")


def test_encodings(spark, write):
    path = write("f.csv", "name,x\nJosé,1\n", "latin-1")
    assert rows(read(spark, path, encoding="ISO-8859-1")[0].frame)[0]["name"] == "José"
    assert read(spark, path)[1]["undecodable"]["n"] == 1


def test_single_column_and_row_limit(spark, write):
    got, notes = read(spark, write("g.csv", "value\n1\n2\n3\n"), max_rows=2)
    assert got.frame.count() == 2 and {"delimiter_guessed", "rows_limited"} <= set(notes)


def test_sinks_and_fingerprint(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "a,\"b\""), (2, 2.0, None)], "i int, x double, t string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    sinks.write_tables({"t": df}, str(tmp_path / "out"))
    back = rows(spark.read.parquet(str(tmp_path / "out" / "t")), "i")
    assert back[1]["x"] is None and back[2]["x"] == 2.0
    assert rows(delimited.read_delimited(spark, str(tmp_path / "csv"), ",").frame, "i")[1]["t"] == 'a,"b"'
    assert rows(sinks.fingerprint(df)) == rows(sinks.fingerprint(df.repartition(3)))
    assert rows(sinks.fingerprint(df)) != rows(sinks.fingerprint(df.union(df)))
    assert sinks.preview(df, 1).count() == 1


def test_files_with_reordered_headers_are_matched_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,price,qty\n1,12.5,3\n2,10.0,4\n")
    (tmp_path / "b.csv").write_text("id,qty,price,extra\n3,5,7.5,x\n")
    loaded = delimited.read_delimited(spark, str(tmp_path))
    got = {r["id"]: r for r in loaded.frame.collect()}
    assert (got[3]["price"], got[3]["qty"], got[3]["extra"]) == (7.5, 5, "x") and got[1]["price"] == 12.5 and got[1]["extra"] is None
    assert "headers_differ" in {r["note_code"] for r in loaded.notes.collect()}
