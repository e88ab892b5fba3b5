from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from tabscope.operators import profile, quality


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_missing_counts_nan_and_null_but_not_infinity(spark):
    df = frame(spark, [(1.0, None, 1), (2.0, None, 2), (float("nan"), None, 3), (4.0, None, 4)], "a double, b string, c int")
    summary = rows(quality.missing_summary(df))[0]
    assert (summary["missing_cells"], summary["total_cells"], summary["complete_rows"]) == (5, 12, 0)
    by_column = rows(quality.missing_columns(df))
    assert [(r["column"], r["missing"], r["severity"]) for r in by_column] == [("b", 4, "critical"), ("a", 1, "moderate")]
    assert rows(quality.missing_summary(frame(spark, [(float("inf"),)], "a double")))[0]["missing_cells"] == 0


def test_duplicates_over_all_columns_and_a_subset(spark):
    df = frame(spark, [(1, "x"), (1, "x"), (1, "x"), (2, "y"), (None, None), (None, None)], "a int, b string")
    got = rows(quality.duplicate_summary(df))[0]
    assert (got["duplicate_rows"], got["duplicate_group_count"], got["unique_rows"]) == (3, 2, 3)
    got = rows(quality.duplicate_summary(df, ["a"]))[0]
    assert (got["duplicate_rows"], got["duplicate_group_count"]) == (3, 2)
    assert [r["a"] for r in rows(quality.duplicate_examples(df, limit=4))] == [None, None, 1, 1]


def test_one_text_may_hold_a_third_of_the_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("t"),
                                  F.lit("x" * 50).alias("u"))
    got = rows(quality.duplicate_summary(df))[0]
    assert (got["duplicate_rows"], got["duplicate_group_count"]) == (999, 1)


def test_low_variance(spark):
    data = [("A", "A" if i else "B", i, None) for i in range(200)]
    got = rows(quality.low_variance(frame(spark, data, "k string, n string, v int, e string")), "column")
    assert set(got) == {"k", "n", "e"}
    assert got["k"]["is_constant"] and not got["k"]["is_near_constant"]
    assert got["n"]["is_near_constant"] and got["n"]["dominant_rate"] == 0.995 and got["n"]["dominant_value"] == "A"
    assert got["e"]["n_unique"] == 0 and got["e"]["is_constant"] and got["e"]["dominant_rate"] == 1.0


def test_missing_map_does_not_depend_on_partitions(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("half"))
    one = rows(quality.missing_map(df, id_columns=["id"], rows=50))
    two = rows(quality.missing_map(df.repartition(5), id_columns=["id"], rows=50))
    assert len(one) == 50 and one == two


def test_roles(spark):
    data = [(1.5, "a", True, f"2024-01-{i + 1:02d}", f"${i},000", f"k{i}", None, "yes") for i in range(28)]
    df = frame(spark, data, "n double, t string, flag boolean, day string, amount string, key string, none string, ok string")
    got = {c: r["role"] for c, r in rows(profile.column_roles(df), "column").items()}
    assert got == {"n": "numeric", "t": "categorical", "flag": "boolean", "day": "datetime", "amount": "text-like",
                   "key": "text-like", "none": "empty", "ok": "categorical"}


def test_digits_are_not_dates(spark):
    df = frame(spark, [("20240131",), ("20240229",)], "d string")
    probe = rows(profile.text_probe(df))[0]
    assert probe["n_date"] == 0 and probe["n_number"] == 2


def test_dtype_issues(spark):
    data = list(zip(["1,200", "3,400", "5,600", "7,800", "1", "2", "3", "4"], ["a", "b", "c", "d"] * 2,
                    ["72", "68", "not available", "81", "absent", "75", "90", "60"]))
    got = rows(profile.dtype_issues(frame(spark, data, "income string, name string, score string")), "column")
    assert {c: r["issue"] for c, r in got.items()} == {"income": "numeric_stored_as_text", "score": "mixed_types"}
    assert got["score"]["affected_rate"] == 0.75 and got["income"]["example_values"] == ["1", "1,200", "2"]


def test_overview_and_profile_of_odd_names(spark):
    df = frame(spark, [(1e18, "é", None), (1e-12, "é", None)], "`a b` double, `$#.x` string, `naïve` string")
    got = rows(profile.column_profile(df), "column")
    assert got["$#.x"]["unique"] == 1 and got["naïve"]["role"] == "empty" and got["a b"]["missing"] == 0
    assert rows(profile.overview(df))[0]["missing_cells"] == 2


def test_nested_columns_are_profiled_but_not_counted(spark):
    df = spark.createDataFrame([(i, [i], {"a": i}, None) for i in range(5)], "i int, a array<int>, m map<string,int>, n array<int>")
    got = rows(profile.column_profile(df), "column")
    assert got["a"]["unique"] is None and got["a"]["role"] == "other" and got["n"]["missing"] == 5 and got["i"]["unique"] == 5
    assert rows(quality.low_variance(df)) == []
    assert rows(quality.missing_summary(df))[0]["missing_cells"] == 5
    assert rows(quality.duplicate_summary(df.union(df)))[0]["duplicate_rows"] == 5


def test_missing_map_holds_rows_of_repeated_values(spark):
    df = spark.createDataFrame([(i % 3, None if i % 3 else 1) for i in range(9_000)], "a int, b int")
    assert quality.missing_map(df, rows=400).count() == 400
