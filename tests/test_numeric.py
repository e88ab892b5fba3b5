from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings as hypothesis_settings, strategies as st
from pyspark.sql import functions as F

from tabscope.operators import categorical, numeric, outliers, profile
from tabscope.plans.quantiles import exact_quantiles
from tabscope.plans.running import grouped_totals, with_rank
from tabscope.settings import Settings


def column(spark, values, name="x"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"{name} double")


def test_stats_match_pandas(spark):
    values = pd.Series([3, 1, 4, 1, 5, 9, 2, 6], dtype=float)
    got = rows(numeric.numeric_stats(column(spark, values)))[0]
    assert got["median"] == values.median() and got["q1"] == values.quantile(0.25)
    for key, want in (("mean", values.mean()), ("std", values.std()), ("skewness", values.skew()), ("kurtosis", values.kurt())):
        assert got[key] == pytest.approx(want, rel=1e-12)


def test_infinite_and_missing_values_are_left_out(spark):
    got = rows(numeric.numeric_stats(column(spark, [1, np.nan, np.inf, -np.inf, 5, None])))[0]
    assert (got["count"], got["missing"], got["mean"], got["skewness"]) == (2, 4, 3.0, None)


@pytest.mark.parametrize("values,expected", [([None], (0, None, None)), ([7], (1, 7.0, 0.0))])
def test_nearly_empty_columns(spark, values, expected):
    got = rows(numeric.numeric_stats(column(spark, values)))[0]
    assert (got["count"], got["mean"], got["std"]) == expected


def test_zero_share_and_zero_mean(spark):
    assert rows(numeric.numeric_stats(column(spark, [0, 0, 0, 10])))[0]["zero_share"] == 0.75
    assert rows(numeric.numeric_stats(column(spark, [-5, 5])))[0]["coefficient_of_variation"] is None


def test_identifier_needs_name_whole_numbers_and_uniqueness(spark):
    df = spark.range(100).select(F.col("id").alias("record_id"), (F.col("id") * 1.5).alias("part_id"), F.col("id").alias("paid"))
    got = rows(numeric.numeric_flags(numeric.numeric_stats(df), profile.integer_valued(df)), "column")
    assert [c for c, r in got.items() if r["identifier_like"]] == ["record_id"]


@hypothesis_settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from([0.0, 1.0, 2.5, -3.0, 1e6, 7.0, 8.0]) | st.floats(-100, 100), min_size=8, max_size=60))
def test_narrowed_quantiles_equal_numpy(spark, scaled, values):
    df = column(spark, values)
    got = exact_quantiles(df, {"x": F.col("x")}, [0.0, 0.25, 0.5, 0.9, 1.0], scaled)["x"]
    assert got == pytest.approx(list(np.quantile(values, [0.0, 0.25, 0.5, 0.9, 1.0])), abs=1e-9)


def test_quantiles_with_a_third_of_all_rows_at_one_value(spark, scaled):
    values = [5.0] * 100 + list(range(200))
    got = exact_quantiles(column(spark, values), {"x": F.col("x")}, [0.1, 0.5, 0.99], scaled)["x"]
    assert got == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.99])))


def test_quantiles_beyond_the_sketch(spark):
    """More values than a sketch holds: brackets are counted, walked, and sought again where they miss."""
    rng = np.random.default_rng(17)
    values = np.concatenate([rng.normal(size=30_000), np.full(12_000, 0.25), rng.integers(0, 40, 3_000)])
    pdf = pd.DataFrame({"x": rng.permutation(values), "few": rng.integers(0, 3, len(values)).astype(float)})
    probabilities = [0.0, 0.001, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(spark.createDataFrame(pdf), {"x": F.col("x"), "few": F.col("few"), "none": F.lit(None).cast("double")}, probabilities)
    assert got["none"] is None
    for c in pdf:
        assert got[c] == pytest.approx(list(np.quantile(pdf[c], probabilities)), abs=1e-12)


def test_missed_brackets_are_sought_again(spark, monkeypatch):
    from tabscope.plans import quantiles
    monkeypatch.setattr(quantiles, "SKETCH", 64)
    monkeypatch.setattr(quantiles, "ERROR", 1e-6)
    values = np.random.default_rng(18).normal(size=20_000)
    got = exact_quantiles(column(spark, list(map(float, values))), {"x": F.col("x")}, [0.1, 0.5, 0.99])["x"]
    assert got == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.99])), abs=1e-12)


def test_running_totals_over_ranges(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("v"), (F.col("id") % 4 + 1).alias("n"))
    want = np.cumsum(np.arange(50) % 4 + 1)
    got = rows(grouped_totals(df, [], "v", ["n"]), "v")
    assert [got[float(i)]["upto_n"] for i in range(50)] == list(want)


def test_running_totals_by_group(spark):
    """One group holds most rows, some hold one; all share one range partitioning."""
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": np.where(rng.random(3000) < 0.6, 0, rng.integers(1, 300, 3000)), "v": rng.permutation(3000).astype(float),
                        "n": rng.integers(1, 9, 3000)})
    want = pdf.sort_values("v").assign(upto=lambda d: d.groupby("g")["n"].cumsum()).set_index(["g", "v"])["upto"]
    totals = grouped_totals(spark.createDataFrame(pdf), ["g"], "v", ["n"])
    assert {(r["g"], r["v"]): r["upto_n"] for r in rows(totals)} == want.to_dict()
    assert grouped_totals(spark.createDataFrame(pdf).limit(0), ["g"], "v", ["n"]).count() == 0


def test_average_ranks(spark):
    values = pd.Series([4, 4, 4, 4, 1, 2, 2, 9, 8, 7, 6, None, 11, 12, 4], dtype=float)
    df = spark.createDataFrame([(i, None if pd.isna(v) else v) for i, v in enumerate(values)], "i int, x double")
    got = rows(with_rank(df, F.col("x"), "r"), "i")
    assert len(got) == len(values)
    assert [got[i]["r"] for i in range(len(values))] == [None if pd.isna(r) else r for r in values.rank()]


def test_histogram_and_box(spark):
    df = column(spark, list(range(100)) + [1000])
    bins = rows(numeric.histogram(df, "x"))
    assert sum(b["n"] for b in bins) == 101 and sum(b["outliers"] for b in bins) == 1
    box = rows(numeric.box_summary(df))[0]
    assert box["upper_whisker"] == 99 and box["outside"] == 1


# ---- outliers -------------------------------------------------------------------

def stats(spark, values, **options):
    return rows(outliers.outlier_stats(column(spark, values), **options), "method")


def test_iqr_flags_the_planted_value(spark):
    assert stats(spark, [10 + 0.25 * i for i in range(20)] + [500])["iqr"]["count"] == 1
    got = stats(spark, range(1, 101))["iqr"]
    assert (got["count"], got["lower_bound"], got["upper_bound"]) == (0, -48.5, 149.5)


def test_equal_quartiles_flag_whatever_differs(spark):
    got = stats(spark, [1] * 50 + [2, 3, 10])
    assert got["iqr"]["count"] == 3 and not got["modified_zscore"]["available"]


def test_zscore_gates(spark):
    assert not stats(spark, [1, 2, 3, 4, 5])["zscore"]["available"]
    draws = list(np.random.default_rng(0).normal(size=500)) + [12.0]
    assert stats(spark, draws)["zscore"]["count"] >= 1


def test_mad_resists_masking(spark):
    draws = np.append(np.random.default_rng(1).normal(size=28), [6.0, 12.0])
    median = np.median(draws)
    score = 0.6745 * (draws - median) / np.median(np.abs(draws - median))
    got = stats(spark, draws)
    assert got["modified_zscore"]["count"] == (np.abs(score) > 3.5).sum() >= 2
    assert got["zscore"]["count"] == 1  # the larger extreme hides the smaller one


def test_binary_columns_are_not_tested(spark):
    got = stats(spark, [0] * 190 + [1] * 10)
    assert all(not r["available"] and r["count"] == 0 for r in got.values())


def test_examples_sentinels_and_disagreement(spark):
    df = spark.createDataFrame([(float(x), c) for x, c in zip([1, 2, 3, 4, 5, 99], "abcdef")], "x double, label string")
    assert rows(outliers.outlier_examples(df, "x"))[0]["label"] == "f"
    draws = list(np.random.default_rng(2).normal(50, 5, 300)) + [-999.0] * 5
    got = rows(outliers.sentinel_suspects(column(spark, draws)))
    assert [(r["code"], r["matches"]) for r in got] == [(-999.0, 5)]
    draws = list(np.random.default_rng(3).exponential(3, 400)) + [80, 95, 120]
    assert len(rows(outliers.method_disagreement(outliers.outlier_stats(column(spark, draws))))) == 1


def test_outliers_are_the_same_on_the_path_for_large_tables(spark, scaled):
    draws = list(np.random.default_rng(4).exponential(3, 200))
    one, two = stats(spark, draws), stats(spark, draws, settings=scaled)
    assert {m: r["count"] for m, r in one.items()} == {m: r["count"] for m, r in two.items()}


# ---- categorical ------------------------------------------------------------------

def test_categorical_stats(spark):
    df = spark.createDataFrame([(v, None) for v in ["a"] * 190 + ["b"] * 9 + ["c"]], "x string, none string")
    got = rows(categorical.categorical_stats(df), "column")
    p = np.array([0.95, 0.045, 0.005])
    assert got["x"]["top_value"] == "a" and got["x"]["top_rate"] == 0.95 and got["x"]["second_rate"] == 0.045
    assert got["x"]["rare_categories"] == 1 and got["x"]["is_dominant"]
    assert got["x"]["entropy"] == pytest.approx(-(p * np.log2(p)).sum())
    assert got["none"]["count"] == 0 and got["none"]["missing"] == 200 and got["none"]["top_value"] is None


def test_high_cardinality_and_frequency_table(spark):
    df = spark.createDataFrame([(f"key-{i}", "abc"[min(i // 5, 2) if i < 8 else 2]) for i in range(10)], "k string, v string")
    assert rows(categorical.categorical_stats(df), "column")["k"]["is_high_cardinality"]
    got = rows(categorical.frequency_table(df, "v", 2))
    assert [r["value"] for r in got] == ["a", "b", "(other 1 categories)"] and got[0]["percent"] == 50.0


def test_ranks_outside_their_brackets_are_sought_again(spark):
    from tabscope.plans.quantiles import order_statistics

    df = column(spark, [3, 1, 2, 2, 9, 8, 7], "v")
    found = order_statistics(df, {"v": list(range(7))}, {"v": 7}, slack=-1e4)
    assert [found["v", r] for r in range(7)] == [1, 2, 2, 3, 7, 8, 9]
