from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tabscope import settings as S
from tabscope.functions import columns
from tabscope.operators import leakage, profile
from tabscope.plans.counts import value_counts
from tabscope.settings import Settings


def facts_of(df):
    return leakage.column_facts(df)


def signals(df, target=None):
    return {(r["column"], r["signal"]): r for r in rows(leakage.leakage_signals(df, target))}


def test_target_names(spark):
    df = spark.createDataFrame([(1.0 * i, i % 2, i % 2) for i in range(30)], "x double, is_at_risk int, target int")
    assert leakage.guess_target(facts_of(df)) == "target"
    assert leakage.guess_target(facts_of(df.drop("target"))) == "is_at_risk"
    assert leakage.guess_target(facts_of(df.select("x"))) is None
    tie = df.withColumnRenamed("target", "has_churned")
    assert leakage.guess_target(facts_of(tie)) == "has_churned"


def test_identifiers(spark):
    df = spark.createDataFrame([(f"C{i:04d}", 1000.0 + i * 1.7, i) for i in range(200)], "customer_id string, house_price double, row_number int")
    got = signals(df)
    assert got["customer_id", "identifier_like"]["severity"] == "moderate"
    assert got["row_number", "identifier_like"]["confidence"] == "low"
    assert ("house_price", "identifier_like") not in got


def test_outcome_names_need_whole_words(spark):
    df = spark.createDataFrame([("f", 0.5, i % 2, i % 3) for i in range(30)],
                               "gender string, attendance_rate double, course_completed int, assignments_completed int")
    got = rows(leakage.outcome_name_signals(facts_of(df)), "column")
    assert set(got) == {"course_completed"}


def test_copies_of_columns_and_target(spark):
    df = spark.createDataFrame([(i * 1.5, i * 1.5, i % 2, i % 2, i * 1.5 if i % 3 else None) for i in range(120)],
                               "score_a double, score_b double, target int, outcome int, partly double")
    got = signals(df, "target")
    assert got["score_b", "duplicate_column"]["severity"] == "high" and ("partly", "duplicate_column") in got
    assert got["outcome", "target_copy"]["severity"] == "critical"


@pytest.mark.parametrize("limits", [Settings(), Settings(small_group_rows=7)])
@pytest.mark.parametrize("direction", [1, -1])
def test_separation_in_both_directions(spark, limits, direction):
    rng = np.random.default_rng(11)
    exam = rng.normal(60, 10, 400)
    df = spark.createDataFrame(pd.DataFrame({"exam": direction * exam, "noise": rng.normal(size=400), "fail": (exam < 55).astype(int),
                                             "segment": np.where(exam < 55, "low", "high")}))
    got = rows(leakage.separation(df, "fail", settings=limits), "column")
    assert got["exam"]["accuracy"] == 1.0 and got["segment"]["accuracy"] == 1.0 and got["noise"]["accuracy"] < 0.95


def test_threshold_never_splits_equal_values(spark):
    df = spark.createDataFrame([(1.0, i % 2) for i in range(60)] + [(2.0, 1)] * 40, "x double, y int")
    assert rows(leakage.separation(df, "y"))[0]["accuracy"] == 0.7


def test_target_correlation(spark):
    price = np.random.default_rng(12).normal(100, 20, 300)
    df = spark.createDataFrame(pd.DataFrame({"deal_value": 1.0005 * price, "other": price[::-1], "sale_price": price}))
    got = signals(df, "sale_price")
    assert ("deal_value", "target_correlation") in got and ("other", "target_correlation") not in got


def test_unknown_target_is_ignored(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert signals(df, "missing") == {}


def test_refuted_pairs_match_a_plain_comparison(spark):
    """Many columns, gaps, two zeros, NaN, texts and dates; one difference in one row refutes a pair."""
    rng = np.random.default_rng(31)
    base = rng.integers(0, 3, 500).astype(float)
    pdf = pd.DataFrame({f"c{i:03d}": base for i in range(60)})
    for i in range(20, 60):
        pdf.loc[rng.integers(0, 500), f"c{i:03d}"] += i
    pdf.loc[:, "zero"] = np.where(base == 0, -0.0, base)
    pdf.loc[rng.random(500) < 0.5, "c001"] = np.nan
    pdf["t1"] = pd.Series(base).astype(str)
    pdf["t2"] = pdf["t1"]
    df = spark.createDataFrame(pdf).repartition(6)
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    got = {(r["column_a"], r["column_b"]) for r in leakage.duplicate_pairs(df).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before
    names = list(pdf.columns[:61])
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1:]
            if ((pdf[a] == pdf[b]) | pdf[a].isna() | pdf[b].isna()).all() and (pdf[a].notna() & pdf[b].notna()).sum() >= 250}
    assert got == want | {("t1", "t2")} and len(want) > 150
    assert jobs < 30  # of 1,830 pairs


def test_values_are_counted_once(spark, monkeypatch):
    """Five parts read the facts of the columns, whose counts are the largest shuffle."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(_):
        read.add(1)
        return True

    monkeypatch.setattr(leakage, "value_counts", lambda df: value_counts(df.where(seen.asNondeterministic()("score"))))
    df = spark.createDataFrame([(i * 1.5, f"K{i:04d}", "ab"[i % 2], i % 2) for i in range(300)], "score double, record_key string, final_state string, target int")
    got = signals(df)
    assert {("record_key", "identifier_like"), ("final_state", "perfect_separation"), ("final_state", "outcome_name"), ("target", "target_selection")} <= set(got)
    assert read.value == 300


ODD = ["", " ", "1", " 1 ", "+1", "-1", "(12)", "( 12 )", "12%", "$1,200", "-$5", "1e5", "1E+5", ".5", "5.", ".", "e", "+", "()", "%", "1\n", "1\u2028", "\u00a07\u3000", "1\x00",
       "1-2", "1-2-3", "1/2/99", "12:30", "1:2", "2024-1-5", "2024/01/05 10:11:12", " 2024-01-05T10:11:12Z ", "5 Jan 2024", "JAN 2024", "jAn", "mart", "second", "deck",
       "1999/1/1", "199-1-1", "1-URGENT", "4-NOT SPECIFIED", "ORD-1234", "\u017fep", "yes", "NO", "T", "\u0661", "\U0001f600", "12\u20ac", "nan", "inf", "0x10", "1d", "1f"]


def test_facts_of_distinct_texts_are_those_of_all(spark):
    df = spark.createDataFrame([(t, "x" if i % 3 else None, None, i, f"{i % 9}%") for i, t in enumerate(ODD * 3 + [None])],
                               "odd string, gaps string, nothing string, whole int, share string")
    df = df.withColumn("day", F.to_timestamp(F.lit("2024-01-05")))
    want = rows(profile.text_probe(df), "column")
    got = rows(profile.value_facts(value_counts(df), ["odd", "gaps", "nothing", "share"]), "column")
    assert {c: {k: v for k, v in r.items() if k != "n_unique"} for c, r in got.items() if c not in ("whole", "day")} == {
        c: r for c, r in want.items() if r["n_present"]}
    assert got["odd"]["n_date"] > 3 and got["odd"]["n_number"] > 12 and got["day"]["n_date"] == 0
    assert got["odd"]["n_unique"] == len(set(ODD)) and got["share"]["n_unique"] == 9


def test_what_is_looked_at_first_refutes_no_number_and_no_date(spark):
    t, bare = F.col("t"), columns.undecorated(F.col("t"))
    df = spark.createDataFrame([(x,) for x in ODD] + [(f"{a}{m}{b}",) for m in "Jan fEB MAR apr may jun jul aug sep oct nov dec".split() for a in ("", "x1") for b in ("", "9")], "t string")
    row = df.agg(F.count_if(columns.date_hinted(t) != t.rlike(S.DATE_HINT)), F.count_if(
        ~columns.parse_number(t).eqNullSafe(F.when(bare.rlike(S.PLAIN_NUMBER), bare.try_cast("double")))), F.count_if(columns.date_hinted(t))).first()
    assert row[0] == row[1] == 0 and row[2] > 50


def test_separation_is_the_same_with_known_facts(spark):
    df = spark.createDataFrame([(i % 2, "ab"[i % 2] if i % 5 else None, "same", "few" if i < 9 else None, float("nan") if i % 2 else 1.0) for i in range(120)],
                               "target int, text string, one string, few string, x double").withColumn("day", F.expr("date_add(date'2024-01-01', target)"))
    known = rows(leakage.separation(df, "target", facts=facts_of(df)), "column")
    assert known == rows(leakage.separation(df, "target"), "column") and set(known) == {"text", "day"}
