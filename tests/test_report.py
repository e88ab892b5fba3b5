from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tabscope.operators import findings, health
from tabscope.operators.investigate import investigate
from tabscope.settings import HEALTH_WEIGHTS, Options

INPUTS = dict(missing_rate=0.0, sparse_columns=0, iqr_cells=0, iqr_columns=0, numeric_cells=100, issue_columns=0,
              duplicate_rate=0.0, duplicate_rows=0, constant_columns=0, near_constant_columns=0, n_columns=10)


def score(spark, **changes):
    inputs = spark.createDataFrame(pd.DataFrame([{**INPUTS, **changes}]))
    return rows(health.health_score(health.health_components(inputs)))[0]


def test_weights_and_a_clean_table(spark):
    assert sum(HEALTH_WEIGHTS.values()) == pytest.approx(1.0)
    assert (score(spark)["score"], score(spark)["grade"]) == (100.0, "Excellent")


def test_score_falls_with_every_defect(spark):
    for change in (dict(missing_rate=0.05), dict(sparse_columns=2), dict(iqr_cells=3), dict(issue_columns=1),
                   dict(duplicate_rate=0.02), dict(constant_columns=1), dict(near_constant_columns=1)):
        assert score(spark, **change)["score"] < 100.0
    worst = score(spark, missing_rate=1.0, iqr_cells=100, issue_columns=10, duplicate_rate=1.0, constant_columns=10)
    assert (worst["score"], worst["grade"]) == (0.0, "Critical")
    assert score(spark, numeric_cells=0)["score"] == 100.0


def students(spark, n=400):
    """A table with the usual defects: copies, gaps, text numbers, a constant, extremes, a leak."""
    rng = np.random.default_rng(42)
    exam = np.round(rng.normal(60, 12, n), 1)
    hours = np.round(rng.gamma(3, 4, n), 1)
    pdf = pd.DataFrame({
        "student_id": [f"STU-{i:05d}" for i in range(n)], "age": rng.integers(16, 27, n), "gender": rng.choice(["f", "m"], n),
        "hours": hours, "hours_copy": hours, "exam_score": exam, "income": [f"{v:,}" for v in rng.integers(20_000, 90_000, n)],
        "school": np.where(np.arange(n) == 3, "Private", "Public"), "source": "export-1",
        "enrolled": pd.date_range("2024-01-01", periods=n, freq="6h").strftime("%Y-%m-%d"), "is_at_risk": (exam < 55).astype(int)})
    pdf.loc[::9, "age"] = 400
    pdf["sleep"] = np.where(np.arange(n) % 4 == 0, np.nan, rng.normal(7, 1, n))
    df = spark.createDataFrame(pdf)
    return df.unionByName(df.where("student_id < 'STU-00008'"))


def test_planted_defects_are_all_found(spark):
    df = students(spark)
    found = investigate(df, Options(trees=20, id_columns=("student_id",)))
    assert rows(found["duplicate_summary"])[0]["duplicate_rows"] == 8
    low = rows(found["low_variance"], "column")
    assert low["source"]["is_constant"] and low["school"]["is_near_constant"]
    assert {r["column"]: r["issue"] for r in rows(found["dtype_issues"])} == {
        "income": "numeric_stored_as_text", "enrolled": "datetime_stored_as_text"}
    assert rows(found["outlier_stats"], "column", "method")["age", "iqr"]["count"] > 0
    signals = {(r["column"], r["signal"]) for r in rows(found["leakage_signals"])}
    assert {("exam_score", "perfect_separation"), ("hours_copy", "duplicate_column"), ("is_at_risk", "target_selection")} <= signals
    assert rows(found["anomaly_summary"])[0]["n_anomalies"] > 0
    scored = rows(found["health_score"])[0]
    assert 0 < scored["score"] < 100
    listed = rows(found["findings"])
    ranks = [r["severity_rank"] for r in listed]
    assert ranks == sorted(ranks, reverse=True) and {"missing_data", "duplicates", "leakage"} <= {r["category"] for r in listed}
    assert len(rows(found["recommendations"])) <= 8 and rows(found["executive_summary"])[0]["line"].startswith("[")
    assert found["anomaly_records"].count() == 408
    assert sum(r["n"] for r in rows(found["severity_counts"])) == len(listed)
    assert rows(findings.serious(found["findings"])) == [r for r in listed if r["severity_rank"] >= 3]


OFF = Options(enable_anomalies=False, enable_leakage=False)


@pytest.mark.parametrize("name,frame", [
    ("all text", {"a": ["x", "y"] * 40, "b": ["p", "q", "r", "s"] * 20}),
    ("one row", {"a": [1.0], "b": ["x"]}),
    ("infinities", {"a": [1.0, np.inf, -np.inf, 4.0] * 5, "b": range(20)}),
])
def test_edge_tables(spark, name, frame):
    found = investigate(spark.createDataFrame(pd.DataFrame(frame)), OFF)
    assert found["findings"].count() > 0 and 0 <= rows(found["health_score"])[0]["score"] <= 100


def test_all_null_column(spark):
    df = spark.range(30).select(F.lit(None).cast("string").alias("a"))
    found = investigate(df, Options())
    assert rows(found["missing_summary"])[0]["missing_rate"] == 1.0
    assert not rows(found["anomaly_summary"])[0]["available"]


def test_cleanup_deletes_what_was_written(spark, tmp_path):
    from tabscope.plans import stored
    df = stored.stored(spark.range(3), "mine")
    path = stored._written[-1]
    assert df.count() == 3
    kept, stored._written[:] = stored._written[:-1], [path]
    assert stored.cleanup(spark) == 1 and not stored._written
    stored._written[:] = kept
