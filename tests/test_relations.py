from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from conftest import rows

from pyspark.sql import functions as F

from tabscope.functions import pvalues
from tabscope.operators import association, correlation
from tabscope.plans.running import with_ranks
from tabscope.settings import Settings


def pair_values(df):
    return {(r["column_a"], r["column_b"]): r for r in rows(df)}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 25, 120).astype(float)
    pdf = pd.DataFrame({"x": x, "y": 2 * x + rng.integers(0, 9, 120), "gap": np.where(np.arange(120) % 3 == 0, np.nan, -x),
                        "noise": rng.normal(size=120), "flat": 1.0})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_matches_pandas(table, method):
    pdf, df = table
    want = pdf.corr(method=method)
    got = pair_values(correlation.correlation_pairs(df, method=method, with_p=False))
    assert len(got) == 6 and not any("flat" in k for k in got)
    for (a, b), r in got.items():
        assert r["r"] == pytest.approx(want.loc[a, b], abs=1e-12)
    assert got["x", "gap"]["n_observations"] == 80


def brute_tau(a, b):
    s = np.sign(a[:, None] - a[None, :]) * np.sign(b[:, None] - b[None, :])
    pairs = len(a) * (len(a) - 1) / 2
    ties = [sum(c * (c - 1) / 2 for c in np.unique(v, return_counts=True)[1]) for v in (a, b)]
    return s.sum() / 2 / math.sqrt((pairs - ties[0]) * (pairs - ties[1]))


@pytest.mark.parametrize("limits", [Settings(), Settings(inversion_block=7), Settings(inversion_block=1)])
def test_kendall_matches_brute_force(spark, table, limits):
    pdf, _ = table
    df = spark.createDataFrame(pdf[["x", "y"]])
    got = rows(correlation.kendall_pair(df, limits))[0]
    assert got["r"] == pytest.approx(brute_tau(pdf["x"].to_numpy(), pdf["y"].to_numpy()), abs=1e-12)


@pytest.fixture(scope="module")
def gaps(spark):
    """Ten columns with gaps, ties and one value in a third of the rows."""
    rng = np.random.default_rng(21)
    base = rng.normal(size=400)
    pdf = pd.DataFrame({f"c{i}": np.round(base * i + rng.normal(size=400) * 3, i % 4) for i in range(10)})
    pdf.loc[rng.random(400) < 0.35, "c2"] = 1.5
    for i in range(1, 10):
        pdf.loc[rng.random(400) < i / 20, f"c{i}"] = np.nan
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_many_columns_with_gaps(gaps, method):
    pdf, df = gaps
    want = pdf.corr(method=method)
    got = pair_values(correlation.correlation_pairs(df, method=method, with_p=False))
    assert len(got) == 45
    for (a, b), r in got.items():
        assert r["r"] == pytest.approx(want.loc[a, b], abs=1e-12)
        assert r["n_observations"] == len(pdf[[a, b]].dropna())


@pytest.mark.parametrize("block", [1 << 18, 60, 9])
def test_kendall_of_many_columns_with_gaps(gaps, block):
    pdf, df = gaps
    got = pair_values(correlation.correlation_pairs(df, method="kendall", settings=Settings(inversion_block=block), with_p=False))
    assert len(got) == 45
    for (a, b), r in got.items():
        own = pdf[[a, b]].dropna().to_numpy()
        assert r["r"] == pytest.approx(brute_tau(own[:, 0], own[:, 1]), abs=1e-12) and r["n_observations"] == len(own)


def test_rank_plans_do_not_grow_with_pairs(gaps):
    pdf, df = gaps
    sizes = []
    for n in (3, 6, 10):
        table = df.select(*[F.col(f"c{i}").alias(f"v{i}") for i in range(n)]).where("v0 > -100").withColumn("v0", F.when(F.col("v0") > -1, F.col("v0")))
        table = table.select(*[F.when(~F.isnan(f"v{i}"), F.col(f"v{i}")).alias(f"v{i}") for i in range(n)])
        pairs = [(0, i) for i in range(1, n)]
        sizes.append([f(table, pairs)._jdf.queryExecution().optimizedPlan().collectLeaves().size() for f in (correlation.spearman, correlation.kendall)])
    assert sizes[0] == sizes[1] == sizes[2]


@pytest.mark.parametrize("seed", range(4))
def test_inversions_match_brute_force(seed):
    rng = np.random.default_rng(seed)
    x, y, n = rng.integers(0, 9, 80), rng.integers(0, 5 + 40 * seed, 80).astype(float), rng.integers(1, 6, 80)
    want = sum(n[i] * n[j] for i in range(80) for j in range(80) if x[i] < x[j] and y[i] > y[j])
    assert correlation.inversions(x, y, n) == want
    assert correlation.inversions(x[:0], y[:0], n[:0]) == 0


def test_exact_kendall_p_values(spark):
    from itertools import permutations
    for n in range(2, 8):
        discordant = [sum(p[i] > p[j] for i in range(n) for j in range(i + 1, n)) for p in permutations(range(n))]
        total = n * (n - 1) // 2
        for d in range(total + 1):
            fewest = min(d, total - d)
            want = min(1.0, 2 * sum(x <= fewest for x in discordant) / len(discordant))
            assert pvalues.kendall_p(d, n) == pytest.approx(want, rel=1e-12)
    assert pvalues.kendall_p(1, 40) == pytest.approx(2 * 40 / math.factorial(40))
    assert pvalues.orders_by_discordance(33)[-1] == math.factorial(33)
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame({"x": np.arange(20.0), "y": np.arange(20.0) + rng.normal(size=20) * 4, "tied": np.arange(20.0) // 2}))
    got = pair_values(correlation.correlation_pairs(df, method="kendall"))
    tau = got["x", "y"]["r"]
    assert got["x", "y"]["p_value"] == pytest.approx(pvalues.kendall_p(round((1 - tau) / 2 * 190), 20))
    assert 0 < got["x", "tied"]["p_value"] < 1e-5


def test_distant_values_keep_their_digits(spark):
    """Columns far from zero, and one that is constant, or nearly, over a pair's rows but not over its own."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=300)
    step = np.where(np.arange(300) < 150, 0.0, 1e6)
    pdf = pd.DataFrame({"x": 1e12 + x, "big": 1e150 * (x + rng.normal(size=300)), "step": step, "slope": step + np.where(np.arange(300) < 150, x, 0.0) * 1e-3})
    pdf["half"] = np.where(np.arange(300) < 150, x + rng.normal(size=300), np.nan)
    got = pair_values(correlation.correlation_pairs(spark.createDataFrame(pdf), with_p=False))
    assert got["x", "big"]["r"] == pytest.approx(np.corrcoef(x, pdf["big"] / 1e150)[0, 1], abs=1e-3)
    assert ("step", "half") not in got and ("half", "step") not in got
    assert got["slope", "half"]["r"] == pytest.approx(np.corrcoef(x[:150], pdf["half"][:150])[0, 1], abs=1e-6)


def test_many_full_columns_take_the_matrix_path(spark):
    pdf = pd.DataFrame(np.random.default_rng(6).normal(size=(60, 6)), columns=list("abcdef"))
    pdf.loc[3, "f"] = np.nan
    got = pair_values(correlation.correlation_pairs(spark.createDataFrame(pdf), with_p=False))
    want = pdf.corr()
    assert len(got) == 15 and all(r["r"] == pytest.approx(want.loc[k], abs=1e-12) for k, r in got.items())


def test_labels_sets_and_p_values(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "strong": 3 * x + rng.normal(0, 0.1, 200), "down": -x, "weak": rng.normal(size=200)}))
    pairs = correlation.correlation_pairs(df)
    got = pair_values(pairs)
    assert got["x", "strong"]["strength"] == "near-perfect" and got["x", "strong"]["p_value"] < 1e-6
    assert got["x", "weak"]["p_value"] > 1e-4 and got["x", "down"]["direction"] == "negative"
    filtered = pair_values(correlation.correlation_pairs(df, settings=Settings(p_value_from=0.5)))
    assert filtered["x", "weak"]["p_value"] is None and filtered["x", "strong"]["p_value"] is not None
    sets = {r["pair_set"] for r in rows(correlation.strong_pairs(pairs))}
    assert sets == {"strong_positive", "strong_negative", "multicollinear", "near_duplicate"}


def test_known_tail_probabilities():
    assert pvalues.correlation_p(0.5, 10) == pytest.approx(0.1411132812500002)
    assert pvalues.correlation_p(0.5, 4) == pytest.approx(0.5)  # two degrees of freedom: 1 - r
    assert pvalues.correlation_p(1.0, 20) == 0.0 and pvalues.correlation_p(0.3, 2) is None
    assert pvalues.chi_square_p(7.0, 2) == pytest.approx(math.exp(-3.5))
    assert pvalues.chi_square_p(3.841458820694124, 1) == pytest.approx(0.05)
    x = 11.0
    assert pvalues.chi_square_p(x, 6) == pytest.approx(math.exp(-x / 2) * (1 + x / 2 + (x / 2) ** 2 / 2))


def test_cramers_v(spark):
    same = spark.createDataFrame([("a", "x")] * 30 + [("b", "y")] * 30, "p string, q string")
    got = rows(association.chi_square_test(same, "p", "q"))[0]
    assert got["cramers_v"] == pytest.approx(1.0) and got["dof"] == 1 and got["chi2"] == pytest.approx(60)
    rng = np.random.default_rng(8)
    a = rng.integers(0, 3, 300)
    df = spark.createDataFrame([(f"l{i}", f"m{i}", f"n{j}", "one") for i, j in zip(a, rng.integers(0, 2, 300))],
                               "a string, b string, c string, k string")
    got = rows(association.associations(df))
    assert (got[0]["column_a"], got[0]["column_b"]) == ("a", "b") and got[0]["cramers_v"] > 0.9 and len(got) == 3


def test_every_categorical_column_is_compared(spark):
    """No limit on columns; those without a suitable number of levels are named with a reason."""
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({f"k{i:02d}": rng.integers(0, 3, 80).astype(str) for i in range(18)}).assign(one="x", many=[str(i) for i in range(80)])
    df = spark.createDataFrame(pdf)
    assert association.associations(df, list(pdf.columns)).count() == 18 * 17 // 2
    left = {r["column"]: r["reason"] for r in association.association_levels(df, list(pdf.columns)).where("not available").collect()}
    assert left == {"one": "fewer than two levels", "many": "more than 40 levels"}


def test_rank_plans_grow_by_one_scan_per_column(spark):
    pdf = pd.DataFrame(np.random.default_rng(13).normal(size=(50, 6)), columns=list("abcdef"))
    df = spark.createDataFrame(pdf)
    scans = []
    for n in (2, 4, 6):
        table = df.select(*[F.col(c).alias(f"v{i}") for i, c in enumerate("abcdef"[:n])])
        ranked = with_ranks(table, table, {f"v{i}": f"r{i}" for i in range(n)})
        scans.append(ranked._jdf.queryExecution().optimizedPlan().collectLeaves().size())
    assert scans == [3, 5, 7]
