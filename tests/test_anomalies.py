from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tabscope.functions import isolation
from tabscope.functions.isolation import expected_path, grow_tree, mean_path
from tabscope.operators import anomalies
from tabscope.settings import DEFAULT


@pytest.fixture(scope="module")
def planted(spark):
    points = np.vstack([np.random.default_rng(9).normal(size=(500, 3)), [[12] * 3, [-11] * 3]])
    return spark.createDataFrame(pd.DataFrame(points, columns=list("abc")).assign(i=range(502)))


def test_planted_points_are_found(spark, planted):
    found = anomalies.detect_anomalies(planted, ["a", "b", "c"], contamination=0.01, id_columns=["i"], trees=60)
    worst = rows(anomalies.anomaly_examples(found.records))
    assert {worst[0]["i"], worst[1]["i"]} == {500, 501}
    summary = rows(anomalies.anomaly_summary(found, spark))[0]
    assert summary["n_rows_scored"] == 502 and 0.008 <= summary["anomaly_rate"] <= 0.012
    assert worst[0]["anomaly_percentile"] == pytest.approx(100 / 502) and worst[0]["anomaly_decision"] < 0
    assert found.records.where("anomaly_percentile is null").count() == 0
    deviations = rows(anomalies.feature_deviations(found.records, found.features))
    assert len(deviations) == 3 and deviations[0]["max_abs_robust_z"] > 5


def test_scores_do_not_depend_on_row_order_or_partitions(planted):
    options = dict(contamination=0.02, id_columns=["i"], trees=20, with_percentile=False)
    one = rows(anomalies.detect_anomalies(planted, ["a", "b", "c"], **options).records, "i")
    two = rows(anomalies.detect_anomalies(planted.repartition(7), ["a", "b", "c"], **options).records, "i")
    assert all(one[i]["anomaly_score"] == two[i]["anomaly_score"] for i in one)


@pytest.mark.parametrize("frame", [{"a": range(3), "b": range(3)}, {"a": range(60)}, {"a": range(60), "b": [0, 1] * 30}])
def test_unsuitable_tables_give_a_reason(spark, frame):
    found = anomalies.detect_anomalies(spark.createDataFrame(pd.DataFrame(frame)), trees=5)
    assert not found.available and found.reason
    assert not rows(anomalies.anomaly_summary(found, spark))[0]["available"]


def test_rows_with_gaps_are_scored(spark):
    pdf = pd.DataFrame(np.random.default_rng(10).normal(size=(200, 2)), columns=["a", "b"])
    pdf.loc[::10, "a"] = np.nan
    found = anomalies.detect_anomalies(spark.createDataFrame(pdf.assign(i=range(200))), ["a", "b"], id_columns=["i"], trees=10)
    assert found.records.where("anomaly_score is not null").count() == 200


def test_large_draws_are_dealt_out_without_overlap(spark, planted):
    forest = anomalies.grow_forest(planted, ["a", "b", "c"], id_columns=["i"], trees=1)
    assert len(forest.trees["path"]) == 1 and forest.sample == 256


def test_tree_isolates_every_point():
    points = np.array([[1.0], [2.0], [50.0]])
    nodes = grow_tree(points, np.random.default_rng(0), 8)
    nodes.sort()
    arrays = {k: [np.array([n[j] for n in nodes], dtype=t)] for j, (k, t) in enumerate(
        [("node", "int64"), ("feature", "int64"), ("threshold", "float64"), ("left", "int64"), ("path", "float64")])}
    depth = mean_path([points[:, 0]], arrays, 8)
    assert depth[2] == depth.min() == 1.0
    assert expected_path(2) == 1.0 and expected_path(1) == 0.0


def test_repeated_ids_and_rows_are_drawn(spark):
    """A constant id, and many copies of few rows, still give every tree a sample."""
    df = spark.createDataFrame(pd.DataFrame({"i": 5, "a": [1.0, 2.0, 3.0, 4.0] * 500, "b": [4.0, 1.0, 3.0, 2.0] * 500}))
    forest = anomalies.grow_forest(df, ["a", "b"], id_columns=["i"], trees=4)
    assert len(forest.trees["path"]) == 4 and all(len(p) > 1 for p in forest.trees["path"])
    found = anomalies.detect_anomalies(df, ["a", "b"], id_columns=["i"], trees=4)
    assert found.available and found.records.count() == 2000
    assert found.records.where("anomaly_percentile is null").count() == 0


def test_rows_are_scored_once(spark, planted):
    found = anomalies.detect_anomalies(planted, ["a", "b", "c"], id_columns=["i"], trees=5)
    assert "ArrowEvalPython" not in found.records._jdf.queryExecution().toString()


def _trees(points, number, sample, depth):
    trees = {k: [] for k in ("feature", "threshold", "left", "path")}
    for tree in range(number):
        rng = np.random.default_rng([3, tree])
        nodes = sorted(grow_tree(points[rng.choice(len(points), sample, replace=False)], rng, depth))
        for j, (k, t) in enumerate([("feature", "int64"), ("threshold", "float64"), ("left", "int64"), ("path", "float64")], 1):
            trees[k].append(np.array([n[j] for n in nodes], dtype=t))
    return trees


def _plain_walk(columns, trees, depth):
    """Node by node, each with its own feature and threshold."""
    n = len(columns[0])
    values, own, total = np.concatenate(columns), np.arange(n), np.zeros(n)
    for feature, threshold, left, path in zip(trees["feature"], trees["threshold"], trees["left"], trees["path"]):
        at = np.zeros(n, dtype=np.intp)
        for _ in range(depth):
            at = left.take(at) + (values.take((feature * n).take(at) + own) > threshold.take(at))
        total += path.take(at)
    return total / len(trees["feature"])


def _columns(rng, n):
    return [rng.normal(size=n), rng.integers(0, 5, n).astype(float), rng.exponential(size=n).round(1), rng.normal(size=n) * 1e200]


@pytest.mark.parametrize(("sample", "depth", "features"), [(256, 8, 4), (600, 10, 2), (5, 3, 4), (2, 1, 1), (1, 1, 1), (40, 2, 3)])
def test_walk_equals_the_plain_one(monkeypatch, sample, depth, features):
    monkeypatch.setattr(isolation, "WALKERS", 700)
    rng = np.random.default_rng(21)
    trees = _trees(np.stack(_columns(rng, 2000)[:features], axis=1), 12, sample, depth)
    columns = _columns(rng, 3001)[:features]
    for k in range(features):  # values that are thresholds, and beyond all
        cuts = np.concatenate([t[f == k] for f, t in zip(trees["feature"], trees["threshold"])])
        columns[k][:len(cuts)] = cuts[:3001]
    columns[0][-2:] = np.inf, -np.inf
    assert (mean_path(columns, trees, depth) == _plain_walk(columns, trees, depth)).all()
    assert len(mean_path([c[:0] for c in columns], trees, depth)) == 0


def test_walk_takes_less_time_than_the_plain_one():
    """Scoring takes most of the time on large tables."""
    rng = np.random.default_rng(22)
    trees = _trees(np.stack(_columns(rng, 20_000), axis=1), 40, 256, 8)
    columns = _columns(rng, 60_000)

    def seconds(walk):
        start = time.process_time()
        walk(columns, trees, 8)
        return time.process_time() - start

    assert min(seconds(mean_path) for _ in range(4)) < 0.75 * min(seconds(_plain_walk) for _ in range(4))


def test_pool_is_that_of_all_rows_and_counts_few_of_them(spark, monkeypatch):
    """Whether a key repeats is asked only of keys that may be drawn; the pool is the one that a count of all keys gives."""
    df = spark.range(0, 60_000, 1, 4).select(
        F.when(F.col("id") < 50_000, F.col("id")).otherwise(F.col("id") % 7).alias("i"),
        F.when(F.col("id") < 50_000, F.col("id") % 1000).otherwise(F.col("id") % 7).cast("double").alias("a"))
    written = {}

    def keep(frame, label):
        written[label] = frame.localCheckpoint()
        return written[label]

    monkeypatch.setattr(anomalies, "stored", keep)
    size, seed = 200, DEFAULT.seed
    pool = anomalies._pool(df, ["a"], {"a": 0.0}, ["i"], size, 60_000, seed)
    assert written["keys"].count() < 20 * size
    points = df.select(F.xxhash64(F.lit(seed), "i", "a").alias("key"), "a", F.monotonically_increasing_id().alias("row_no"))
    times = points.groupBy("key").agg(F.count("*").alias("n"))
    picks = points.join(times, "key").select("key", "a", F.pmod(F.xxhash64(
        "key", F.lit(seed), F.when(F.col("n") > 1, F.col("row_no"))), F.lit(anomalies.PICK_RANGE)).alias("pick"), "n")
    want = picks.orderBy("pick", "key").limit(size).collect()
    assert pool[:, 0].tolist() == [r["a"] for r in want] and any(r["n"] > 1 for r in want)
