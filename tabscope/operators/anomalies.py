"""Multivariate anomalies by an isolation forest.

A pool of trees x sample rows (51,200 by default) is drawn by hash and broadcast; every tree draws its sample from
the pool, and trees are grown in parallel tasks.  Their nodes (at most trees x 2 x sample rows) are broadcast, and every
row of the table is scored once, by vectorised tree walks in Arrow batches; ids, features and scores are stored, and
everything else is derived from that table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabscope.functions.columns import as_rows, col, fields, finite, groupable, of_kind, share
from tabscope.functions.isolation import WALKERS, Heaps, expected_path, grow_tree, heaps, walk
from tabscope.plans.facts import NumberFacts, number_facts
from tabscope.plans.quantiles import exact_quantiles
from tabscope.plans.running import attach, average_ranks
from tabscope.plans.stored import stored
from tabscope.settings import DEFAULT, Settings

NODE_SCHEMA = "tree int, node int, feature long, threshold double, left long, path double"
PICK_RANGE = 1 << 40


@dataclass
class Forest:
    """A grown forest with what is needed to score rows; all of it has a fixed size."""

    features: list[str]
    medians: dict[str, float]
    trees: dict[str, list[np.ndarray]]
    depth_limit: int
    sample: int
    rows: int
    offset: float | None = None


def anomaly_features(df: DataFrame, columns: Sequence[str] | None = None, *, settings: Settings = DEFAULT,
                     facts: dict[str, NumberFacts] | None = None) -> tuple[list[str], list[str], dict[str, NumberFacts]]:
    """(used, left out, facts): numeric columns with at least four distinct values, and the rest."""
    names = of_kind(df, "numeric", columns)
    facts = number_facts(df, names, settings=settings, mads=False) if facts is None else facts
    used = [n for n in names if facts[n].distinct_class >= settings.min_distinct_outliers]
    return used, [n for n in names if n not in used and facts[n].n], facts


def imputed(df: DataFrame, features: Sequence[str], medians: dict[str, float]) -> list[Column]:
    return [F.coalesce(finite(f), F.lit(medians[f.name])) for f in fields(df, features)]


def standardised(df: DataFrame, columns: Sequence[str] | None = None, *, id_columns: Sequence[str] = (),
                 settings: Settings = DEFAULT) -> DataFrame:
    """Features with gaps and infinities replaced by the median, then scaled to mean 0, deviation 1.

    The forest itself works on unscaled values: scaling each feature does not change where
    an isolation tree can split.
    """
    used, _, facts = anomaly_features(df, columns, settings=settings)
    full = imputed(df, used, {n: facts[n].quartiles[1] for n in used})
    row = df.agg(*[e for i, v in enumerate(full) for e in (F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}"))]).first()
    return df.select(*[col(c) for c in id_columns], *[
        ((v - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0)).alias(used[i]) for i, v in enumerate(full)])


def grow_forest(df: DataFrame, features: Sequence[str], *, id_columns: Sequence[str] = (), trees: int | None = None,
                settings: Settings = DEFAULT, facts: dict[str, NumberFacts] | None = None) -> Forest:
    """Draw the pool, grow the trees in parallel, bring their nodes to the driver.

    The draw depends on ids (all columns if there are none), values and seed, not on how rows are stored; only rows
    that repeat in all of these are told apart by their place, so that they are drawn as often as they occur.
    """
    trees = settings.trees if trees is None else trees
    features = list(features)
    facts = number_facts(df, features, settings=settings, mads=False) if facts is None else facts
    medians = {n: facts[n].quartiles[1] for n in features}
    rows = df.count()
    sample = min(settings.tree_sample, rows)
    depth_limit = max(1, math.ceil(math.log2(max(sample, 2))))
    pool = _pool(df, features, medians, id_columns, min(rows, trees * sample), rows, settings.seed)
    points = df.sparkSession.sparkContext.broadcast(pool)
    seed = settings.seed

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree in batch["id"].tolist():
                rng = np.random.default_rng([seed, int(tree)])
                own = points.value[rng.choice(len(points.value), sample, replace=False)]
                out = pd.DataFrame(grow_tree(own, rng, depth_limit), columns=["node", "feature", "threshold", "left", "path"])
                out.insert(0, "tree", int(tree))
                yield out

    nodes = df.sparkSession.range(0, trees, 1, min(trees, 32)).mapInPandas(grow, NODE_SCHEMA).toPandas()  # <= trees x 2 x sample rows
    parts: dict[str, list[np.ndarray]] = {k: [] for k in ("feature", "threshold", "left", "path")}
    kinds = {"feature": "int64", "threshold": "float64", "left": "int64", "path": "float64"}
    for _, tree in nodes.sort_values(["tree", "node"]).groupby("tree"):
        for k in parts:
            parts[k].append(tree[k].to_numpy(dtype=kinds[k]))
    return Forest(features, medians, parts, depth_limit, sample, rows)


def _pool(df: DataFrame, features: list[str], medians: dict[str, float], id_columns: Sequence[str], size: int, rows: int,
          seed: int) -> np.ndarray:
    """``size`` rows of features, those of the smallest picks."""
    identity = [col(c) for c in id_columns] or [col(c) for c in groupable(df)]
    point = imputed(df, features, medians)
    points = df.select(F.xxhash64(F.lit(seed), *identity, *point).alias("key"), F.array(*point).alias("point"),
                       F.monotonically_increasing_id().alias("row_no"))
    # picks are even: twice the share wanted holds the smallest ones, which is checked, and keeps counts and sort small
    wanted = 2.0 * size / max(rows, 1)
    small = F.broadcast  # some four times the size of the pool, however large the table
    while True:
        reach = int(PICK_RANGE * min(1.0, wanted))
        repeated = stored(repeated_keys(points, small(stored(keys_within(points, reach, seed), "keys"))), "repeated")
        place = F.when(F.col("of").isNotNull(), F.col("row_no"))
        picks = points.join(small(repeated), F.col("key") == F.col("of"), "left").select(_pick(seed, place).alias("pick"), "key", "point")
        found = picks.where(F.col("pick") < reach).orderBy("pick", "key").limit(size).select("point").collect()
        if len(found) >= size or wanted >= 1.0:
            return np.array([r["point"] for r in found], dtype="float64")
        wanted, small = wanted * 8, lambda keys: keys


def _pick(seed: int, place: Column) -> Column:
    return F.pmod(F.xxhash64("key", F.lit(seed), place), F.lit(PICK_RANGE))


def keys_within(points: DataFrame, reach: int, seed: int) -> DataFrame:
    """(of): keys with a pick below ``reach``, be they repeated or not; only of these it must be known which they are."""
    alone, placed = _pick(seed, F.lit(None).cast("long")), _pick(seed, F.col("row_no"))
    return points.where((alone < reach) | (placed < reach)).select(F.col("key").alias("of")).distinct()


def repeated_keys(points: DataFrame, keys: DataFrame) -> DataFrame:
    """(of): those of ``keys`` that more than one row has."""
    return (points.select("key").join(keys, F.col("key") == F.col("of"), "left_semi").groupBy("key").agg(F.count("*").alias("n"))
            .where("n > 1").select(F.col("key").alias("of")))


def anomaly_score(df: DataFrame, forest: Forest) -> Column:
    """Score column: minus 2^(-mean path / expected path); lower is more unusual."""
    model = df.sparkSession.sparkContext.broadcast(vars(heaps(forest.trees, forest.depth_limit, len(forest.features))))
    scale = float(max(expected_path(forest.sample), 1e-12))

    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        trees = Heaps(**model.value)
        scores = lambda parts: pd.Series(-np.exp2(-walk([np.concatenate(c) for c in zip(*parts)], trees) / scale))
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy(dtype="float64") for c in batch])
            n += len(batch[0])
            if n >= WALKERS:
                yield scores(held)
                held, n = [], 0
        if held:
            yield scores(held)

    score.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, T.DoubleType())(*imputed(df, forest.features, forest.medians))


@dataclass
class AnomalyResult:
    """``records`` holds ids, features, score, decision and label of every input row, from one stored table."""

    available: bool
    reason: str
    contamination: float
    features: list[str]
    forest: Forest | None = None
    records: DataFrame | None = None


def detect_anomalies(df: DataFrame, columns: Sequence[str] | None = None, *, contamination: float | None = None,
                     trees: int | None = None, id_columns: Sequence[str] = (), with_percentile: bool = True,
                     settings: Settings = DEFAULT, facts: dict[str, NumberFacts] | None = None) -> AnomalyResult:
    """Score all rows once and label the share ``contamination`` with the lowest scores.

    The labels' cut is the exact quantile of all scores.
    """
    s = settings
    contamination = min(max(s.contamination if contamination is None else contamination,
                            s.contamination_min), s.contamination_max)
    columns = [c for c in of_kind(df, "numeric", columns) if c not in set(id_columns)]
    rows = df.count()
    if rows < s.anomaly_rows:
        return AnomalyResult(False, f"{rows} rows are too few: at least {s.anomaly_rows} are needed.",
                             contamination, [])
    used, left_out, facts = anomaly_features(df, columns, settings=s, facts=facts)
    if len(used) < s.anomaly_features:
        return AnomalyResult(False, f"{len(used)} usable numeric column(s): at least {s.anomaly_features} are needed.",
                             contamination, used)
    forest = grow_forest(df, used, id_columns=id_columns, trees=trees, settings=s, facts=facts)
    narrow = _spread(df.select(*[col(c) for c in id_columns], *[col(f) for f in used]))
    scored = stored(narrow.withColumn("anomaly_score", anomaly_score(narrow, forest)), "scores")
    forest.offset = exact_quantiles(scored, {"s": F.col("anomaly_score")}, [contamination], s)["s"][0]
    records = scored.withColumn("anomaly_decision", F.col("anomaly_score") - F.lit(forest.offset)).withColumn(
        "is_anomaly", F.col("anomaly_decision") < 0)
    if with_percentile:
        records = with_percentile_rank(records, "anomaly_score", "anomaly_percentile", source=scored, settings=s)
    reason = f"Left out for having fewer than {s.min_distinct_outliers} distinct values: {', '.join(left_out)}." if left_out else ""
    return AnomalyResult(True, reason, contamination, used, forest, records)


def _spread(df: DataFrame) -> DataFrame:
    """Use all cores for scoring where the table comes in fewer pieces than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def with_percentile_rank(df: DataFrame, column: str, out: str, *, source: DataFrame | None = None,
                         settings: Settings = DEFAULT) -> DataFrame:
    """Add the average rank of a column as a percentage of the number of values."""
    table = df if source is None else source
    ranked = average_ranks(table, col(column))
    total = table.agg(F.count(col(column))).first()[0]
    lookup = ranked.select("value", "n", (F.col("rank") / F.lit(total) * 100).alias(out))
    return attach(df, column, lookup, out)


def anomaly_summary(result: AnomalyResult, spark) -> DataFrame:
    """One row: was it possible, rows scored, anomalies, rate, features, mean score."""
    schema = ("available boolean, reason string, contamination double, n_rows_scored bigint, n_anomalies bigint, "
              "anomaly_rate double, features_used array<string>, mean_score double")
    if not result.available:
        return spark.createDataFrame([(False, result.reason, result.contamination, 0, 0, 0.0, result.features, None)], schema)
    row = result.records.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("a"), F.avg("anomaly_score").alias("m"))
    return row.select(
        F.lit(True).alias("available"), F.lit(result.reason).alias("reason"),
        F.lit(result.contamination).alias("contamination"), F.col("n").alias("n_rows_scored"),
        F.col("a").alias("n_anomalies"), share(F.col("a"), F.col("n")).alias("anomaly_rate"),
        F.array(*[F.lit(f) for f in result.features]).alias("features_used"), F.col("m").alias("mean_score"))


def feature_deviations(records: DataFrame, features: Sequence[str], *, flag: str = "is_anomaly",
                       settings: Settings = DEFAULT, facts: dict[str, NumberFacts] | None = None) -> DataFrame:
    """Mean and largest absolute robust z-score of each feature among the flagged rows.

    Medians and deviations are those of all rows; ``facts`` may bring them from the unscored table.
    """
    schema = "feature string, mean_robust_z double, max_abs_robust_z double"
    facts = number_facts(records, features, settings=settings) if facts is None else facts
    values = {f.name: finite(f) for f in fields(records, features)}
    names = [n for n in features if facts[n].mad]
    if not names:
        return records.sparkSession.createDataFrame([], schema)
    z = [F.abs(settings.mad_scale * (values[n] - facts[n].quartiles[1]) / facts[n].mad) for n in names]
    row = records.where(col(flag)).agg(*[e for i in range(len(names)) for e in (
        F.avg(z[i]).alias(f"m{i}"), F.max(z[i]).alias(f"x{i}"))])
    return as_rows(row, [F.struct(F.lit(n).alias("feature"), F.col(f"m{i}").alias("mean_robust_z"),
                                  F.col(f"x{i}").alias("max_abs_robust_z")) for i, n in enumerate(names)]
                   ).where("mean_robust_z is not null").orderBy(F.desc("mean_robust_z"), "feature")


def anomaly_examples(records: DataFrame, limit: int | None = None, *, settings: Settings = DEFAULT) -> DataFrame:
    """The flagged rows with the lowest scores, of equal ones those of the smallest ids and values."""
    limit = settings.example_rows if limit is None else limit
    return records.where("is_anomaly").orderBy("anomaly_score", *[col(c) for c in groupable(records)]).limit(limit)


def score_distribution(records: DataFrame, bins: int = 40) -> DataFrame:
    """Histogram of the scores by label; scores lie between -1 and 0."""
    number = F.least(F.floor((F.col("anomaly_score") + 1) * bins), F.lit(bins - 1)).cast("int")
    return (records.groupBy(number.alias("bin"), "is_anomaly").agg(F.count("*").alias("n"))
            .select("bin", (F.col("bin") / bins - 1).alias("low"), ((F.col("bin") + 1) / bins - 1).alias("high"),
                    "is_anomaly", "n"))
