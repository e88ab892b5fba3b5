"""Contingency tables, chi-square tests and bias-corrected Cramer's V."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabscope.functions.columns import col, fields
from tabscope.functions.pvalues import chi_square_p_value
from tabscope.operators.categorical import categorical_columns
from tabscope.plans.counts import distinct_counts, value_counts
from tabscope.plans.stored import stored
from tabscope.settings import DEFAULT, Settings

ASSOCIATION_SCHEMA = ("column_a string, column_b string, cramers_v double, p_value double, "
                      "n_observations bigint, levels_a bigint, levels_b bigint, dof bigint")
SKIPPED_SCHEMA = "column string, n_unique bigint, available boolean, reason string"


def contingency(df: DataFrame, column_a: str, column_b: str) -> DataFrame:
    """(a, b, n) for the rows where both columns have a value."""
    return (df.select(col(column_a).alias("a"), col(column_b).alias("b"))
            .where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("n")))


def association_levels(df: DataFrame, columns: Sequence[str] | None = None, *, settings: Settings = DEFAULT,
                       counts: DataFrame | None = None) -> DataFrame:
    """(column, n_unique, available, reason) of every categorical column.

    Available are those of 2 to ``association_levels`` levels; without that limit, all of two levels or more that stand
    twice on average, since of nearly distinct values a contingency table says nothing.
    """
    names = [f.name for f in fields(df, columns)] if columns else categorical_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], SKIPPED_SCHEMA)
    counts = value_counts(df, names) if counts is None else counts.where(F.col("column").isin(names))
    every = df.sparkSession.createDataFrame([(n,) for n in names], "column string")
    n = F.coalesce("n_unique", F.lit(0)).cast("bigint")
    most = settings.association_levels
    many = F.when(2 * n > F.col("n_present"), F.lit("nearly distinct values")) if most is None else F.when(n > most, F.lit(f"more than {most} levels"))
    reason = F.when(n < 2, "fewer than two levels").otherwise(F.coalesce(many, F.lit("")))
    return every.join(distinct_counts(counts), "column", "left").select(
        "column", n.alias("n_unique"), (reason == "").alias("available"), reason.alias("reason"))


def association_columns(df: DataFrame, columns: Sequence[str] | None = None, *, settings: Settings = DEFAULT,
                        counts: DataFrame | None = None) -> dict[str, int]:
    """All available categorical columns (see ``association_levels``), in the order of the table, with their level counts."""
    found = association_levels(df, columns, settings=settings, counts=counts).where("available").collect()
    levels = {r["column"]: r["n_unique"] for r in found}
    return {f.name: levels[f.name] for f in fields(df, columns) if f.name in levels}


#: Columns of up to this many levels are counted in dense arrays of pairs of levels, others by their cells.
DENSE_LEVELS = 64


def pair_tables(df: DataFrame, levels: dict[str, int]) -> DataFrame:
    """(pair, a, b, n): the contingency tables of all column pairs, stored.

    Columns of few levels are counted by one scan, each task adding up an array for each pair.  Pairs with a column of
    many levels are counted by their cells, which are added up before and after one shuffle.
    """
    names = list(levels)
    rows = df.select(*[col(n).cast("string").alias(f"c{i}") for i, n in enumerate(names)])
    pairs = list(enumerate(combinations(range(len(names)), 2)))
    small = {i for i, n in enumerate(names) if levels[n] <= DENSE_LEVELS}
    dense = [(p, i, j) for p, (i, j) in pairs if i in small and j in small]
    sparse = [(p, i, j) for p, (i, j) in pairs if not (i in small and j in small)]
    parts = [dense_tables(rows, dense)] if dense else []
    if sparse:
        cells = F.array(*[
            F.when(F.col(f"c{i}").isNotNull() & F.col(f"c{j}").isNotNull(),
                   F.struct(F.lit(p).alias("pair"), F.col(f"c{i}").alias("a"), F.col(f"c{j}").alias("b"))) for p, i, j in sparse])
        parts.append(rows.select(F.explode(cells).alias("cell")).where("cell is not null")
                     .groupBy("cell.pair", "cell.a", "cell.b").agg(F.count("*").alias("n")))
    return stored(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "pair-tables")


def dense_tables(rows: DataFrame, pairs: Sequence[tuple[int, int, int]]) -> DataFrame:
    """(pair, a, b, n) of pairs of the columns c<i>; pairs: (number, i, j)."""
    used = sorted({i for _, *both in pairs for i in both})
    at = {i: k for k, i in enumerate(used)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[dict[str, int]] = [{} for _ in used]
        tables = {p: np.zeros((0, 0), np.int64) for p, _, _ in pairs}
        for batch in batches:
            codes = []
            for k, own in enumerate(known):
                encoded = batch.column(k).dictionary_encode()
                code = np.array([own.setdefault(level, len(own)) for level in encoded.dictionary.to_pylist()] + [-1], np.int64)
                codes.append(code[encoded.indices.fill_null(len(code) - 1).to_numpy(zero_copy_only=False)])
            for p, i, j in pairs:
                a, b = codes[at[i]], codes[at[j]]
                both = (a >= 0) & (b >= 0)
                shape = (len(known[at[i]]), len(known[at[j]]))
                own = np.bincount(a[both] * shape[1] + b[both], minlength=shape[0] * shape[1]).reshape(shape)
                before = tables[p]
                own[:before.shape[0], :before.shape[1]] += before
                tables[p] = own
        level = [np.array([*own, None], object) for own in known]
        for p, i, j in pairs:
            a, b = np.nonzero(tables[p])
            if len(a):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(a), p, np.int32)), pa.array(level[at[i]][a], pa.string()), pa.array(level[at[j]][b], pa.string()),
                    pa.array(tables[p][a, b])], names=["pair", "a", "b", "n"])

    partial = rows.select(*[f"c{i}" for i in used]).mapInArrow(run, "pair int, a string, b string, n bigint")
    return partial.groupBy("pair", "a", "b").agg(F.sum("n").alias("n"))


def chi_square(tables: DataFrame) -> DataFrame:
    """(pair, n, levels_a, levels_b, chi2, dof) without continuity correction, from stored tables."""
    cells = tables.select("pair", "a", "b", F.col("n").cast("double").alias("o"))
    for key, total in (("a", "ra"), ("b", "cb")):
        margin = cells.groupBy("pair", key).agg(F.sum("o").alias(total)).select(
            F.col("pair").alias("of_pair"), F.col(key).alias("of"), total)
        cells = cells.join(margin, (F.col("pair") == F.col("of_pair")) & (F.col(key) == F.col("of"))).drop("of_pair", "of")
    per_pair = cells.groupBy("pair").agg(
        F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("cb"))).alias("t"),
        F.sum(F.col("o") / F.col("ra")).alias("levels_a"), F.sum(F.col("o") / F.col("cb")).alias("levels_b"))
    # the shares of a level's row add up to one, so their sum counts levels
    levels = [F.round(c).cast("long").alias(c) for c in ("levels_a", "levels_b")]
    return (per_pair.select("pair", F.col("n").cast("long").alias("n"), *levels, "t")
            .select("pair", "n", "levels_a", "levels_b",
                    F.greatest(F.col("n") * (F.col("t") - 1), F.lit(0.0)).alias("chi2"),
                    ((F.col("levels_a") - 1) * (F.col("levels_b") - 1)).alias("dof")))


def cramers_v(tests: DataFrame) -> DataFrame:
    """Add ``cramers_v`` (bias-corrected, 0 where undefined) and ``p_value``."""
    n, r, k = F.col("n").cast("double"), F.col("levels_a").cast("double"), F.col("levels_b").cast("double")
    free = F.greatest(n - 1, F.lit(1.0))
    phi2 = F.greatest(F.lit(0.0), F.col("chi2") / n - (k - 1) * (r - 1) / free)
    room = F.least(k - (k - 1) * (k - 1) / free, r - (r - 1) * (r - 1) / free) - 1
    usable = (r >= 2) & (k >= 2) & (room > 0)
    return tests.withColumn("cramers_v", F.when(usable, F.sqrt(phi2 / room)).otherwise(0.0)).withColumn(
        "p_value", F.when((r >= 2) & (k >= 2), chi_square_p_value("chi2", "dof")).otherwise(1.0))


def associations(df: DataFrame, columns: Sequence[str] | None = None, *, settings: Settings = DEFAULT,
                 counts: DataFrame | None = None) -> DataFrame:
    """Cramer's V of every pair of suitable categorical columns, strongest first."""
    levels = association_columns(df, columns, settings=settings, counts=counts)
    if len(levels) < 2:
        return df.sparkSession.createDataFrame([], ASSOCIATION_SCHEMA)
    names = list(levels)
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in combinations(names, 2)])
    label = F.element_at(pairs, F.col("pair") + 1)
    tests = cramers_v(chi_square(pair_tables(df, levels)))
    degenerate = (F.col("levels_a") < 2) | (F.col("levels_b") < 2)
    return (tests.where(F.col("n") >= settings.min_pair_rows)
            .select(label["a"].alias("column_a"), label["b"].alias("column_b"),
                    F.round("cramers_v", 4).alias("cramers_v"), "p_value", F.col("n").alias("n_observations"),
                    "levels_a", "levels_b", F.when(degenerate, F.lit(0)).otherwise(F.col("dof")).cast("long").alias("dof"),
                    F.col("pair").alias("position"))
            .orderBy(F.desc("cramers_v"), "position").drop("position"))


def chi_square_test(df: DataFrame, column_a: str, column_b: str) -> DataFrame:
    """One row: statistic, degrees of freedom, p-value and Cramer's V of two columns."""
    table = stored(contingency(df, column_a, column_b).withColumn("pair", F.lit(0)), "contingency")
    return cramers_v(chi_square(table)).select(
        F.lit(column_a).alias("column_a"), F.lit(column_b).alias("column_b"), "chi2", "dof", "p_value",
        "cramers_v", F.col("n").alias("n_observations"), "levels_a", "levels_b")
