"""Running totals and ranks over sorted distinct values.

A window over a whole column would move every row to one task.  Here rows are first reduced to distinct values, so no
value is hot; the values of all columns together are range-partitioned, the range number is stored with the row, and
totals inside a range are shifted by the totals of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabscope.functions.columns import col
from tabscope.plans.stored import stored


def grouped_totals(distinct: DataFrame, group: Sequence[str], value: str, totals: Sequence[str]) -> DataFrame:
    """Add ``upto_<t>`` for each column t: its sum over all rows of the group with a value up to this one.

    (group, value) must be unique and not null.  All groups share one range partitioning, so a group of any size is spread
    over tasks and small groups share them.
    """
    group = list(group)
    placed = stored(distinct.repartitionByRange(*group, value).withColumn("range_no", F.spark_partition_id()), "ranges")
    per_range = placed.groupBy("range_no", *group).agg(*[F.sum(t).alias(t) for t in totals])
    before = Window.partitionBy(*group).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    shift = per_range.select("range_no", *group, *[
        F.coalesce(F.sum(t).over(before), F.lit(0)).alias(f"shift_{t}") for t in totals])
    inside = Window.partitionBy("range_no", *group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    # groups are contiguous, so there are no more rows than ranges and groups together
    return (placed.join(F.broadcast(shift), ["range_no", *group])
            .select(*distinct.columns, *[
                (F.sum(t).over(inside) + F.col(f"shift_{t}")).alias(f"upto_{t}") for t in totals]))


def long_counts(df: DataFrame, columns: Sequence[str], *extra: Column) -> DataFrame:
    """(feature, value, n) of all columns from one scan, ``feature`` being the column's place, with more aggregates if given."""
    each = F.array(*[F.struct(F.lit(i).alias("feature"), col(c).cast("double").alias("value")) for i, c in enumerate(columns)])
    rows = df.select("*", F.explode(each).alias("__each")).where("__each.value is not null")
    return rows.groupBy(F.col("__each.feature").alias("feature"), F.col("__each.value").alias("value")).agg(F.count("*").alias("n"), *extra)


def column_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, n, rank): average ranks of the distinct values of all columns, stored in a folder for each."""
    ranked = grouped_totals(long_counts(df, columns), ["feature"], "value", ["n"])
    return stored(ranked.select("feature", "value", "n", (F.col("upto_n") - (F.col("n") - 1) / 2).alias("rank")), "ranks", by="feature")


def average_ranks(df: DataFrame, value: Column) -> DataFrame:
    """(value, n, rank) per distinct non-null value, stored, so that its size is known to Spark."""
    counts = df.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    ranked = grouped_totals(counts, [], "value", ["n"])
    return stored(ranked.select("value", "n", (F.col("upto_n") - (F.col("n") - 1) / 2).alias("rank")), "ranks")


def attach(df: DataFrame, key: str, lookup: DataFrame, out: str) -> DataFrame:
    """Add ``out`` from lookup(value, n, <out>) where value equals ``key``; NULL keys get NULL.

    A stored lookup that Spark finds small is broadcast.  A large one is joined by shuffle; values that hold many
    rows are hot on the left side only, whose partitions adaptive execution splits.
    """
    small = lookup.select(F.col("value").alias("__value"), F.col(out))
    return df.join(small, col(key) == F.col("__value"), "left").drop("__value")


def with_ranks(df: DataFrame, source: DataFrame, ranks: dict[str, str]) -> DataFrame:
    """Add the average rank of each column in ``ranks`` (column: name of the rank) among the rows of ``source``.

    All columns are ranked together; each rank is looked up by one join with the column's own part of the stored table,
    so the plan grows by one join and one scan per column.
    """
    table = column_ranks(source, list(ranks))
    for feature, (column, out) in enumerate(ranks.items()):
        df = attach(df, column, table.where(F.col("feature") == feature).withColumnRenamed("rank", out), out)
    return df


def with_rank(df: DataFrame, value: Column, out: str) -> DataFrame:
    """Add the average rank of ``value`` among all rows of ``df`` (NULL for NULL)."""
    key = f"__{out}_key"
    ranks = average_ranks(df, value).withColumnRenamed("rank", out)
    return attach(df.withColumn(key, value), key, ranks, out).drop(key)
