"""Categorical columns: cardinality, dominance, rarity, entropy, frequency tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tabscope.functions.columns import col, fields, share, stored_kind
from tabscope.plans.counts import value_counts
from tabscope.settings import DEFAULT, Settings


def categorical_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    return [f.name for f in fields(df, columns) if stored_kind(f.dataType) in ("text", "boolean")]


def categorical_stats(df: DataFrame, columns: Sequence[str] | None = None, *, settings: Settings = DEFAULT,
                      counts: DataFrame | None = None) -> DataFrame:
    """One row per text or boolean column.

    Everything is an algebraic aggregate over value counts, so a column with very many
    levels is reduced map-side; ties for top and second go to the smaller value.
    """
    s = settings
    names = [f.name for f in fields(df, columns)] if columns else categorical_columns(df)
    counts = value_counts(df, names) if counts is None else counts.where(F.col("column").isin(names))
    per_column = counts.groupBy("column").agg(F.sum("n").alias("count"))
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    # totals per column are a table of #columns rows
    shared = counts.join(F.broadcast(per_column), "column")
    p = F.col("n") / F.col("count")
    pick = F.struct(-F.col("n"), F.col("value"))
    levels = shared.groupBy("column").agg(
        F.count("*").alias("n_unique"), F.min(pick).alias("top"),
        F.sum(-p * F.log2(p)).alias("bits"), F.count_if(p < s.rare_share).alias("rare_categories"))
    second = (counts.join(F.broadcast(levels.select("column", "top")), "column")
              .where(pick > F.col("top")).groupBy("column").agg(F.min(pick).alias("second")))
    listed = df.sparkSession.createDataFrame(list(enumerate(names)), "position int, column string")
    n = F.coalesce("count", F.lit(0)).cast("long")
    top_n, second_n = -F.col("top.col1"), -F.col("second.col1")
    joined = (listed.crossJoin(F.broadcast(rows)).join(per_column, "column", "left")
              .join(levels, "column", "left").join(second, "column", "left")
              .withColumn("n_unique", F.coalesce("n_unique", F.lit(0)).cast("long"))
              .withColumn("unique_ratio", share(F.col("n_unique"), n))
              .withColumn("top_rate", share(top_n, n)))
    return joined.select(
        "position", "column", n.alias("count"), (F.col("rows") - n).alias("missing"), "n_unique",
        "unique_ratio", F.col("top.value").alias("top_value"),
        F.coalesce(top_n, F.lit(0)).cast("long").alias("top_count"), "top_rate",
        F.col("second.value").alias("second_value"), share(second_n, n).alias("second_rate"),
        F.coalesce("rare_categories", F.lit(0)).cast("long").alias("rare_categories"),
        F.when(F.col("n_unique") > 1, F.col("bits")).when(n > 0, F.lit(0.0)).alias("entropy"),
        (F.col("top_rate") >= s.dominant_share).alias("is_dominant"),
        ((n > 0) & ((F.col("n_unique") >= s.high_cardinality)
                    | (F.col("unique_ratio") >= s.high_cardinality_ratio))).alias("is_high_cardinality"))


def rare_heavy_columns(stats: DataFrame) -> DataFrame:
    """Columns of a categorical_stats table with at least 5 rare levels, or 30 % if more."""
    return stats.where(F.col("rare_categories") >= F.greatest(F.lit(5.0), F.col("n_unique") * 0.3)).select(
        "position", "column", "rare_categories", "n_unique")


def frequency_table(df: DataFrame, column: str, top_n: int = 20) -> DataFrame:
    """The most frequent values with their percentage, then one row for all others."""
    counts = value_counts(df, [column]).select("value", F.col("n").alias("count"))
    top = counts.orderBy(F.desc("count"), "value").limit(top_n)
    total = counts.agg(F.sum("count").alias("total"), F.count("*").alias("levels"))
    ranked = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("count"), "value")))
    rest = (total.crossJoin(top.agg(F.sum("count").alias("shown")))
            .where("total > shown")
            .select(F.format_string("(other %d categories)", F.col("levels") - top_n).alias("value"),
                    (F.col("total") - F.col("shown")).alias("count"),
                    F.lit(top_n + 1).alias("position")))
    return (ranked.unionByName(rest).crossJoin(F.broadcast(total))
            .select("position", "value", "count", F.round(F.col("count") * 100 / F.col("total"), 3).alias("percent"))
            .orderBy("position"))
