"""Health score: five weighted dimensions, each linear in a measured rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabscope import settings as S
from tabscope.functions.columns import clamp, percent_text, rescale, share
from tabscope.settings import DEFAULT, Settings

NOTES = (
    "Each dimension is a measured rate; nothing is learned or random.",
    "Leakage signals do not enter the score.",
    "A clean table is not for that reason a useful one.",
)


def linear_score(rate: Column, saturation: float) -> Column:
    """100 at rate 0, falling to 0 at the saturation rate."""
    return (1 - rescale(rate, F.lit(0.0), F.lit(saturation))) * 100.0


def health_inputs(missing: DataFrame, missing_by_column: DataFrame, duplicates: DataFrame, variance: DataFrame,
                  issues: DataFrame, outliers: DataFrame, numeric_cells: DataFrame, n_columns: int, *,
                  settings: Settings = DEFAULT) -> DataFrame:
    """One row with the measurements of all dimensions.

    ``numeric_cells`` has one column ``numeric_cells``: the finite numeric values of the table.
    """
    sparse = missing_by_column.agg(F.count_if(F.col("missing_rate") >= settings.missing_high).alias("sparse_columns"))
    low = variance.agg(F.count_if("is_constant").alias("constant_columns"),
                       F.count_if(F.col("is_near_constant") & ~F.col("is_constant")).alias("near_constant_columns"))
    kinds = issues.agg(F.count_distinct("column").alias("issue_columns"))
    iqr = outliers.where("method = 'iqr'").agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("iqr_cells"), F.count_if(F.col("count") > 0).alias("iqr_columns"))
    out = missing.select("missing_rate")  # every part is one row
    for part in (sparse, iqr, numeric_cells.select("numeric_cells"), kinds,
                 duplicates.select("duplicate_rate", "duplicate_rows"), low):
        out = out.crossJoin(F.broadcast(part))
    return out.withColumn("n_columns", F.lit(n_columns))


def health_components(inputs: DataFrame, *, settings: Settings = DEFAULT) -> DataFrame:
    """One row per dimension: score, weight, weighted score, measurement, reason of a deduction."""
    s, c = settings, F.col
    has_columns = c("n_columns") > 0
    sparse_penalty = c("sparse_columns") * 5.0
    iqr_rate = share(c("iqr_cells"), c("numeric_cells"))
    issue_rate = share(c("issue_columns"), c("n_columns"))
    flat = c("constant_columns") + c("near_constant_columns") * 0.5
    scores = {
        "completeness": clamp(linear_score(c("missing_rate"), s.completeness_saturation) - sparse_penalty, 0.0, 100.0),
        "integrity": F.when(c("numeric_cells") <= 0, F.lit(100.0)).otherwise(linear_score(iqr_rate, s.integrity_saturation)),
        "consistency": F.when(has_columns, (1 - clamp(issue_rate, 0.0, 1.0)) * 100.0).otherwise(100.0),
        "uniqueness": linear_score(c("duplicate_rate"), s.uniqueness_saturation),
        "variability": F.when(has_columns, (1 - clamp(share(flat, c("n_columns")), 0.0, 1.0)) * 100.0).otherwise(100.0),
    }
    measured = {
        "completeness": F.concat(percent_text(c("missing_rate"), 2), F.lit(" of all cells are missing")),
        "integrity": F.when(c("numeric_cells") <= 0, F.lit("no numeric cells")).otherwise(
            F.concat(percent_text(iqr_rate, 2), F.lit(" of numeric cells lie beyond the 1.5 IQR fences, in "),
                     c("iqr_columns").cast("string"), F.lit(" column(s)"))),
        "consistency": F.format_string("%d of %d column(s) hold content of another type", "issue_columns", "n_columns"),
        "uniqueness": F.concat(percent_text(c("duplicate_rate"), 2), F.lit(" of rows are exact duplicates")),
        "variability": F.format_string("%d constant and %d near-constant of %d column(s)", "constant_columns",
                                       "near_constant_columns", "n_columns"),
    }
    cause = {
        "completeness": F.when(c("sparse_columns") > 0, F.format_string(
            "%.0f points for %d column(s) that are half empty or more", sparse_penalty, c("sparse_columns"))),
        "integrity": F.when((c("numeric_cells") > 0) & (c("iqr_cells") > 0),
                            F.lit("extreme values, which need not be errors")),
        "consistency": F.when(c("issue_columns") > 0, F.lit("numbers, dates or mixtures kept as text")),
        "uniqueness": F.when(c("duplicate_rows") > 0, F.format_string("%,d duplicate row(s)", "duplicate_rows")),
        "variability": F.when(flat > 0, F.lit("columns that hardly change")),
    }
    return inputs.select(F.inline(F.array(*[F.struct(
        F.lit(i).alias("position"), F.lit(key).alias("key"), F.lit(key.capitalize()).alias("label"),
        F.round(scores[key], 1).alias("score"), F.lit(weight).alias("weight"),
        F.round(scores[key] * weight, 2).alias("weighted_score"), measured[key].alias("measurement"),
        F.coalesce(cause[key], F.lit("")).alias("penalty_reason"))
        for i, (key, weight) in enumerate(S.HEALTH_WEIGHTS.items())])))


def grade(score: Column) -> Column:
    out = F.lit(S.HEALTH_GRADES[-1][1])
    for edge, label in reversed(S.HEALTH_GRADES):
        out = F.when(score >= edge, F.lit(label)).otherwise(out)
    return out


def health_score(components: DataFrame) -> DataFrame:
    """One row: total score, grade, weakest and strongest dimension, notes."""
    total = F.round(clamp(F.sum("weighted_score"), 0.0, 100.0), 1)
    row = components.agg(
        total.alias("score"),
        F.min(F.struct("score", "position", "label")).alias("low"),
        F.max(F.struct("score", -F.col("position"), "label")).alias("high"))
    return row.select("score", grade(F.col("score")).alias("grade"), F.col("low.label").alias("weakest"),
                      F.col("high.label").alias("strongest"), F.array(*[F.lit(n) for n in NOTES]).alias("notes"),
                      verdict().alias("verdict"))


def verdict() -> Column:
    start = F.format_string("Score %.1f of 100: %s.", F.col("score"), grade(F.col("score")))
    more = F.format_string(" Best is %s (%.1f), worst is %s (%.1f).", F.lower("high.label"), F.col("high.score"),
                           F.lower("low.label"), F.col("low.score"))
    return F.when(F.col("high.label") != F.col("low.label"), F.concat(start, more)).otherwise(start)
