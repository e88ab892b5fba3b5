"""The long table of value counts: one scan and one pre-aggregated shuffle for all columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabscope.functions.columns import COUNT_FIELDS, FLOAT_FIELDS, col, fields, present, stored_kind


def value_text() -> Column:
    """The counted value as text, whichever typed field holds it."""
    return F.coalesce(F.col("number").cast("string"), F.col("real").cast("string"), F.col("text"))


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(position, column, number, real, text, value, n): one row per distinct present value.

    Integers, floating numbers and everything else travel in typed fields, so no number is
    turned into text for the shuffle.  Columns are labelled by position until after it.
    """
    wanted = [f for f in fields(df, columns) if countable(f.dataType)]
    if not wanted:
        return df.sparkSession.createDataFrame([], _SCHEMA)
    packed = []
    for i, f in enumerate(wanted):
        c, kind = col(f.name), f.dataType
        null = F.lit(None)
        is_count, is_real = isinstance(kind, COUNT_FIELDS), isinstance(kind, FLOAT_FIELDS)
        # + 0.0 makes one value of the two zeros
        packed.append(F.when(present(f), F.struct(
            (c if is_count else null).cast("long").alias("number"),
            (c + F.lit(0.0) if is_real else null).cast("double").alias("real"),
            (null if is_count or is_real else c).cast("string").alias("text"),
        )).alias(str(i)))
    long = df.select(*packed).unpivot([], [str(i) for i in range(len(wanted))], "position", "cell")
    counted = (long.where("cell is not null")
               .groupBy("position", "cell.number", "cell.real", "cell.text")
               .agg(F.count("*").alias("n")))
    position = F.col("position").cast("int")
    names = F.array(*[F.lit(f.name) for f in wanted])
    return counted.select(
        position.alias("position"), F.element_at(names, position + 1).alias("column"),
        "number", "real", "text", value_text().alias("value"), "n")


_SCHEMA = ("position int, column string, number bigint, real double, text string, "
           "value string, n bigint")


def countable(dtype: T.DataType) -> bool:
    """Are the values of this type counted? Nested values are not."""
    return stored_kind(dtype) != "other" or isinstance(dtype, (T.BinaryType, T.DayTimeIntervalType))


def distinct_counts(counts: DataFrame) -> DataFrame:
    """(column, n_present, n_unique) from value counts."""
    return counts.groupBy("column").agg(
        F.sum("n").alias("n_present"), F.count("*").alias("n_unique"))
