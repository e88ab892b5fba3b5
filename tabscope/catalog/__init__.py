"""Named queries over the benchmark tables, each with the same question in plain SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabscope.functions.columns import col

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Doubles rounded, whole numbers as bigint: what two engines can be held to agree on."""
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = (F.round(c.cast("double"), special.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint").alias(f.name)
        out.append(c)
    return df.select(*out)


def rnd(expression: str, digits: int = 6) -> str:
    """SQL counterpart of rounded; adding zero removes a negative zero."""
    return f"(round(({expression})::DOUBLE, {digits}) + 0.0)"


def union_all(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def sql_list(values) -> str:
    """Texts of ``settings`` as the inside of an SQL list."""
    return ", ".join(f"'{v}'" for v in values)


def load() -> None:
    """Import the modules that register queries."""
    from tabscope.catalog import (  # noqa: F401
        cleaning_queries, distribution_queries, leakage_queries, outlier_queries, proof_queries, quality_queries, relation_queries,
        report_queries, text_queries,
    )
