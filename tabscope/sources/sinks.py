"""Writing cleaned tables and result tables; fingerprint and preview."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F, types as T

from tabscope.functions.columns import FLOAT_FIELDS, col, groupable


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def finite_only(df: DataFrame) -> DataFrame:
    """NaN and infinities as NULL, as exported tables have no other way to say them."""
    return df.select(*[
        F.when(F.abs(col(f.name)) < float("inf"), col(f.name)).alias(f.name)
        if isinstance(f.dataType, FLOAT_FIELDS) else col(f.name) for f in df.schema.fields])


def write_tables(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """One folder per result table; ``fmt`` is parquet or json."""
    for name, table in tables.items():
        finite_only(table).write.mode(mode).format(fmt).save(f"{path}/{name}")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that identifies the content whatever the row order: rows, sum of row digests, digest."""
    row = F.concat_ws("\u001f", *[F.coalesce(col(n).cast("string"), F.lit("\u0000")) for n in groupable(df)])
    # the first 60 bits of each row's md5
    h = F.conv(F.substr(F.md5(row.cast("binary")), F.lit(1), F.lit(15)), 16, 10).cast("decimal(38,0)")
    schema = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    found = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("hash_sum"))
    return found.select("n_rows", "hash_sum", F.substr(F.sha2(F.concat_ws(
        "|", F.lit(schema), F.col("n_rows").cast("string"), F.col("hash_sum")), 256), F.lit(1), F.lit(16)).alias("fingerprint"))


def preview(df: DataFrame, rows: int) -> DataFrame:
    return df.limit(rows)
