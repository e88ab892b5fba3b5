"""Missing values, duplicate rows, low-variance columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tabscope.functions.columns import (
    col, fields, groupable, in_passes, missing_band, percent_text, present, share, stored_kind,
)
from tabscope.plans.counts import countable, value_counts
from tabscope.plans.stored import stored
from tabscope.settings import DEFAULT, Settings


def missing_columns(df: DataFrame, columns: Sequence[str] | None = None, *,
                    settings: Settings = DEFAULT, affected_only: bool = True) -> DataFrame:
    """Missing count and rate per column with its severity, worst first."""
    wanted = fields(df, columns)

    def build(i, item):
        position, f = item
        rate = share(F.col(f"m{i}"), F.col(f"r{i}"))
        return [F.count(F.lit(1)).alias(f"r{i}"), F.count_if(~present(f)).alias(f"m{i}")], F.struct(
            F.lit(position).alias("position"), F.lit(f.name).alias("column"), F.col(f"m{i}").alias("missing"),
            rate.alias("missing_rate"), F.lit(f.dataType.simpleString()).alias("dtype"),
            missing_band(rate, settings).alias("severity"))

    out = in_passes(df, list(enumerate(wanted)), 2, build, settings.fields_per_pass)
    if affected_only:
        out = out.where("missing > 0")
    return out.orderBy(F.desc("missing_rate"), "position")


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row of table-wide missing-value totals."""
    wanted = fields(df, columns)
    missing = [~present(f) for f in wanted]
    any_missing = reduce(lambda a, b: a | b, missing, F.lit(False))
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(any_missing).alias("bad"),
                 *[F.count_if(m).alias(f"m{i}") for i, m in enumerate(missing)])
    cells = F.col("rows") * len(wanted)
    total = sum((F.col(f"m{i}") for i in range(len(wanted))), F.lit(0))
    affected = sum(((F.col(f"m{i}") > 0).cast("long") for i in range(len(wanted))), F.lit(0))
    return row.select(
        cells.alias("total_cells"), total.cast("long").alias("missing_cells"),
        share(total, cells).alias("missing_rate"), (F.col("rows") - F.col("bad")).alias("complete_rows"),
        F.col("bad").alias("rows_with_missing"), affected.cast("long").alias("columns_with_missing"),
        share(F.col("rows") - F.col("bad"), F.col("rows")).alias("complete_row_rate"))


def duplicate_groups(df: DataFrame, subset: Sequence[str] | None = None, *,
                     settings: Settings = DEFAULT) -> DataFrame:
    """Keys that occur more than once, with their number of rows (column ``copies``).

    Wide or text keys are not shuffled whole: rows are first counted by a 64-bit hash, and
    only rows whose hash repeats are grouped by the real keys, so the answer stays exact.
    """
    wanted = fields(df, subset or groupable(df))
    cols = [col(f.name) for f in wanted]
    rows = df.select(*cols)
    width = sum(64 if stored_kind(f.dataType) in ("text", "other") else 8 for f in wanted)
    if width > 48:
        hashed = rows.withColumn("__hash", F.xxhash64(*cols))
        # stored, so that Spark knows the size: few hashes are broadcast, many joined by a shuffle whose hot keys
        # lie on the left side only, where adaptive execution splits them
        repeated = stored(hashed.groupBy("__hash").agg(F.count("*").alias("__n")).where("__n > 1").select("__hash"), "repeated")
        rows = hashed.join(repeated, "__hash", "left_semi").drop("__hash")
    return rows.groupBy(*cols).agg(F.count("*").alias("copies")).where("copies > 1")


def duplicate_summary(df: DataFrame, subset: Sequence[str] | None = None, *,
                      settings: Settings = DEFAULT) -> DataFrame:
    """One row: rows, duplicate rows (copies beyond the first), rate, groups, distinct rows."""
    groups = duplicate_groups(df, subset, settings=settings).agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"),
        F.count("*").alias("duplicate_group_count"))
    total = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return total.crossJoin(F.broadcast(groups)).select(
        "total_rows", "duplicate_rows",
        share(F.col("duplicate_rows"), F.col("total_rows")).alias("duplicate_rate"),
        "duplicate_group_count", (F.col("total_rows") - F.col("duplicate_rows")).alias("unique_rows"))


def duplicate_examples(df: DataFrame, subset: Sequence[str] | None = None, *, limit: int | None = None,
                       settings: Settings = DEFAULT) -> DataFrame:
    """The first rows, in key order, that belong to a duplicate group."""
    keys = [f.name for f in fields(df, subset)] if subset else groupable(df)
    limit = settings.example_rows if limit is None else limit
    # each group has two rows or more, so the first `limit` groups hold the first `limit` rows
    first = duplicate_groups(df, subset, settings=settings).orderBy(*[col(k) for k in keys]).limit(limit)
    match = reduce(lambda a, b: a & b, [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys])
    members = df.alias("l").join(F.broadcast(first.alias("r")), match, "left_semi")
    rest = [c for c in df.columns if c not in keys and c in groupable(df)]
    return members.orderBy(*[col(k) for k in [*keys, *rest]]).limit(limit)


def low_variance(df: DataFrame, columns: Sequence[str] | None = None, *, settings: Settings = DEFAULT,
                 counts: DataFrame | None = None) -> DataFrame:
    """Constant and near-constant columns; an empty column counts as constant, nested ones are left out."""
    wanted = [f for f in fields(df, columns) if countable(f.dataType)]
    counts = value_counts(df, [f.name for f in wanted]) if counts is None else counts
    per_column = counts.groupBy("column").agg(
        F.count("*").alias("n_unique"), F.sum("n").alias("present"), F.max("n").alias("top_n"),
        # the most frequent value, the smallest of those that tie
        F.min_by("value", F.struct(-F.col("n"), F.col("number"), F.col("real"), F.col("text"))).alias("dominant_value"))
    listed = df.sparkSession.createDataFrame(
        [(i, f.name) for i, f in enumerate(wanted)], "position int, column string")
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    joined = listed.crossJoin(F.broadcast(rows)).where("rows > 0").join(per_column, "column", "left")
    dominance = F.when(F.col("present").isNull(), F.lit(1.0)).otherwise(share(F.col("top_n"), F.col("present")))
    distinct = F.coalesce("n_unique", F.lit(0)).cast("long")
    missing_rate = 1 - share(F.coalesce("present", F.lit(0)), F.col("rows"))
    constant = distinct <= 1
    near = (distinct == 0) | ((distinct > 1) & (dominance >= settings.near_constant_share))
    main = (F.when(distinct == 0, F.lit("The column holds no value at all."))
            .when(constant, F.lit("All values present are the same."))
            .otherwise(F.concat(percent_text(F.col("dominant_rate")), F.lit(" of the values present are '"),
                                F.col("dominant_value"), F.lit("'; the others are too few to learn from."))))
    sparse = F.when((distinct > 0) & (missing_rate >= settings.missing_high),
                    F.concat(F.lit(" Besides, "), percent_text(missing_rate), F.lit(" of the column is missing.")))
    return (joined.withColumn("dominant_rate", dominance)
            .select("position", "column", distinct.alias("n_unique"), "dominant_value", "dominant_rate",
                    constant.alias("is_constant"), near.alias("is_near_constant"),
                    F.concat(main, F.coalesce(sparse, F.lit(""))).alias("note"))
            .where("is_constant or is_near_constant")
            .orderBy(F.desc("is_constant"), F.desc("dominant_rate"), "position"))


def missing_map(df: DataFrame, columns: Sequence[str] | None = None, *, id_columns: Sequence[str] = (),
                rows: int | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """0/1 flags of missing cells for a seeded sample of rows.

    Rows are drawn by the md5 of the seed and their ids (or all their values), not by position: those of the smallest
    digests, and of equal ones the smallest values, so that repeated rows are drawn as often as they are smallest.
    """
    rows = settings.map_rows if rows is None else rows
    wanted = fields(df, columns)
    keys = [col(c) for c in (id_columns or groupable(df))]
    text = F.concat_ws("|", F.lit(str(settings.seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    # a bounded heap per task
    picked = df.withColumn("__pick", F.md5(text.cast("binary"))).orderBy("__pick", *keys).limit(rows)
    return picked.select(*[col(c) for c in id_columns],
                         *[(~present(f)).cast("int").alias(f"missing_{f.name}") for f in wanted])
