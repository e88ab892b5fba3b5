"""Column roles, stored-type problems, column profile and overview."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabscope import settings as S
from tabscope.functions.columns import (
    bytes_text, col, count_text, date_hinted, fields, finite, in_passes, name_tokens, of_kind,
    parse_date, parse_number, plain_number, present, share, stored_kind, whole_numbers, words,
)
from tabscope.plans.counts import countable, distinct_counts, value_counts
from tabscope.settings import DEFAULT, Settings

ROLE_SCHEMA = "position int, column string, spark_type string, role string, text_like boolean"


def text_probe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per text column: how many values read as numbers, dates or yes/no words."""
    names = of_kind(df, "text", columns)
    if not names:
        return df.sparkSession.createDataFrame([], _PROBE_SCHEMA)
    def build(i, name):
        c = col(name)
        return [
            F.count(c).alias(f"n{i}"), F.count(parse_number(c)).alias(f"num{i}"), F.count(plain_number(c)).alias(f"plain{i}"),
            F.count_if(date_hinted(c)).alias(f"hint{i}"), F.count(parse_date(c)).alias(f"date{i}"),
            F.count_if(F.lower(c).isin(*S.BOOLEAN_WORDS)).alias(f"bool{i}"),
        ], F.struct(
            F.lit(name).alias("column"), F.col(f"n{i}").alias("n_present"),
            F.col(f"num{i}").alias("n_number"), F.col(f"plain{i}").alias("n_plain_number"),
            F.col(f"hint{i}").alias("n_date_hint"), F.col(f"date{i}").alias("n_date"),
            F.col(f"bool{i}").alias("n_boolean_word"))

    return in_passes(df, names, 6, build, DEFAULT.fields_per_pass)


_PROBE_SCHEMA = ("column string, n_present bigint, n_number bigint, n_plain_number bigint, "
                 "n_date_hint bigint, n_date bigint, n_boolean_word bigint")


def value_facts(counts: DataFrame, texts: Sequence[str]) -> DataFrame:
    """(column, n_unique, and the fields of ``text_probe``) from value counts: one row per column with a value.

    Each distinct text of the columns ``texts`` is read once, others not at all.
    """
    n, text = F.col("n"), F.col("text")
    each = counts.select("column", "n", F.when(F.col("column").isin(*texts), text).alias("text")).select("*", date_hinted(text).alias("hinted"))
    times = lambda is_so: F.coalesce(F.sum(F.when(is_so, n)), F.lit(0))
    return each.groupBy("column").agg(
        F.count("*").alias("n_unique"), F.sum("n").alias("n_present"), times(parse_number(text).isNotNull()).alias("n_number"),
        times(plain_number(text).isNotNull()).alias("n_plain_number"), times(F.col("hinted")).alias("n_date_hint"),
        times(parse_date(text, F.col("hinted")).isNotNull()).alias("n_date"), times(F.lower(text).isin(*S.BOOLEAN_WORDS)).alias("n_boolean_word"))


def is_number_text(s: Settings = DEFAULT):
    return share(F.col("n_number"), F.col("n_present")) >= s.number_text_share


def is_date_text(s: Settings = DEFAULT):
    return (~is_number_text(s) & (share(F.col("n_date_hint"), F.col("n_present")) >= s.date_hint_share)
            & (share(F.col("n_date"), F.col("n_present")) >= s.date_text_share))


def column_roles(df: DataFrame, columns: Sequence[str] | None = None, *, settings: Settings = DEFAULT,
                 probe: DataFrame | None = None, distinct: DataFrame | None = None) -> DataFrame:
    """Role of every column: numeric, categorical, text-like, datetime, boolean, empty or other."""
    spark, s = df.sparkSession, settings
    listed = [(i, f.name, f.dataType.simpleString(), stored_kind(f.dataType))
              for i, f in enumerate(fields(df, columns))]
    stored = spark.createDataFrame(listed, "position int, column string, spark_type string, kind string")
    names = of_kind(df, "text", columns)
    probe = text_probe(df, names) if probe is None else probe
    distinct = distinct_counts(value_counts(df, names)) if distinct is None else distinct
    n, d = F.col("n_present"), F.col("n_unique")
    ratio = share(d, n)
    text_role = (F.when(F.coalesce(n, F.lit(0)) == 0, F.lit("empty"))
                 .when(is_date_text(s), F.lit("datetime"))
                 .when(is_number_text(s) & (ratio > s.text_like_ratio), F.lit("text-like"))
                 .when(share(F.col("n_boolean_word"), n) > s.boolean_text_share, F.lit("categorical"))
                 .when((ratio > s.text_like_ratio) & (d > s.text_like_distinct), F.lit("text-like"))
                 .otherwise(F.lit("categorical")))
    return (stored.join(probe, "column", "left").join(distinct.drop("n_present"), "column", "left")
            .withColumn("role", F.when(F.col("kind") == "text", text_role).otherwise(F.col("kind")))
            .select("position", "column", "spark_type", "role",
                    (F.col("role") == "text-like").alias("text_like")))


def name_words(roles: DataFrame) -> DataFrame:
    """(column, words): lower-case words of each column name."""
    return roles.select("column", name_tokens(F.col("column")).alias("words"))


def dtype_issues(df: DataFrame, columns: Sequence[str] | None = None, *, settings: Settings = DEFAULT,
                 probe: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Text columns whose content is of another type.

    Date text is reported for text columns recognised as dates.  Examples are the smallest
    distinct values (three; five for mixed columns), so they do not depend on row order.
    """
    s = settings
    names = of_kind(df, "text", columns)
    probe = text_probe(df, names) if probe is None else probe
    n = F.col("n_present")
    mixed = share(F.col("n_plain_number"), n)
    judged = (probe.where(n > 0)
              .withColumn("issue", F.when(is_number_text(s), F.lit("numeric_stored_as_text"))
                          .when(is_date_text(s), F.lit("datetime_stored_as_text"))
                          .when((mixed > s.mixed_low) & (mixed < s.mixed_high), F.lit("mixed_types")))
              .where("issue is not null"))
    rate = (F.when(F.col("issue") == "numeric_stored_as_text", share(F.col("n_number"), n))
            .when(F.col("issue") == "datetime_stored_as_text", share(F.col("n_date"), n))
            .otherwise(mixed))
    flagged = judged.select("column", "issue", rate.alias("affected_rate")).collect()  # <= #columns rows
    spark = df.sparkSession
    issues = spark.createDataFrame([tuple(r) for r in flagged],
                                   "column string, issue string, affected_rate double")
    if not flagged:
        return issues.select("column", "issue", F.lit("string").alias("stored_dtype"),
                             F.lit("").alias("suggested_dtype"), F.lit("").alias("detail"),
                             "affected_rate", F.array(F.lit("")).alias("example_values"))
    examples = smallest_values(df, [r["column"] for r in flagged], 5, counts)
    pct = F.format_string("%.0f%%", F.col("affected_rate") * 100)
    kind = F.col("issue")
    return issues.join(examples, "column").select(
        "column", "issue", F.lit("string").alias("stored_dtype"),
        F.when(kind == "numeric_stored_as_text", F.lit("double"))
        .when(kind == "datetime_stored_as_text", F.lit("timestamp")).otherwise(F.lit("mixed"))
        .alias("suggested_dtype"),
        F.when(kind == "numeric_stored_as_text",
               F.format_string("%s of the values of %s are numbers once separators and signs are removed.",
                               pct, F.col("column")))
        .when(kind == "datetime_stored_as_text",
              F.format_string("%s of the values of %s are dates kept as text.", pct, F.col("column")))
        .otherwise(F.format_string("%s of the values of %s are numbers, the others are not.",
                                   pct, F.col("column"))).alias("detail"),
        "affected_rate",
        F.when(kind == "mixed_types", F.col("smallest"))
        .otherwise(F.slice("smallest", 1, 3)).alias("example_values"))


def smallest_values(df: DataFrame, columns: Sequence[str], k: int, counts: DataFrame | None = None) -> DataFrame:
    """(column, smallest): the k smallest distinct texts per column, each by a bounded sort of its distinct values."""
    parts = None
    for c in columns:
        values = df.select(col(c).alias("value")).groupBy("value") if counts is None else counts.where(
            F.col("column") == c).select(F.col("text").alias("value")).groupBy("value")
        part = values.agg(F.lit(c).alias("column")).where("value is not null").orderBy("value").limit(k)
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("smallest"))


def number_text_columns(df: DataFrame, columns: Sequence[str] | None = None, *,
                        settings: Settings = DEFAULT) -> DataFrame:
    """(column): text columns that hold numbers and are not named like identifiers."""
    probe = text_probe(df, of_kind(df, "text", columns))
    ids = words(S.CLEAN_ID_TOKENS)
    return (probe.where(is_number_text(settings) & (F.col("n_present") > 0)
                        & ~F.arrays_overlap(name_tokens(F.col("column")), ids))
            .select("column"))


def data_bytes(field: T.StructField):
    """Aggregate: bytes of the column's values, text by its length, others by fixed width."""
    c = col(field.name)
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.sum(F.octet_length(c)), F.lit(0))
    width = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4,
             T.DateType: 4}.get(type(field.dataType), 8)
    return F.count(c) * width


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, *, settings: Settings = DEFAULT,
                   counts: DataFrame | None = None, roles: DataFrame | None = None) -> DataFrame:
    """One row per column: stored type, present, missing, distinct values, example, role.

    The example is the smallest value, which is the same whatever the row order.
    """
    wanted = fields(df, columns)
    names = [f.name for f in wanted]
    counts = value_counts(df, names) if counts is None else counts
    distinct = distinct_counts(counts)
    roles = column_roles(df, names, settings=settings, distinct=distinct) if roles is None else roles

    def build(i, item):
        position, f = item
        simple = stored_kind(f.dataType) != "other"
        example = F.min(F.when(present(f), col(f.name))).cast("string") if simple else F.lit(None).cast("string")
        missing = F.col(f"r{i}") - F.col(f"p{i}")
        return [F.count(F.lit(1)).alias(f"r{i}"), F.count_if(present(f)).alias(f"p{i}"), example.alias(f"x{i}"),
                data_bytes(f).alias(f"b{i}")], F.struct(
            F.lit(position).alias("position"), F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"p{i}").alias("non_null"), missing.alias("missing"),
            (share(missing, F.col(f"r{i}")) * 100).alias("missing_pct"),
            F.coalesce(F.col(f"x{i}"), F.lit("")).alias("example"), F.col(f"b{i}").alias("data_bytes"))

    nested = [f.name for f in wanted if not countable(f.dataType)] or [""]
    base = in_passes(df, list(enumerate(wanted)), 4, build, settings.fields_per_pass)
    return (base.join(distinct.select("column", F.col("n_unique").alias("unique")), "column", "left")
            .join(roles.select("column", "role"), "column", "left")
            .select("position", "column", "dtype", "non_null", "missing", "missing_pct",
                    F.when(~F.col("column").isin(*nested), F.coalesce("unique", F.lit(0))).cast("long").alias("unique"),
                    "example", "role",
                    "data_bytes"))


def overview(df: DataFrame, *, settings: Settings = DEFAULT, profile: DataFrame | None = None,
             duplicates: DataFrame | None = None) -> DataFrame:
    """One row: rows, columns, cells, missing cells, duplicate rows, data size, shape in words."""
    from tabscope.operators.quality import duplicate_summary

    k = len(df.columns)
    if profile is None:
        wanted = fields(df)
        row = df.agg(F.count(F.lit(1)).alias("n_rows"),
                     sum((F.count_if(~present(f)) for f in wanted), F.lit(0)).alias("missing_cells"),
                     sum((data_bytes(f) for f in wanted), F.lit(0)).alias("data_bytes"))
    else:
        row = profile.agg(F.max(F.col("non_null") + F.col("missing")).alias("n_rows"),
                          F.sum("missing").alias("missing_cells"), F.sum("data_bytes").alias("data_bytes"))
    duplicates = duplicate_summary(df, settings=settings) if duplicates is None else duplicates
    return row.crossJoin(F.broadcast(duplicates.select("duplicate_rows"))).select(
        "n_rows", F.lit(k).cast("long").alias("n_columns"),
        (F.col("n_rows") * k).alias("total_cells"), F.col("missing_cells").cast("long").alias("missing_cells"),
        share(F.col("missing_cells"), F.col("n_rows") * k).alias("missing_rate"),
        "duplicate_rows", F.col("data_bytes").cast("long").alias("data_bytes"),
        bytes_text(F.col("data_bytes")).alias("data_size"),
        F.concat(count_text(F.col("n_rows")), F.lit(f" rows x {k:,} columns")).alias("shape"))


def integer_valued(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, whole): are all finite values of the numeric column whole numbers?"""
    wanted = fields(df, of_kind(df, "numeric", columns))
    return in_passes(df, wanted, 1, lambda i, f: (
        [whole_numbers(finite(f)).alias(f"w{i}")],
        F.struct(F.lit(f.name).alias("column"), F.col(f"w{i}").alias("whole"))), DEFAULT.fields_per_pass)


def non_empty_columns(df: DataFrame) -> DataFrame:
    """(column, is_empty) for every column."""
    wanted = fields(df)
    return in_passes(df, wanted, 1, lambda i, f: (
        [F.count_if(present(f)).alias(f"p{i}")],
        F.struct(F.lit(f.name).alias("column"), (F.col(f"p{i}") == 0).alias("is_empty"))), DEFAULT.fields_per_pass)
