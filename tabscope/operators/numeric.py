"""Descriptive statistics of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from tabscope import settings as S
from tabscope.functions.columns import fields, finite, in_passes, name_tokens, of_kind, share, words
from tabscope.plans.facts import NumberFacts, number_facts
from tabscope.settings import DEFAULT, Settings

def distinct_values(df: DataFrame, columns: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """(column, n_unique): distinct finite values, compared as doubles; from the value counts if there are any."""
    if counts is not None and not any(isinstance(f.dataType, T.DecimalType) for f in fields(df, columns)):
        value = F.coalesce(F.col("number").cast("double"), F.col("real"))
        usable = counts.where(F.col("column").isin(list(columns)) & value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
        return usable.select("column", value.alias("value")).distinct().groupBy("column").agg(F.count("*").alias("n_unique"))
    wanted = fields(df, columns)
    packed = [(finite(f) + F.lit(0.0)).alias(str(i)) for i, f in enumerate(wanted)]
    names = F.array(*[F.lit(f.name) for f in wanted])
    return (df.select(*packed).unpivot([], [str(i) for i in range(len(wanted))], "position", "value")
            .where("value is not null").groupBy("position", "value").agg(F.lit(1).alias("one"))
            .groupBy("position").agg(F.count("*").alias("n_unique"))
            .select(F.element_at(names, F.col("position").cast("int") + 1).alias("column"), "n_unique"))


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None, *, settings: Settings = DEFAULT,
                  facts: dict[str, NumberFacts] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Count, moments, quartiles, shape, distinct values and zero share per numeric column.

    Infinities count as missing here.  Skewness and kurtosis are the bias-corrected ones.
    """
    names = of_kind(df, "numeric", columns)
    if not names:
        return df.sparkSession.createDataFrame([], NUMERIC_SCHEMA)
    facts = number_facts(df, names, settings=settings, mads=False) if facts is None else facts
    wanted = fields(df, names)
    values = df.select(F.lit(1).alias("row"), *[finite(f).alias(f"v{k}") for k, f in enumerate(wanted)])
    rows = in_passes(values, list(enumerate(names)), 11, lambda i, item: _shape(i, *item, facts), settings.fields_per_pass)
    return (rows.join(distinct_values(df, names, counts), "column", "left")
            .withColumn("n_unique", F.coalesce("n_unique", F.lit(0)).cast("long"))
            .select(*[c.split()[0] for c in NUMERIC_SCHEMA.split(", ")]))


NUMERIC_SCHEMA = (
    "position int, column string, count bigint, missing bigint, mean double, median double, std double, "
    "minimum double, q1 double, q3 double, maximum double, iqr double, skewness double, kurtosis double, "
    "n_unique bigint, zero_share double, coefficient_of_variation double"
)


def _shape(i: int, position: int, name: str, facts: dict[str, NumberFacts]):
    """What the facts lack: row count, zeros and the third and fourth moments."""
    fact, v = facts[name], F.col(f"v{position}")
    n, flat = float(fact.n), fact.low == fact.high
    double = lambda x: F.lit(x).cast("double")
    std = 0.0 if fact.n == 1 else fact.std * (n / (n - 1)) ** 0.5 if fact.n else None
    skew = kurtosis = double(None)
    if fact.n >= 3:
        skew = double(0.0) if flat else F.col(f"g1{i}") * ((n * (n - 1)) ** 0.5 / (n - 2))
    if fact.n >= 4:
        kurtosis = double(0.0) if flat else ((n + 1) * F.col(f"g2{i}") + 6) * ((n - 1) / ((n - 2) * (n - 3)))
    q1, q2, q3 = fact.quartiles or (None, None, None)
    return [F.count("row").alias(f"r{i}"), F.skewness(v).alias(f"g1{i}"), F.kurtosis(v).alias(f"g2{i}"),
            F.count_if(v == 0).alias(f"z{i}")], F.struct(
        F.lit(position).alias("position"), F.lit(name).alias("column"), F.lit(fact.n).cast("long").alias("count"),
        (F.col(f"r{i}") - fact.n).alias("missing"), double(fact.mean).alias("mean"), double(q2).alias("median"),
        double(std).alias("std"), double(fact.low).alias("minimum"), double(q1).alias("q1"), double(q3).alias("q3"),
        double(fact.high).alias("maximum"), double(q3 - q1 if fact.n else None).alias("iqr"), skew.alias("skewness"),
        kurtosis.alias("kurtosis"), share(F.col(f"z{i}"), F.lit(fact.n)).alias("zero_share"),
        double(std / abs(fact.mean) if fact.mean else None).alias("coefficient_of_variation"))


def distinct_classes(df: DataFrame, columns: Sequence[str] | None = None, *,
                     settings: Settings = DEFAULT) -> DataFrame:
    """Eligibility per numeric column, found without a shuffle.

    ``distinct_class`` is the number of distinct finite values, 4 standing for four or more.
    """
    names = of_kind(df, "numeric", columns)
    facts = number_facts(df, names, settings=settings, mads=False, quartiles=False)
    classes = [facts[n].distinct_class for n in names]
    return df.sparkSession.createDataFrame(
        [(i, n, k, k == 2, k >= settings.min_distinct_outliers, k >= 2) for i, (n, k) in enumerate(zip(names, classes))],
        "position int, column string, distinct_class int, binary_flag boolean, "
        "outlier_eligible boolean, correlation_eligible boolean")


def numeric_flags(stats: DataFrame, whole: DataFrame | None = None, *, settings: Settings = DEFAULT) -> DataFrame:
    """Shape flags per column of a numeric_stats table.

    ``whole`` (column, whole) settles the whole-number test of the identifier rule; without
    it only the end points are tested.
    """
    s = settings
    if whole is None:
        stats = stats.withColumn("whole", (F.col("minimum") % 1 == 0) & (F.col("maximum") % 1 == 0))
    else:
        stats = stats.join(whole, "column", "left")
    named = F.arrays_overlap(name_tokens(F.col("column")), words(S.NUMERIC_ID_SUFFIX_TOKENS))
    unique = (F.col("n_unique") == F.col("count")) & F.coalesce("whole", F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return stats.select(
        "position", "column",
        yes(F.abs("skewness") >= s.skew_limit).alias("skewed"),
        yes(F.col("kurtosis") >= s.kurtosis_limit).alias("heavy_tailed"),
        ((F.col("zero_share") >= s.zero_share_limit) & (F.col("n_unique") > 2)).alias("zero_inflated"),
        (F.col("n_unique") == 2).alias("binary_flag"),
        yes((F.col("count") > 0) & unique).alias("unique_whole"),
        yes((F.col("count") > 10) & unique & (F.col("minimum") >= 0) & named).alias("identifier_like"))


def scale_spread(stats: DataFrame, *, settings: Settings = DEFAULT) -> DataFrame:
    """One row: smallest and largest column magnitude, their ratio, whether it is large."""
    size = F.greatest(F.abs("minimum"), F.abs("maximum"))
    row = stats.where(F.abs("maximum") > 0).agg(
        F.min(size).alias("smallest_range"), F.max(size).alias("largest_range"), F.count("*").alias("columns"))
    ratio = F.try_divide("largest_range", "smallest_range")
    return row.select("smallest_range", "largest_range", ratio.alias("ratio"),
                      F.coalesce((F.col("columns") >= 2) & (ratio >= settings.scale_ratio_limit),
                                 F.lit(False)).alias("wide_spread"))


def iqr_fences(fact: NumberFacts, settings: Settings = DEFAULT, k: float | None = None) -> tuple[float, float]:
    """Tukey fences; with equal quartiles both are that value, so whatever differs is outside."""
    k = settings.iqr_k if k is None else k
    q1, _, q3 = fact.quartiles
    return q1 - k * (q3 - q1), q3 + k * (q3 - q1)


def histogram(df: DataFrame, column: str, *, settings: Settings = DEFAULT) -> DataFrame:
    """Equal-width histogram with the number of values beyond the IQR fences per bin."""
    value = finite(fields(df, [column])[0])
    fact = number_facts(df, [column], settings=settings, mads=False)[column]
    if fact.n == 0:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n bigint, outliers bigint")
    bins = min(60, max(10, int(fact.n ** 0.5) + 1))
    lo, hi = fact.low, fact.high
    width = (hi - lo) / bins
    low, high = iqr_fences(fact, settings) if fact.distinct_class >= settings.min_distinct_outliers else (lo, hi)
    bin_no = (F.least(F.floor((value - lo) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)).cast("int")
    return (df.where(value.isNotNull()).groupBy(bin_no.alias("bin"))
            .agg(F.count("*").alias("n"), F.count_if((value < low) | (value > high)).alias("outliers"))
            .select("bin", (F.lit(lo) + F.col("bin") * width).alias("low"),
                    (F.lit(lo) + (F.col("bin") + 1) * width).alias("high"), "n", "outliers"))


def box_summary(df: DataFrame, columns: Sequence[str] | None = None, *, settings: Settings = DEFAULT) -> DataFrame:
    """Quartiles, fences and the number of values beyond them per numeric column."""
    names = of_kind(df, "numeric", columns)
    facts = number_facts(df, names, settings=settings, mads=False)
    wanted = [f for f in fields(df, names) if facts[f.name].n]

    def build(i, f):
        fact, v = facts[f.name], finite(f)
        low, high = iqr_fences(fact, settings)
        q1, q2, q3 = fact.quartiles
        return [F.min(F.when(v >= low, v)).alias(f"wl{i}"), F.max(F.when(v <= high, v)).alias(f"wh{i}"),
                F.count_if((v < low) | (v > high)).alias(f"out{i}")], F.struct(
            F.lit(f.name).alias("column"), F.lit(fact.low).alias("minimum"), F.lit(q1).alias("q1"),
            F.lit(q2).alias("median"), F.lit(q3).alias("q3"), F.lit(fact.high).alias("maximum"),
            F.lit(low).alias("lower_fence"), F.lit(high).alias("upper_fence"),
            F.col(f"wl{i}").alias("lower_whisker"), F.col(f"wh{i}").alias("upper_whisker"),
            F.col(f"out{i}").alias("outside"))

    return in_passes(df, wanted, 3, build, settings.fields_per_pass)


def normality(df: DataFrame, column: str, *, settings: Settings = DEFAULT) -> DataFrame:
    """Kolmogorov-Smirnov test of a column against the normal law of its mean and deviation."""
    from pyspark.ml.stat import KolmogorovSmirnovTest

    values = df.select(finite(fields(df, [column])[0]).alias("value")).where("value is not null")
    row = values.agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).first()
    if row["n"] < settings.min_values_zscore or not row["s"]:
        return df.sparkSession.createDataFrame([], "column string, n bigint, statistic double, p_value double")
    test = KolmogorovSmirnovTest.test(values, "value", "norm", float(row["m"]), float(row["s"]))
    return test.select(F.lit(column).alias("column"), F.lit(row["n"]).cast("long").alias("n"),
                       F.col("statistic"), F.col("pValue").alias("p_value"))
