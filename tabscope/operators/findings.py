"""Findings: severity-ranked statements derived from the metric tables.

Each rule set is a select or a small aggregate over tables that have one row per column,
pair or signal; nothing here reads the data again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabscope import settings as S
from tabscope.functions.columns import (
    banded, count_text, missing_band, name_list, number_text, percent_text, severity_rank, share, shortened,
)
from tabscope.operators.categorical import rare_heavy_columns
from tabscope.settings import DEFAULT, Settings

FINDING_SCHEMA = ("category string, title string, detail string, severity string, evidence string, "
                  "recommendation string, seq int")


def finding(category: str, title: Column, detail: Column, severity: Column | str, evidence: Column,
            recommendation: Column | str | None = None, seq: int | Column = 0) -> list[Column]:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return [F.lit(category).alias("category"), as_column(title).alias("title"), as_column(detail).alias("detail"),
            as_column(severity).alias("severity"), F.to_json(evidence).alias("evidence"),
            as_column(recommendation).cast("string").alias("recommendation"),
            as_column(seq).cast("int").alias("seq")]


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def names_of(order: str = "position") -> Column:
    """Aggregate: column names in table order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, "column"))), lambda x: x["column"])


def values_of(value: Column, label: str = "value") -> Column:
    """Aggregate: map from column name to a value."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", value.alias(label)))))


def counted(n: Column, text: str) -> Column:
    return F.concat(count_text(n), F.lit(f" {text}"))


# ---- quality -----------------------------------------------------------------

def missing_findings(summary: DataFrame, by_column: DataFrame, *, settings: Settings = DEFAULT) -> DataFrame:
    """L1: overall missing rate, then the columns that are a fifth empty or more, worst first."""
    s, c = settings, F.col
    none = summary.where("missing_cells = 0").select(*finding(
        "missing_data", F.lit("No missing values"), F.lit("Every cell holds a value."), "info",
        F.struct("missing_cells", "total_cells"),
        "Make sure that missing values were not written as codes such as 0 or -1."))
    some = summary.where("missing_cells > 0").select(*finding(
        "missing_data", F.concat(count_text(c("missing_cells")), F.lit(" missing values in "),
                                 c("columns_with_missing").cast("string"), F.lit(" column(s)")),
        F.concat(percent_text(c("missing_rate")), F.lit(" of all cells are empty; "), count_text(c("complete_rows")),
                 F.lit(" rows are complete.")),
        missing_band(c("missing_rate"), s),
        F.struct("missing_cells", "missing_rate", "columns_with_missing", "complete_rows"),
        "Find out why values are missing before replacing them.", 1))
    worst = by_column.where("missing > 0")
    columns = worst.where(c("missing_rate") >= s.missing_moderate).select(*finding(
        "missing_data", F.concat(F.lit("Column "), c("column"), F.lit(" is "), percent_text(c("missing_rate")),
                                 F.lit(" empty")),
        F.concat(count_text(c("missing")), F.lit(" values are missing (type "), c("dtype"), F.lit(").")),
        c("severity"), F.struct("column", "missing", "missing_rate"),
        F.when(c("missing_rate") >= s.missing_critical, F.lit("Dropping the column may be better than filling it."))
        .otherwise(F.lit("Check whether the gaps go with the outcome before filling them.")),
        2 + F.row_number().over(Window.orderBy(F.desc("missing_rate"), "position"))))
    return union([none, some, columns])


def duplicate_findings(summary: DataFrame, *, settings: Settings = DEFAULT) -> DataFrame:
    s, c = settings, F.col
    has = c("duplicate_rows") > 0
    severity = banded(c("duplicate_rate"), [(s.duplicate_low, "low"), (s.duplicate_moderate, "moderate"),
                                            (s.duplicate_high, "high")])
    return summary.select(*finding(
        "duplicates",
        F.when(has, F.concat(count_text(c("duplicate_rows")), F.lit(" duplicate row(s), "), percent_text(c("duplicate_rate"))))
        .otherwise(F.lit("No duplicate rows")),
        F.when(has, F.concat(F.lit("They repeat earlier rows in every column and form "),
                             count_text(c("duplicate_group_count")), F.lit(" group(s).")))
        .otherwise(F.concat(F.lit("All "), count_text(c("total_rows")), F.lit(" rows differ."))),
        F.when(has, severity).otherwise(F.lit("info")),
        F.struct("duplicate_rows", "duplicate_rate", "duplicate_group_count", "unique_rows"),
        F.when(has, F.lit("Keep true repeats, remove copies that an export or a join has made."))
        .otherwise(F.lit("Rows may still agree in all but one column."))))


def variance_findings(low: DataFrame, n_columns: int, *, settings: Settings = DEFAULT) -> DataFrame:
    s, c = settings, F.col
    # an empty column is constant and near-constant: it counts once
    totals = low.agg(F.count_if("is_constant").alias("n_constant"), F.count_if(c("is_near_constant") & ~c("is_constant")).alias("n_near"))
    none = totals.where("n_constant = 0 and n_near = 0").select(*finding(
        "low_variance", F.lit("No constant columns"), F.lit("Every column varies."), "info", F.struct("n_constant")))
    def listed(flag, title, severity, advice, seq):
        group = low.where(flag).agg(F.count("*").alias("n"), names_of().alias("names"),
                                    values_of(c("dominant_value")).alias("values"),
                                    values_of(c("dominant_rate")).alias("rates")).where("n > 0")
        return group.select(*finding("low_variance", counted(c("n"), title), F.concat(name_list(c("names")), F.lit(".")),
                                     severity, F.struct(c("names").alias("columns"), "values", "rates"), advice, seq))
    flagged = c("n_constant") + c("n_near")
    many = totals.where(flagged >= n_columns * s.low_variance_alarm_share).where(flagged > 0).select(*finding(
        "low_variance", F.concat(percent_text(flagged / F.lit(max(n_columns, 1))), F.lit(" of the columns hardly vary")),
        F.concat(flagged.cast("string"), F.lit(f" of {n_columns} columns; the extract may be filtered too narrowly.")),
        "high", F.struct(flagged.alias("flagged"), F.lit(n_columns).alias("total_columns")),
        "Review how the table was extracted.", 3))
    return union([none,
                  listed("is_constant", "constant column(s)", "moderate", "Drop them before modelling.", 1),
                  listed("is_near_constant", "near-constant column(s)", "low",
                         "Consider dropping them or merging their rare values.", 2), many])


ISSUE_TEXT = (  # issue, title, severity, advice
    ("numeric_stored_as_text", "Numbers kept as text", "high", "Convert them so that they enter the statistics."),
    ("datetime_stored_as_text", "Dates kept as text", "moderate", "Parse them so that time can be analysed."),
    ("mixed_types", "Numbers and other text in one column", "moderate", "Agree on one format at the source."),
)


def dtype_findings(issues: DataFrame) -> DataFrame:
    c = F.col
    none = issues.agg(F.count("*").alias("issues")).where("issues = 0").select(*finding(
        "dtypes", F.lit("Stored types fit the content"), F.lit("No numbers, dates or mixtures were found in text."),
        "info", F.struct("issues")))
    pick = lambda k: reduce(lambda acc, row: F.when(c("issue") == row[0], F.lit(row[k])).otherwise(acc),
                            ISSUE_TEXT, F.lit("low"))
    ordered = F.array_sort(F.collect_list(F.struct("column", "detail", "example_values")))
    groups = issues.groupBy("issue").agg(ordered.alias("items"))
    names = F.transform("items", lambda x: x["column"])
    details = F.array_join(F.transform(F.slice("items", 1, 3), lambda x: x["detail"]), " ")
    examples = F.map_from_entries(F.transform(F.slice("items", 1, 5), lambda x: F.struct(x["column"], x["example_values"])))
    some = groups.select(*finding(
        "dtypes", F.concat(pick(1), F.lit(": "), F.size("items").cast("string"), F.lit(" column(s)")),
        F.when(F.size("items") > 3, F.concat(details, F.lit(" ..."))).otherwise(details), pick(2),
        F.struct("issue", names.alias("columns"), examples.alias("examples")), pick(3),
        reduce(lambda acc, row: F.when(c("issue") == row[0], F.lit([r[0] for r in ISSUE_TEXT].index(row[0]))).otherwise(acc),
               ISSUE_TEXT, F.lit(9))))
    return union([none, some])


# ---- numeric and categorical ---------------------------------------------------

def numeric_findings(stats: DataFrame, flags: DataFrame, spread: DataFrame, *, settings: Settings = DEFAULT) -> DataFrame:
    s, c = settings, F.col
    both = stats.join(flags.drop("position"), "column")
    total = stats.agg(F.count("*").alias("total"))
    none = total.where("total = 0").select(*finding(
        "numerical", F.lit("No numeric columns"), F.lit("Numeric analyses were left out; numbers may be kept as text."),
        "info", F.struct("total")))

    def rule(flag, title, metric, severity, advice, seq):
        group = both.where(flag).agg(F.count("*").alias("n"), names_of().alias("names"),
                                     values_of(metric).alias("values")).where("n > 0").crossJoin(F.broadcast(total))
        return group.select(*finding("numerical", counted(c("n"), title), F.concat(name_list(c("names")), F.lit(".")),
                                     severity, F.struct(c("names").alias("columns"), "values"), advice, seq))
    wide = spread.where("wide_spread").select(*finding(
        "numerical", F.lit("Columns of very different magnitude"),
        F.concat(F.lit("From about "), number_text(c("smallest_range")), F.lit(" to "), number_text(c("largest_range")),
                 F.lit(": a factor of "), F.format_number(c("ratio"), 0), F.lit(".")),
        "low", F.struct("smallest_range", "largest_range", "ratio"),
        "Scale features before distance-based or regularised models.", 4))
    return union([
        none,
        rule("skewed", "clearly skewed column(s)", c("skewness"),
             F.when(c("n") > c("total") / 3, F.lit("moderate")).otherwise(F.lit("low")),
             "A log or power transform helps linear models; trees do not need it.", 1),
        rule("heavy_tailed", "column(s) with heavy tails", c("kurtosis"), "low",
             "Describe them by median and quartiles rather than mean and deviation.", 2),
        rule("zero_inflated", "column(s) with many zeros", c("zero_share"), "low",
             "Zero may mean that nothing happened; model that apart from the amount.", 3),
        wide,
        rule("binary_flag", "two-valued numeric column(s)", c("n_unique"), "info", None, 5),
        rule("identifier_like", "numeric column(s) that look like identifiers", c("n_unique"), "low",
             "Keep identifiers out of correlations and models.", 6)])


def categorical_findings(stats: DataFrame, *, settings: Settings = DEFAULT) -> DataFrame:
    s, c = settings, F.col
    none = stats.agg(F.count("*").alias("n")).where("n = 0").select(*finding(
        "categorical", F.lit("No categorical columns"), F.lit("There is nothing to analyse."), "info", F.struct("n")))
    dominant = stats.where("is_dominant and n_unique > 1").agg(
        F.count("*").alias("n"), names_of().alias("names"), values_of(F.round("top_rate", 4)).alias("rates"),
        F.max(F.struct("top_rate", -c("position"), "column", "top_value", "top_count", "count")).alias("worst")).where("n > 0")
    wide = stats.where("is_high_cardinality and n_unique > 1").agg(
        F.count("*").alias("n"), names_of().alias("names"), values_of(c("n_unique")).alias("levels")).where("n > 0")
    rare = rare_heavy_columns(stats).agg(
        F.count("*").alias("n"), names_of().alias("names"), values_of(c("rare_categories")).alias("levels")).where("n > 0")
    return union([
        none,
        dominant.select(*finding(
            "categorical", counted(c("n"), "column(s) ruled by one value"),
            F.concat(percent_text(c("worst.top_rate")), F.lit(" of "), c("worst.column"), F.lit(" is '"),
                     shortened(c("worst.top_value"), 40), F.lit("'. Columns: "), name_list(c("names")), F.lit(".")),
            F.when(c("worst.top_rate") >= s.dominant_severe_share, F.lit("high")).otherwise(F.lit("moderate")),
            F.struct(c("rates").alias("columns"), c("worst.column").alias("worst_case")),
            "As a target, such a column makes accuracy misleading; as a feature, it separates little.", 1)),
        wide.select(*finding(
            "categorical", counted(c("n"), "column(s) with very many levels"), F.concat(name_list(c("names")), F.lit(".")),
            "moderate", F.struct(c("levels").alias("columns")), "Group rare levels or encode by frequency.", 2)),
        rare.select(*finding(
            "categorical", counted(c("n"), "column(s) with many rare levels"), F.concat(name_list(c("names")), F.lit(".")),
            "low", F.struct(c("levels").alias("columns")), "Merge rare levels into one.", 3))])


# ---- outliers -------------------------------------------------------------------

def outlier_findings(stats: DataFrame, rows: DataFrame, disagreement: DataFrame, sentinels: DataFrame, *,
                     settings: Settings = DEFAULT) -> DataFrame:
    s, c = settings, F.col
    empty = stats.agg(F.count("*").alias("n")).where("n = 0").select(*finding(
        "outliers", F.lit("No numeric columns to test for outliers"), F.lit("The rules need numbers."), "info", F.struct("n")))
    iqr = stats.where("method = 'iqr' and available")
    hit = iqr.where("count > 0")
    tested = stats.agg(F.count_distinct("column").alias("columns"),
                       F.count_if((c("method") == "iqr") & (c("count") > 0)).alias("iqr_hits"),
                       F.count_if((c("method") != "iqr") & (c("count") > 0)).alias("other_hits"))
    none = tested.where("columns > 0 and iqr_hits = 0").select(*finding(
        "outliers", F.lit("No values beyond the IQR fences"),
        F.when(c("other_hits") > 0, F.lit("The z-score rules flag some values, which suggests skewed columns."))
        .otherwise(F.lit("No rule flags a value.")), "info", F.struct("columns")))
    ordered = F.array_sort(F.collect_list(F.struct((-c("rate")).alias("neg"), "position", "column", "count", "rate",
                                                   "lower_bound", "upper_bound")))
    some = hit.agg(ordered.alias("items")).where(F.size("items") > 0).crossJoin(F.broadcast(rows)).withColumn(
        "worst", F.element_at("items", 1))
    found = some.select(*finding(
        "outliers", F.concat(F.size("items").cast("string"), F.lit(" column(s) with values beyond the IQR fences")),
        F.concat(F.lit("Most in "), c("worst.column"), F.lit(": "), percent_text(c("worst.rate")), F.lit(" outside ["),
                 number_text(c("worst.lower_bound")), F.lit(", "), number_text(c("worst.upper_bound")), F.lit("].")),
        banded(c("worst.rate"), [(s.outlier_moderate, "moderate"), (s.outlier_high, "high")], "low"),
        F.struct(F.transform("items", lambda x: x.dropFields("neg", "position")).alias("columns"), "rows_flagged"),
        "Look at the extreme rows first: an outlier need not be an error.", 1))
    differ = disagreement.agg(F.count("*").alias("n"), names_of().alias("names"), F.array_sort(F.collect_list(
        F.struct("column", "iqr_count", "zscore_count"))).alias("columns")).where("n > 0").select(*finding(
            "outliers", counted(c("n"), "column(s) where IQR and z-score disagree"),
            F.concat(name_list(c("names")), F.lit(": extremes widen the deviation and hide others.")), "low",
            F.struct("columns"), "Trust the IQR or the modified z-score for skewed columns.", 2))
    skipped = stats.where("method = 'iqr' and not available").agg(F.count("*").alias("n"), names_of().alias("names")
                                                                  ).where("n > 0").select(*finding(
        "outliers", counted(c("n"), "column(s) not tested for outliers"),
        F.concat(name_list(c("names")), F.lit(": too few distinct values.")), "info", F.struct(c("names").alias("columns")),
        None, 3))
    codes = sentinels.groupBy("position", "column").agg(F.array_sort(F.collect_list(
        F.struct(c("code").cast("long").alias("code"), "matches"))).alias("codes"))
    placeholder = codes.agg(F.count("*").alias("n"), names_of().alias("names"), values_of(c("codes")).alias("columns")
                            ).where("n > 0").select(*finding(
        "outliers", F.lit("Placeholder codes suspected"),
        F.concat(F.lit("Extreme values repeat usual codes for unknown in "), name_list(c("names")), F.lit(".")), "moderate",
        F.struct("columns"), "If the codes mean unknown, set them to missing.", 4))
    return union([empty, none, found, differ, skipped, placeholder])


# ---- relations ------------------------------------------------------------------

def correlation_findings(pairs: DataFrame, n_eligible: int, method: str, *, settings: Settings = DEFAULT) -> DataFrame:
    s, c = settings, F.col
    spark = pairs.sparkSession
    if n_eligible < 2:
        return spark.range(1).select(*finding(
            "correlations", F.lit("No correlation analysis"),
            F.lit("It takes two numeric columns with two distinct values each."), "info",
            F.struct(F.lit(method).alias("method"))))
    item = F.struct((-c("abs_r")).alias("neg"), c("column_a").alias("a"), c("column_b").alias("b"), "r",
                    c("n_observations").alias("n"), "p_value")
    named = lambda xs, fmt: F.array_join(F.transform(F.slice(xs, 1, 5), lambda x: F.format_string(
        fmt, x["a"], x["b"], x["r"])), "; ")

    def rule(where, title, severity, advice, seq, fmt="%s and %s (r = %+.3f)"):
        group = pairs.where(where).agg(F.array_sort(F.collect_list(item)).alias("items")).where(F.size("items") > 0)
        return group.select(*finding(
            "correlations", F.concat(F.size("items").cast("string"), F.lit(f" {title}")),
            F.concat(named(F.col("items"), fmt), F.lit(".")), severity,
            F.struct(F.transform("items", lambda x: x.dropFields("neg")).alias("pairs")), advice, seq))
    top = pairs.agg(F.max("abs_r").alias("max_abs_r"), F.count("*").alias("n"))
    quiet = top.where((c("n") == 0) | (c("max_abs_r") < s.r_weak)).select(*finding(
        "correlations", F.when(c("n") == 0, F.lit("No pair could be compared")).otherwise(F.lit("No notable correlation")),
        F.lit("Relations may still exist in another shape."), "info", F.struct("max_abs_r", F.lit(method).alias("method")),
        "Look at scatter plots and rank correlation before concluding independence.", 4))
    thin = pairs.where((c("abs_r") >= s.r_moderate) & ~c("reliable"))
    columns = thin.select(F.explode(F.array("column_a", "column_b")).alias("column")).distinct()
    few = columns.agg(F.array_sort(F.collect_list("column")).alias("names")).where(F.size("names") > 0).select(*finding(
        "correlations", F.lit("Correlations that rest on few rows"),
        F.concat(name_list(c("names")), F.lit(f" share fewer than {s.min_pair_rows} complete rows.")), "low",
        F.struct(c("names").alias("columns")), "Wait for more complete rows.", 5))
    return union([
        rule(c("r") >= s.r_strong, "pair(s) rise together", "moderate",
             "One of the two may be redundant; neither need cause the other.", 1),
        rule(c("r") <= -s.r_strong, "pair(s) move against each other", "moderate",
             "See whether a common scale or the way of collecting explains it.", 2),
        rule(c("abs_r") >= s.r_near_duplicate, "pair(s) of nearly equal columns", "high",
             "Keep one of each pair.", 3, "%s and %s (r = %+.4f)"), quiet, few])


def association_findings(associations: DataFrame, *, settings: Settings = DEFAULT) -> DataFrame:
    s, c = settings, F.col
    item = F.struct((-c("cramers_v")).alias("neg"), c("column_a").alias("a"), c("column_b").alias("b"),
                    c("cramers_v").alias("v"), "p_value")
    group = associations.where(c("cramers_v") >= s.v_strong).agg(
        F.array_sort(F.collect_list(item)).alias("items"),
        F.count_if(c("cramers_v") >= s.v_very_strong).alias("very")).where(F.size("items") > 0)
    text = F.array_join(F.transform(F.slice("items", 1, 5), lambda x: F.format_string(
        "%s and %s (V = %.3f)", x["a"], x["b"], x["v"])), "; ")
    return group.select(*finding(
        "associations", F.concat(F.size("items").cast("string"), F.lit(" strongly associated categorical pair(s)")),
        F.concat(text, F.lit(".")), F.when(c("very") > 0, F.lit("moderate")).otherwise(F.lit("low")),
        F.struct(F.transform("items", lambda x: x.dropFields("neg")).alias("pairs")),
        "One column of a pair may be derived from the other."))


def left_out_findings(associations: DataFrame | None, separation: DataFrame | None) -> DataFrame:
    """A word on the columns that were not compared for the number of their levels, and why; None: not asked for."""
    parts = []
    for levels, category, title, advice, seq in (
            (associations, "associations", "categorical column(s) not compared", "Group rare levels first if these columns matter.", 2),
            (separation, "leakage", "text feature(s) not tested for separation", "Check by hand whether their values give the target away.", 90)):
        if levels is None:
            continue
        item = F.struct("column", "n_unique", "reason")
        group = levels.where("not available").agg(F.array_sort(F.collect_list(item)).alias("columns")).where(F.size("columns") > 0)
        named = F.array_join(F.transform(F.col("columns"), lambda x: F.format_string("%s (%s)", x["column"], x["reason"])), ", ")
        parts.append(group.select(*finding(
            category, F.concat(F.size("columns").cast("string"), F.lit(f" {title}")), F.concat(named, F.lit(".")), "info", F.struct("columns"), advice, seq)))
    return union(parts)


def anomaly_findings(summary: DataFrame, deviations: DataFrame | None, *, settings: Settings = DEFAULT) -> DataFrame:
    c = F.col
    off = summary.where("not available").select(*finding(
        "anomalies", F.lit("No anomaly detection"), c("reason"), "info", F.struct("available", "contamination")))
    if deviations is None:
        return off
    features = deviations.agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct(
        (-c("mean_robust_z")).alias("z"), "feature"))), lambda x: x["feature"]), 1, 5).alias("top"))
    on = summary.where("available").crossJoin(F.broadcast(features))
    found = on.select(*finding(
        "anomalies", F.concat(count_text(c("n_anomalies")), F.lit(" unusual row(s), "), percent_text(c("anomaly_rate"))),
        F.concat(count_text(c("n_rows_scored")), F.lit(" rows scored on "), F.size("features_used").cast("string"),
                 F.lit(" features."), F.when(F.size("top") > 0, F.concat(F.lit(" They deviate most in "), name_list(c("top")),
                                                                         F.lit("."))).otherwise(F.lit("")),
                 F.when(c("reason") != "", F.concat(F.lit(" "), c("reason"))).otherwise(F.lit(""))),
        F.when(c("anomaly_rate") >= 0.10, F.lit("high")).when(c("anomaly_rate") >= 0.05, F.lit("moderate"))
        .when(c("anomaly_rate") > 0, F.lit("low")).otherwise(F.lit("info")),
        F.struct("n_anomalies", "anomaly_rate", "contamination", "features_used", "n_rows_scored"),
        "Have someone who knows the data look at these rows before acting on them.", 1))
    forced = on.where(c("contamination") >= 0.25).select(*finding(
        "anomalies", F.lit("The contamination setting is very high"),
        F.format_string("At %.2f about that share of rows is labelled whatever the data.", "contamination"), "low",
        F.struct("contamination"), "Compare settings between 0.01 and 0.10.", 2))
    return union([off, found, forced])


def leakage_findings(signals: DataFrame) -> DataFrame:
    c = F.col
    real = signals.where("signal <> 'target_selection'")
    none = real.agg(F.count("*").alias("signals")).where("signals = 0").select(*finding(
        "leakage", F.lit("No leakage signals"), F.lit("None of the checks fired, which is no proof of absence."), "info",
        F.struct("signals"), "Ask those who collected the data when each value becomes known."))
    names = F.array_sort(F.collect_set("column"))
    overall = real.agg(names.alias("names"), F.max(F.struct(severity_rank(c("severity")).alias("k"), "severity")).alias("worst")
                       ).where(F.size("names") > 0).select(*finding(
        "leakage", F.concat(F.size("names").cast("string"), F.lit(" column(s) with leakage signals")),
        F.concat(name_list(c("names")), F.lit(".")), c("worst.severity"), F.struct(c("names").alias("columns")),
        "For each, ask whether its value is known when the prediction is made.", 1))
    order = Window.orderBy(F.desc(severity_rank(c("severity"))), "column", "signal")
    each = real.select(*finding(
        "leakage", F.concat(F.lit("Possible leakage in "), c("column"), F.lit(" ("), c("signal"), F.lit(")")),
        F.concat(c("reasoning"), F.lit(" Confidence: "), c("confidence"), F.lit(".")), c("severity"),
        F.struct(c("evidence").alias("signal_evidence")), c("recommendation"), 1 + F.row_number().over(order)))
    return union([none, overall, each])


# ---- over all findings ------------------------------------------------------------

def sort_findings(parts: list[DataFrame]) -> DataFrame:
    """All findings, most severe first, otherwise in the order of the analyses."""
    tagged = union([p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
    ranked = tagged.withColumn("severity_rank", severity_rank(F.col("severity")))
    place = F.row_number().over(Window.orderBy(F.desc("severity_rank"), "part", "seq", "title"))
    return ranked.select(place.alias("place"), "category", "title", "detail", "severity", "severity_rank",
                         "evidence", "recommendation").orderBy("place")


def by_category(findings: DataFrame, category: str) -> DataFrame:
    return findings.where(F.col("category") == category)


def serious(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("severity_rank") >= S.SEVERITY_RANK["high"])


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "severity_rank").agg(F.count("*").alias("n")).orderBy(F.desc("severity_rank"))


def recommendations(findings: DataFrame, n_rows: int, n_columns: int, *, settings: Settings = DEFAULT) -> DataFrame:
    """(place, recommendation): distinct advice of the worst findings, then notes on small tables."""
    c = F.col
    advice = findings.where((c("severity_rank") >= 1) & c("recommendation").isNotNull())
    first = F.row_number().over(Window.partitionBy(F.lower(F.trim("recommendation"))).orderBy("place"))
    chosen = (advice.withColumn("nth", first).where("nth = 1").orderBy("place").limit(settings.recommendations)
              .select("place", F.concat_ws(": ", "title", "recommendation").alias("recommendation")))
    fallback = (chosen.agg(F.count("*").alias("n")).where("n = 0")
                .select(F.lit(1_000_000).alias("place"), F.lit("Nothing needs correcting by these checks; still validate "
                                                               "the table against its source.").alias("recommendation")))
    notes = []
    if n_rows < 50:
        notes.append((2_000_000, f"With {n_rows} rows all estimates are noisy; take them as hints."))
    if n_columns < 3:
        notes.append((2_000_001, f"With {n_columns} column(s) there is little for multivariate checks to work on."))
    out = chosen.unionByName(fallback)
    if notes:
        out = out.unionByName(findings.sparkSession.createDataFrame(notes, "place int, recommendation string"))
    return out.select(F.row_number().over(Window.orderBy("place")).alias("place"), "recommendation").orderBy("place")


def executive_summary(findings: DataFrame, *, settings: Settings = DEFAULT) -> DataFrame:
    """(place, line): the worst findings that are more than information."""
    lines = (findings.where("severity <> 'info'").orderBy("place").limit(settings.summary_lines)
             .select("place", F.format_string("[%s] %s", F.initcap("severity"), F.col("title")).alias("line")))
    quiet = (lines.agg(F.count("*").alias("n")).where("n = 0")
             .select(F.lit(1).alias("place"), F.lit("Nothing passed the reporting thresholds.").alias("line")))
    return lines.unionByName(quiet).orderBy("place")
