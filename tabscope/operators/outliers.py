"""Outliers by Tukey fences, z-score and modified z-score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabscope import settings as S
from tabscope.functions.columns import as_rows, banded, close_to, col, fields, finite, number_text, of_kind, share
from tabscope.operators.numeric import iqr_fences
from tabscope.plans.facts import NumberFacts, number_facts
from tabscope.settings import DEFAULT, Settings

METHODS = ("iqr", "iqr_extreme", "zscore", "modified_zscore")
RULE_SCHEMA = ("position int, column string, method string, lower_bound double, upper_bound double, "
               "threshold double, center double, scale double, available boolean, reason string")


def outlier_rules(df: DataFrame, columns: Sequence[str] | None = None, *, settings: Settings = DEFAULT,
                  modified: bool = True, facts: dict[str, NumberFacts] | None = None) -> list[dict]:
    """The rule of each method for each numeric column: bounds, or why it does not apply.

    These are at most 4 x #columns records, found by scans that return one row each.
    """
    s = settings
    names = of_kind(df, "numeric", columns)
    facts = number_facts(df, names, settings=s, mads=modified) if facts is None else facts
    rules = []
    for position, name in enumerate(names):
        fact = facts[name]

        def rule(method, lower=None, upper=None, threshold=None, center=None, scale=None, reason=""):
            rules.append(dict(position=position, column=name, method=method, lower_bound=lower,
                              upper_bound=upper, threshold=threshold, center=center, scale=scale,
                              available=not reason, reason=reason))

        if fact.distinct_class < s.min_distinct_outliers:
            for m in METHODS if modified else METHODS[:3]:
                rule(m, reason=f"{fact.distinct_class} distinct value(s): a rule would flag the smaller class itself.")
            continue
        for m, k in (("iqr", s.iqr_k), ("iqr_extreme", s.iqr_extreme_k)):
            if fact.n < s.min_values_iqr:
                rule(m, reason=f"fewer than {s.min_values_iqr} finite values")
            else:
                rule(m, *iqr_fences(fact, s, k), k)
        few = f"fewer than {s.min_values_zscore} finite values" if fact.n < s.min_values_zscore else ""
        z = s.zscore_limit
        if few or not fact.std:
            rule("zscore", reason=few or "no variance")
        else:
            rule("zscore", fact.mean - z * fact.std, fact.mean + z * fact.std, z, fact.mean, fact.std)
        if not modified:
            continue
        z, median = s.modified_zscore_limit, fact.quartiles[1]
        if few or not fact.mad:
            rule("modified_zscore", reason=few or "median absolute deviation is zero")
        else:
            reach = z * fact.mad / s.mad_scale
            rule("modified_zscore", median - reach, median + reach, z, median, fact.mad)
    return rules


def flagged(value: Column, rule: dict, s: Settings = DEFAULT) -> Column:
    """Is the value an outlier under the rule? NULL values are not."""
    if not rule["available"]:
        return F.lit(False)
    if rule["method"] == "zscore":
        hit = F.abs((value - rule["center"]) / rule["scale"]) > rule["threshold"]
    elif rule["method"] == "modified_zscore":
        hit = F.abs(s.mad_scale * (value - rule["center"]) / rule["scale"]) > rule["threshold"]
    else:
        hit = (value < rule["lower_bound"]) | (value > rule["upper_bound"])
    return F.coalesce(hit, F.lit(False))


def outlier_stats(df: DataFrame, columns: Sequence[str] | None = None, *, settings: Settings = DEFAULT,
                  modified: bool = True, rules: list[dict] | None = None) -> DataFrame:
    """Count and rate of outliers per column and method."""
    rules = outlier_rules(df, columns, settings=settings, modified=modified) if rules is None else rules
    if not rules:
        return df.sparkSession.createDataFrame([], OUTLIER_SCHEMA)
    parts, per_pass = [], max(4, settings.fields_per_pass // 2)
    for start in range(0, len(rules), per_pass):
        part = rules[start:start + per_pass]
        exprs, structs = [], []
        table, value = _values(df, [r["column"] for r in part])
        for i, r in enumerate(part):
            v = value[r["column"]]
            exprs += [F.count_if(flagged(v, r, settings)).alias(f"c{i}"), F.count(v).alias(f"n{i}")]
            usable = F.col(f"n{i}") if r["available"] else F.lit(0)
            structs.append(F.struct(
                F.lit(r["position"]).alias("position"), F.lit(r["column"]).alias("column"),
                F.lit(r["method"]).alias("method"), F.col(f"c{i}").alias("count"),
                share(F.col(f"c{i}"), usable).alias("rate"), usable.cast("long").alias("n_usable"),
                F.lit(r["lower_bound"]).cast("double").alias("lower_bound"),
                F.lit(r["upper_bound"]).cast("double").alias("upper_bound"),
                F.lit(r["threshold"]).cast("double").alias("threshold"),
                F.lit(r["available"]).alias("available"), F.lit(r["reason"]).alias("reason")))
        parts.append(as_rows(table.agg(*exprs), structs))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _values(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    """The finite values as plain columns, so that rules do not repeat the conversion."""
    names = list(dict.fromkeys(columns))
    table = df.select(*[finite(f).alias(f"v{i}") for i, f in enumerate(fields(df, names))])
    return table, {n: F.col(f"v{i}") for i, n in enumerate(names)}


OUTLIER_SCHEMA = ("position int, column string, method string, count bigint, rate double, n_usable bigint, "
                  "lower_bound double, upper_bound double, threshold double, available boolean, reason string")


def fences(df: DataFrame, columns: Sequence[str], settings: Settings = DEFAULT) -> dict[str, tuple[float, float]]:
    """IQR fences of the columns that are eligible for them."""
    return {r["column"]: (r["lower_bound"], r["upper_bound"])
            for r in outlier_rules(df, columns, settings=settings, modified=False)
            if r["method"] == "iqr" and r["available"]}


def flagged_rows(df: DataFrame, columns: Sequence[str] | None = None, *, settings: Settings = DEFAULT,
                 rules: list[dict] | None = None, modified: bool = True) -> DataFrame:
    """Rows flagged by any method, with the array ``flags`` of (column, method) that did."""
    rules = outlier_rules(df, columns, settings=settings, modified=modified) if rules is None else rules
    by_name = {f.name: f for f in df.schema.fields}
    marks = [F.when(flagged(finite(by_name[r["column"]]), r, settings),
                    F.struct(F.lit(r["column"]).alias("column"), F.lit(r["method"]).alias("method")))
             for r in rules if r["available"]]
    flags = F.filter(F.array(*marks), lambda x: x.isNotNull()) if marks else F.array()
    return df.withColumn("flags", flags).where(F.size("flags") > 0)


def rows_flagged(df: DataFrame, columns: Sequence[str] | None = None, *, settings: Settings = DEFAULT,
                 rules: list[dict] | None = None, modified: bool = True) -> DataFrame:
    """One row: how many rows any method flags, and how many columns the IQR rule flags."""
    rules = outlier_rules(df, columns, settings=settings, modified=modified) if rules is None else rules
    usable = [r for r in rules if r["available"]]
    table, value = _values(df, [r["column"] for r in usable])
    hit = F.lit(False)
    for r in usable:
        hit = hit | flagged(value[r["column"]], r, settings)
    rows = table.agg(F.count_if(hit).alias("rows_flagged"))
    iqr = outlier_stats(df, rules=[r for r in rules if r["method"] == "iqr"], settings=settings).agg(
        F.count_if(F.col("count") > 0).alias("columns_flagged"))
    return rows.crossJoin(F.broadcast(iqr))


def outlier_examples(df: DataFrame, column: str, *, method: str = "iqr", limit: int | None = None,
                     settings: Settings = DEFAULT) -> DataFrame:
    """The flagged rows of a column, largest absolute value first."""
    limit = settings.example_rows if limit is None else limit
    value = finite(fields(df, [column])[0])
    rule = next(r for r in outlier_rules(df, [column], settings=settings) if r["method"] == method)
    rest = [col(c) for c in df.columns if c != column]
    return df.where(flagged(value, rule, settings)).orderBy(F.desc(F.abs(value)), col(column), *rest).limit(limit)


def method_disagreement(stats: DataFrame, *, settings: Settings = DEFAULT) -> DataFrame:
    """Columns whose IQR and z-score counts differ by half of the larger one or more."""
    wide = (stats.where("available and method in ('iqr', 'zscore')").groupBy("position", "column")
            .agg(F.coalesce(F.max(F.when(F.col("method") == "iqr", F.col("count"))), F.lit(0)).alias("iqr_count"),
                 F.coalesce(F.max(F.when(F.col("method") == "zscore", F.col("count"))), F.lit(0)).alias("zscore_count")))
    gap = F.abs(F.col("iqr_count") - F.col("zscore_count"))
    return wide.where(share(gap, F.greatest("iqr_count", "zscore_count")) >= settings.disagreement_share)


def sentinel_suspects(df: DataFrame, columns: Sequence[str] | None = None, *, settings: Settings = DEFAULT,
                      rules: list[dict] | None = None) -> DataFrame:
    """Placeholder codes that make up a quarter or more of a column's IQR outliers."""
    rules = outlier_rules(df, columns, settings=settings, modified=False) if rules is None else rules
    schema = "position int, column string, code double, matches bigint, outliers bigint"
    wanted = [r for r in rules if r["method"] == "iqr" and r["available"]]
    if not wanted:
        return df.sparkSession.createDataFrame([], schema)
    parts, per_pass = [], max(1, settings.fields_per_pass // (len(S.SENTINELS) + 1))
    for start in range(0, len(wanted), per_pass):
        part = wanted[start:start + per_pass]
        table, value = _values(df, [r["column"] for r in part])
        exprs, structs = [], []
        for i, r in enumerate(part):
            v = value[r["column"]]
            out = flagged(v, r, settings)
            exprs.append(F.count_if(out).alias(f"n{i}"))
            for j, code in enumerate(S.SENTINELS):
                exprs.append(F.count_if(out & close_to(v, code)).alias(f"m{i}_{j}"))
                structs.append(F.struct(
                    F.lit(r["position"]).alias("position"), F.lit(r["column"]).alias("column"), F.lit(code).alias("code"),
                    F.col(f"m{i}_{j}").alias("matches"), F.col(f"n{i}").alias("outliers")))
        parts.append(as_rows(table.agg(*exprs), structs))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.where((F.col("matches") >= 1)
                       & (share(F.col("matches"), F.col("outliers")) >= settings.sentinel_share))


def with_modified_zscore(df: DataFrame, column: str, out: str = "modified_zscore", *,
                         settings: Settings = DEFAULT) -> DataFrame:
    """Add the robust z-score of a column: 0 where the deviation is zero, NULL where not finite."""
    value = finite(fields(df, [column])[0])
    fact = number_facts(df, [column], settings=settings)[column]
    if not fact.n:
        return df.withColumn(out, F.lit(None).cast("double"))
    score = settings.mad_scale * (value - fact.quartiles[1]) / fact.mad if fact.mad else value * 0.0
    return df.withColumn(out, score)


def outlier_ranking(stats: DataFrame, method: str = "iqr", *, settings: Settings = DEFAULT) -> DataFrame:
    """Columns a method flags, by rate, with a band."""
    band = banded(F.col("rate"), [(settings.outlier_moderate, "warning"), (settings.outlier_high, "danger")], "normal")
    return (stats.where((F.col("method") == method) & F.col("available") & (F.col("count") > 0))
            .select("position", "column", "count", (F.col("rate") * 100).alias("rate_pct"), band.alias("band"))
            .orderBy(F.desc("rate_pct"), "position"))
