"""The whole investigation of one table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tabscope.functions.columns import fields, without_nan
from tabscope.operators import (
    anomalies, association, categorical, correlation, findings, health, leakage, numeric, outliers, profile, quality,
)
from tabscope.plans.counts import distinct_counts, value_counts
from tabscope.plans.facts import number_facts
from tabscope.plans.stored import fixed, stored, together
from tabscope.settings import Options


@dataclass
class Investigation:
    """Result tables by name; all but ``anomaly_records`` are small."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def investigate(df: DataFrame, options: Options | None = None) -> Investigation:
    """Run every analysis.

    The table is read by a fixed number of scans that return one row each (text probe,
    moments, quantiles, outlier counts, pair statistics), by one shuffle of value counts
    that serves everything about distinct values, and by one for duplicate rows.  The value
    counts are written out once; small result tables are held, so that findings and health
    do not compute them again.
    """
    o = options or Options()
    s = o.settings
    if o.store_input:
        df = stored(df, "input")
    spark = df.sparkSession

    # structure; what follows reads the counts many times
    first = together(counts=lambda: stored(value_counts(df), "value_counts"), probe=lambda: fixed(profile.text_probe(df)))
    counts, probe = first["counts"], first["probe"]
    distinct = fixed(distinct_counts(counts))
    roles = fixed(profile.column_roles(df, settings=s, probe=probe, distinct=distinct))
    by_role: dict[str, list[str]] = {}
    for r in roles.orderBy("position").collect():  # one row per column
        by_role.setdefault(r["role"], []).append(r["column"])
    number_columns = by_role.get("numeric", [])
    texts = set(by_role.get("categorical", []) + by_role.get("text-like", []))
    label_columns = [c for c in df.columns if c in texts] + by_role.get("boolean", [])
    t: dict[str, DataFrame] = {"roles": roles}

    # quality, and what the numbers need
    second = together(
        duplicate_summary=lambda: fixed(quality.duplicate_summary(without_nan(df), settings=s)),
        column_profile=lambda: fixed(profile.column_profile(df, settings=s, counts=counts, roles=roles)).orderBy("position"),
        missing_columns=lambda: fixed(quality.missing_columns(df, settings=s)),
        missing_summary=lambda: fixed(quality.missing_summary(df)),
        low_variance=lambda: fixed(quality.low_variance(df, settings=s, counts=counts)),
        dtype_issues=lambda: fixed(profile.dtype_issues(df, settings=s, probe=probe, counts=counts)),
        facts=lambda: number_facts(df, number_columns, settings=s))
    facts = second.pop("facts")
    t |= second
    duplicates = t["duplicate_summary"]
    rules = outliers.outlier_rules(df, number_columns, settings=s, modified=o.include_modified_zscore, facts=facts)

    def numbers() -> dict[str, DataFrame]:
        stats = fixed(numeric.numeric_stats(df, number_columns, settings=s, facts=facts, counts=counts)
                      if number_columns else spark.createDataFrame([], numeric.NUMERIC_SCHEMA))
        whole = profile.integer_valued(df, number_columns) if number_columns else None
        return {"numeric_stats": stats, "numeric_flags": fixed(numeric.numeric_flags(stats, whole, settings=s)),
                "scale_spread": numeric.scale_spread(stats, settings=s)}

    def forest() -> dict[str, DataFrame]:
        if o.enable_anomalies:
            found = anomalies.detect_anomalies(df, number_columns, contamination=o.contamination, trees=o.trees,
                                               id_columns=o.id_columns, with_percentile=False, settings=s, facts=facts)
        else:
            found = anomalies.AnomalyResult(False, "Anomaly detection was switched off.", o.contamination, [])
        out = {"anomaly_summary": fixed(anomalies.anomaly_summary(found, spark))}
        if found.available:
            out["anomaly_records"] = anomalies.with_percentile_rank(
                found.records, "anomaly_score", "anomaly_percentile", settings=s)
            out["feature_deviations"] = fixed(anomalies.feature_deviations(
                found.records, found.features, settings=s, facts=facts))
        return out

    def leaks() -> dict[str, DataFrame]:
        if not o.enable_leakage:
            return {}
        named = fixed(leakage.column_facts(df, settings=s, roles=roles, probe=probe, distinct=distinct))
        out = {"leakage_signals": fixed(leakage.leakage_signals(df, o.leakage_target, settings=s, facts=named))}
        target = leakage.chosen_target(out["leakage_signals"]) if o.leakage_target is None else o.leakage_target
        if target in df.columns:
            out["separation_levels"] = fixed(leakage.separation_levels(df, target, settings=s))
        return out

    eligible = correlation.eligible_columns(df, number_columns, facts=facts)
    third = together(
        numbers=numbers, forest=forest, leaks=leaks,
        overview=lambda: fixed(profile.overview(df, settings=s, profile=t["column_profile"], duplicates=duplicates)),
        categorical_stats=lambda: fixed(
            categorical.categorical_stats(df, label_columns, settings=s, counts=counts) if label_columns else
            categorical.categorical_stats(df, [], settings=s, counts=counts).where("false")),
        outlier_stats=lambda: fixed(outliers.outlier_stats(df, settings=s, rules=rules)),
        rows_flagged=lambda: fixed(outliers.rows_flagged(df, rules=rules, settings=s)),
        sentinels=lambda: fixed(outliers.sentinel_suspects(df, settings=s, rules=rules)),
        correlation_pairs=lambda: fixed(correlation.correlation_pairs(
            df, method=o.correlation_method, settings=s, eligible=eligible)),
        association_levels=lambda: fixed(association.association_levels(df, label_columns, settings=s, counts=counts) if label_columns else
                                         spark.createDataFrame([], association.SKIPPED_SCHEMA)),
        associations=lambda: fixed(association.associations(df, label_columns, settings=s, counts=counts) if label_columns else
                                   spark.createDataFrame([], association.ASSOCIATION_SCHEMA)))
    for part in ("numbers", "forest", "leaks"):
        t |= third.pop(part)
    t |= third
    t["method_disagreement"] = outliers.method_disagreement(t["outlier_stats"], settings=s)
    deviations = t.get("feature_deviations")

    # health
    n_columns = len(df.columns)
    cells = t["numeric_stats"].agg(F.coalesce(F.sum("count"), F.lit(0)).alias("numeric_cells"))
    inputs = health.health_inputs(t["missing_summary"], t["missing_columns"], duplicates, t["low_variance"],
                                  t["dtype_issues"], t["outlier_stats"], cells, n_columns, settings=s)
    t["health_components"] = fixed(health.health_components(inputs, settings=s))
    t["health_score"] = health.health_score(t["health_components"])

    # findings
    parts = [
        findings.missing_findings(t["missing_summary"], t["missing_columns"], settings=s),
        findings.duplicate_findings(duplicates, settings=s),
        findings.variance_findings(t["low_variance"], n_columns, settings=s),
        findings.dtype_findings(t["dtype_issues"]),
        findings.numeric_findings(t["numeric_stats"], t["numeric_flags"], t["scale_spread"], settings=s),
        findings.categorical_findings(t["categorical_stats"], settings=s),
        findings.outlier_findings(t["outlier_stats"], t["rows_flagged"], t["method_disagreement"], t["sentinels"], settings=s),
        findings.correlation_findings(t["correlation_pairs"], len(eligible), o.correlation_method, settings=s),
        findings.association_findings(t["associations"], settings=s),
        findings.anomaly_findings(t["anomaly_summary"], deviations, settings=s),
    ]
    if o.enable_leakage:
        parts.append(findings.leakage_findings(t["leakage_signals"]))
    parts.append(findings.left_out_findings(t["association_levels"], t.get("separation_levels")))
    t["findings"] = fixed(findings.sort_findings(parts))
    n_rows = t["overview"].first()["n_rows"]
    t["recommendations"] = findings.recommendations(t["findings"], n_rows, n_columns, settings=s)
    t["executive_summary"] = findings.executive_summary(t["findings"], settings=s)
    t["severity_counts"] = findings.severity_counts(t["findings"])
    return Investigation(t)
