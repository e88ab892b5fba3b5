"""Outliers, and anomaly steps that SQL can check."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscope.catalog import query, rnd, rounded, table, union_all
from tabscope.catalog.derived import CODED_EVENTS, derived, sql
from tabscope.operators import anomalies, outliers
from tabscope.settings import SENTINELS

EVENTS = f"e AS ({sql('events', CODED_EVENTS)})"
COLUMNS = ["reading", "spend", "value"]


def coded(spark, folder):
    return derived(spark, folder, "events", CODED_EVENTS)


def rule_table(c: str, source: str = "e") -> str:
    """Per column: quartiles, mean, deviation, median and MAD."""
    return f"""SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3, avg({c}) AS mean,
  stddev_pop({c}) AS sd, quantile_cont({c}::DOUBLE, 0.5) AS med, mad({c}::DOUBLE) AS mad FROM {source}"""


HITS = {
    "iqr": "{c} < CASE WHEN q1 = q3 THEN q1 ELSE q1 - 1.5 * (q3 - q1) END OR {c} > CASE WHEN q1 = q3 THEN q1 ELSE q3 + 1.5 * (q3 - q1) END",
    "iqr_extreme": "{c} < CASE WHEN q1 = q3 THEN q1 ELSE q1 - 3 * (q3 - q1) END OR {c} > CASE WHEN q1 = q3 THEN q1 ELSE q3 + 3 * (q3 - q1) END",
    "zscore": "abs(({c} - mean) / sd) > 3",
    "modified_zscore": "mad <> 0 AND abs(0.6745 * ({c} - med) / mad) > 3.5",
}
BOUNDS = {
    "iqr": ("CASE WHEN q1 = q3 THEN q1 ELSE q1 - 1.5 * (q3 - q1) END", "CASE WHEN q1 = q3 THEN q1 ELSE q3 + 1.5 * (q3 - q1) END", "1.5"),
    "iqr_extreme": ("CASE WHEN q1 = q3 THEN q1 ELSE q1 - 3 * (q3 - q1) END", "CASE WHEN q1 = q3 THEN q1 ELSE q3 + 3 * (q3 - q1) END", "3.0"),
    "zscore": ("mean - 3 * sd", "mean + 3 * sd", "3.0"),
    "modified_zscore": ("CASE WHEN mad <> 0 THEN med - 3.5 * mad / 0.6745 END", "CASE WHEN mad <> 0 THEN med + 3.5 * mad / 0.6745 END",
                        "CASE WHEN mad <> 0 THEN 3.5 END"),
}


def stats_sql(source: str = "e", columns=COLUMNS) -> str:
    parts = []
    for i, c in enumerate(columns):
        for m in HITS:
            low, high, k = BOUNDS[m]
            ok = "any_value(mad) <> 0" if m == "modified_zscore" else "true"
            n = f"count(*) FILTER (WHERE {HITS[m].format(c=c)})"
            parts.append(f"""
SELECT {i}::BIGINT AS position, '{c}' AS "column", '{m}' AS method, {n} AS count,
  CASE WHEN {ok} THEN {n} / count({c}) ELSE 0 END::DOUBLE AS rate, CASE WHEN {ok} THEN count({c}) ELSE 0 END::BIGINT AS n_usable,
  any_value({low})::DOUBLE AS lower_bound, any_value({high})::DOUBLE AS upper_bound, any_value({k})::DOUBLE AS threshold,
  {ok} AS available, CASE WHEN {ok} THEN '' ELSE 'median absolute deviation is zero' END AS reason
FROM {source}, ({rule_table(c, source)}) r""")
    return union_all(parts)


def rounded_stats(name: str) -> str:
    return f"""SELECT position, "column", method, count, {rnd('rate')} AS rate, n_usable, {rnd('lower_bound', 4)} AS lower_bound,
{rnd('upper_bound', 4)} AS upper_bound, {rnd('threshold', 4)} AS threshold, available, reason FROM {name}"""


@query("outlier_stats", f"WITH {EVENTS}, s AS ({stats_sql()}) {rounded_stats('s')}")
def outlier_stats(spark, folder):
    return rounded(outliers.outlier_stats(coded(spark, folder), COLUMNS), 4, rate=6)


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("outlier_stats_lineitem", f"WITH s AS ({stats_sql('lineitem', _LINE)}) {rounded_stats('s')}")
def outlier_stats_lineitem(spark, folder):
    return rounded(outliers.outlier_stats(table(spark, folder, "lineitem"), _LINE), 4, rate=6)


def _any_flag(c, alias):
    return " OR ".join("(" + h.format(c=c).replace("q1", f"{alias}.q1").replace("q3", f"{alias}.q3").replace("mean", f"{alias}.mean")
                       .replace("sd", f"{alias}.sd").replace("med", f"{alias}.med").replace("mad ", f"{alias}.mad ")
                       .replace("/ mad)", f"/ {alias}.mad)") + ")" for h in HITS.values())


@query("rows_flagged", f"""
WITH {EVENTS}, a AS ({rule_table('reading')}), b AS ({rule_table('spend')}), c AS ({rule_table('value')}), s AS ({stats_sql()})
SELECT count(*) AS rows_flagged, (SELECT count(*) FROM s WHERE method = 'iqr' AND count > 0) AS columns_flagged
FROM e, a, b, c WHERE {_any_flag('reading', 'a')} OR {_any_flag('spend', 'b')} OR {_any_flag('value', 'c')}""")
def rows_flagged(spark, folder):
    return outliers.rows_flagged(coded(spark, folder), COLUMNS)


@query("flagged_rows", f"""
WITH {EVENTS}, r AS ({rule_table('value')})
SELECT event_id, {rnd('value')} AS value, concat_ws(',', CASE WHEN {HITS['iqr'].format(c='value')} THEN 'iqr' END,
  CASE WHEN {HITS['iqr_extreme'].format(c='value')} THEN 'iqr_extreme' END, CASE WHEN {HITS['zscore'].format(c='value')} THEN 'zscore' END,
  CASE WHEN {HITS['modified_zscore'].format(c='value')} THEN 'modified_zscore' END) AS methods
FROM e, r WHERE {' OR '.join(f"({h.format(c='value')})" for h in HITS.values())}""")
def flagged_rows(spark, folder):
    rows = outliers.flagged_rows(coded(spark, folder), ["value"])
    return rounded(rows.select("event_id", "value", F.array_join(F.col("flags.method"), ",").alias("methods")))


@query("outlier_examples", f"""
WITH {EVENTS}, r AS ({rule_table('value')})
SELECT event_id, user_id, event_type, {rnd('reading')} AS reading, {rnd('spend')} AS spend, {rnd('value')} AS value FROM e, r
WHERE {HITS['iqr'].format(c='value')} ORDER BY abs(value) DESC, value, event_id LIMIT 10""")
def outlier_examples(spark, folder):
    return rounded(outliers.outlier_examples(coded(spark, folder), "value"))


@query("method_disagreement", f"""
WITH {EVENTS}, s AS ({stats_sql()}), p AS (
  SELECT position, "column", coalesce(max(count) FILTER (WHERE method = 'iqr'), 0) AS a,
         coalesce(max(count) FILTER (WHERE method = 'zscore'), 0) AS z FROM s WHERE available GROUP BY ALL)
SELECT position, "column", a AS iqr_count, z AS zscore_count FROM p WHERE greatest(a, z) > 0 AND abs(a - z) / greatest(a, z) >= 0.5""")
def method_disagreement(spark, folder):
    return rounded(outliers.method_disagreement(outliers.outlier_stats(coded(spark, folder), COLUMNS)))


_CODES = f"(VALUES {', '.join(f'({c})' for c in SENTINELS)}) AS c(code)"


@query("sentinel_suspects", f"WITH {EVENTS}, s AS (" + union_all(f"""
SELECT {i}::BIGINT AS position, '{c}' AS "column", code::DOUBLE AS code,
  count(*) FILTER (WHERE abs({c} - code) <= 1e-8 + 1e-5 * abs(code)) AS matches, count(*) AS outliers
FROM e, ({rule_table(c)}) r, {_CODES} WHERE {HITS['iqr'].format(c=c)} GROUP BY code""" for i, c in enumerate(COLUMNS)) + """)
SELECT * FROM s WHERE matches >= 1 AND matches / outliers >= 0.25""")
def sentinel_suspects(spark, folder):
    return rounded(outliers.sentinel_suspects(coded(spark, folder), COLUMNS))


@query("modified_zscore", f"""
WITH r AS ({rule_table('value', 'events')})
SELECT event_id, {rnd('0.6745 * (value - med) / mad')} AS modified_zscore FROM events, r""")
def modified_zscore(spark, folder):
    df = table(spark, folder, "events").select("event_id", "value")
    return rounded(outliers.with_modified_zscore(df, "value").drop("value"))


@query("outlier_ranking", f"""
WITH {EVENTS}, s AS ({stats_sql()})
SELECT position, "column", count, {rnd('rate * 100')} AS rate_pct,
  CASE WHEN rate >= 0.15 THEN 'danger' WHEN rate >= 0.05 THEN 'warning' ELSE 'normal' END AS band
FROM s WHERE method = 'iqr' AND available AND count > 0""")
def outlier_ranking(spark, folder):
    return rounded(outliers.outlier_ranking(outliers.outlier_stats(coded(spark, folder), COLUMNS)))


# ---- anomalies -----------------------------------------------------------------

FOREST_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]
_GAPS = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "nullif(l_discount, 0.0) as l_discount", "l_tax"]


def _scaled(c):
    return f"(coalesce({c}, m_{c}) - avg(coalesce({c}, m_{c})) OVER ()) / stddev_pop(coalesce({c}, m_{c})) OVER ()"


@query("standardised_features", f"""
WITH d AS ({sql('lineitem', _GAPS)}), m AS (SELECT {', '.join(f'quantile_cont({c}::DOUBLE, 0.5) AS m_{c}' for c in FOREST_COLUMNS)} FROM d)
SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber, {', '.join(f'{rnd(_scaled(c))} AS {c}' for c in FOREST_COLUMNS)} FROM d, m""")
def standardised_features(spark, folder):
    df = derived(spark, folder, "lineitem", _GAPS)
    return rounded(anomalies.standardised(df, FOREST_COLUMNS, id_columns=["l_orderkey", "l_partkey", "l_linenumber"]))


@query("percentile_rank", f"""
WITH v AS (SELECT o_orderkey, o_totalprice, rank() OVER (ORDER BY o_totalprice) AS k, count(*) OVER (PARTITION BY o_totalprice) AS same,
  count(*) OVER () AS n FROM orders)
SELECT o_orderkey, {rnd('(k + (same - 1) / 2) / n * 100')} AS percentile FROM v""")
def percentile_rank(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return rounded(anomalies.with_percentile_rank(df, "o_totalprice", "percentile").drop("o_totalprice"))


@query("feature_deviations", union_all(f"""
SELECT '{c}' AS feature, {rnd(f'avg(abs(0.6745 * ({c} - med) / mad))')} AS mean_robust_z, {rnd(f'max(abs(0.6745 * ({c} - med) / mad))')} AS max_abs_robust_z
FROM lineitem, ({rule_table(c, 'lineitem')}) r WHERE l_extendedprice > 100000""" for c in FOREST_COLUMNS))
def feature_deviations(spark, folder):
    df = table(spark, folder, "lineitem").withColumn("is_anomaly", F.col("l_extendedprice") > 100000)
    return rounded(anomalies.feature_deviations(df, FOREST_COLUMNS))


def _detect(spark, folder, **options):
    return anomalies.detect_anomalies(table(spark, folder, "lineitem"), FOREST_COLUMNS, id_columns=LINE_KEY, **options)


@query("anomaly_summary")
def anomaly_summary(spark, folder):
    """Random trees have no SQL counterpart; tests check them by planted points."""
    return anomalies.anomaly_summary(_detect(spark, folder, with_percentile=False), spark)


@query("anomaly_checks", f"""SELECT true AS available, 0.05::DOUBLE AS contamination, count(*) AS n_rows_scored, count(*) AS n_records, true AS labels_fit,
  0::BIGINT AS n_without_percentile, count(*) AS histogram_total, '{','.join(FOREST_COLUMNS)}' AS features FROM lineitem""")
def anomaly_checks(spark, folder):
    """What SQL can know of a forest: rows scored and kept, labels within one of the contamination, totals, features."""
    found = _detect(spark, folder)
    summary = anomalies.anomaly_summary(found, spark)
    fits = F.abs(F.col("n_anomalies") - F.col("contamination") * F.col("n_rows_scored")) <= 1 + 1e-9
    kept = found.records.agg(F.count("*").alias("n_records"), F.count_if(F.col("anomaly_percentile").isNull()).alias("n_without_percentile"))
    total = anomalies.score_distribution(found.records).agg(F.sum("n").alias("histogram_total"))
    return rounded(summary.crossJoin(F.broadcast(kept)).crossJoin(F.broadcast(total)).select(  # one row each
        "available", "contamination", "n_rows_scored", "n_records", fits.alias("labels_fit"), "n_without_percentile", "histogram_total",
        F.array_join("features_used", ",").alias("features")))


@query("anomaly_record_rows", f"SELECT {', '.join(LINE_KEY)} FROM lineitem")
def anomaly_record_rows(spark, folder):
    return _detect(spark, folder, with_percentile=False).records.select(*LINE_KEY)


@query("anomaly_gates", "SELECT column0 AS name, false AS available, 0::BIGINT AS n_rows_scored FROM (VALUES ('one feature'), ('few rows')) v(column0)")
def anomaly_gates(spark, folder):
    """Tables that are not suitable give a reason instead of scores."""
    df = table(spark, folder, "lineitem")
    results = {"one feature": anomalies.detect_anomalies(df, ["l_tax"]), "few rows": anomalies.detect_anomalies(table(spark, folder, "region"))}
    rows = [anomalies.anomaly_summary(r, spark).select(F.lit(n).alias("name"), "available", "n_rows_scored") for n, r in results.items()]
    return rows[0].unionByName(rows[1])


@query("anomaly_records")
def anomaly_records(spark, folder):
    return _detect(spark, folder).records


@query("anomaly_examples")
def anomaly_examples(spark, folder):
    return anomalies.anomaly_examples(_detect(spark, folder, with_percentile=False).records)


@query("anomaly_score_distribution")
def anomaly_score_distribution(spark, folder):
    return anomalies.score_distribution(_detect(spark, folder, with_percentile=False).records)
