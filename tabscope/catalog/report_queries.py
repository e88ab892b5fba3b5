"""Health score, findings, whole investigation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscope.catalog import query, rnd, rounded, table, union_all
from tabscope.catalog.cleaning_queries import MARKER  # noqa: F401
from tabscope.catalog.derived import derived, sql
from tabscope.catalog.outlier_queries import rule_table, HITS
from tabscope.operators import (
    association, categorical, correlation, findings, health, investigate, numeric, outliers, profile, quality,
)
from tabscope.settings import Options

# events without their key, so that rows repeat; gaps, a constant, number text, extremes
MESSY = [
    "event_type", "case when value < 3 then null else user_id end as user_id",
    "case when value > 30 then cast(floor(value / 10) * 10 as double) end as level",
    "concat('$', cast(cast(floor(value / 50) as int) as varchar(9))) as amount", "'v1' as version",
    "case when value > 300 then 'rare' else 'usual' end as kind",
]
COLUMNS = ["event_type", "user_id", "level", "amount", "version", "kind"]
NUMBERS = ["user_id", "level"]
WITH = f"WITH m AS ({sql('events', MESSY)})"


def messy(spark, folder):
    return derived(spark, folder, "events", MESSY)


def _nested(parts):
    return " + ".join(f"({p})" for p in parts)


INPUTS = f"""a AS (SELECT count(*) AS n, {_nested(f'count(*) - count({c})' for c in COLUMNS)} AS gaps,
  {_nested(f'CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END' for c in COLUMNS)} AS gap_columns,
  {_nested(f'CASE WHEN count(*) - count({c}) >= 0.5 * count(*) THEN 1 ELSE 0 END' for c in COLUMNS)} AS sparse,
  {_nested(f'count({c})' for c in NUMBERS)} AS cells,
  {_nested(f'CASE WHEN count(DISTINCT {c}) <= 1 THEN 1 ELSE 0 END' for c in COLUMNS)} AS constant FROM m),
near AS (SELECT count(*) AS near FROM ({union_all(
    f"SELECT max(k) / sum(k) AS share, count(*) AS levels FROM (SELECT count(*) AS k FROM m WHERE {c} IS NOT NULL GROUP BY {c}) x" for c in COLUMNS)}) y
  WHERE levels > 1 AND share >= 0.99),
dup AS (SELECT sum(k - 1)::BIGINT AS dup, count(*) FILTER (WHERE k > 1) AS groups FROM (SELECT count(*) AS k FROM m GROUP BY {', '.join(COLUMNS)}) x),
out AS (SELECT sum(hits)::BIGINT AS hits, count(*) FILTER (WHERE hits > 0) AS hit_columns FROM ({union_all(
    f"SELECT count(*) FILTER (WHERE {HITS['iqr'].format(c=c)}) AS hits FROM m, ({rule_table(c, 'm')}) r" for c in NUMBERS)}) x),
typ AS (SELECT CASE WHEN count(*) FILTER (WHERE regexp_matches(amount, '^\\$[0-9]+$')) >= 0.9 * count(amount) THEN 1 ELSE 0 END AS issues FROM m),
c AS (SELECT greatest(0, 100 * (1 - least(1, gaps / (n * 6) / 0.25)) - 5 * sparse) AS s1,
  100 * (1 - least(1, hits / cells / 0.05)) AS s2, 100 * (1 - issues / 6) AS s3, 100 * (1 - least(1, dup / n / 0.1)) AS s4,
  100 * (1 - least(1, (constant + 0.5 * near) / 6)) AS s5 FROM a, near, dup, out, typ)"""
COMPONENTS = union_all(f"SELECT {i}::BIGINT AS position, '{k}' AS key, {rnd(f's{i + 1}', 1)} AS score, {w}::DOUBLE AS weight, "
                       f"{rnd(f's{i + 1} * {w}', 2)} AS weighted_score FROM c"
                       for i, (k, w) in enumerate((("completeness", 0.3), ("integrity", 0.2), ("consistency", 0.2),
                                                   ("uniqueness", 0.15), ("variability", 0.15))))


def _parts(df):
    """The metric tables of a messy table, each computed once per query."""
    stats = numeric.numeric_stats(df)
    return dict(
        missing=quality.missing_summary(df), by_column=quality.missing_columns(df), duplicates=quality.duplicate_summary(df),
        low=quality.low_variance(df), issues=profile.dtype_issues(df), stats=stats,
        outliers=outliers.outlier_stats(df), cells=stats.agg(F.sum("count").alias("numeric_cells")))


def _components(df):
    p = _parts(df)
    inputs = health.health_inputs(p["missing"], p["by_column"], p["duplicates"], p["low"], p["issues"], p["outliers"],
                                  p["cells"], len(df.columns))
    return health.health_components(inputs)


@query("health_components", f"{WITH}, {INPUTS} {COMPONENTS}")
def health_components(spark, folder):
    return rounded(_components(messy(spark, folder)).select("position", "key", "score", "weight", "weighted_score"))


@query("health_score", f"""{WITH}, {INPUTS}, p AS ({COMPONENTS}), t AS (SELECT {rnd('sum(weighted_score)', 1)} AS score FROM p)
SELECT score, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Fair' WHEN score >= 40 THEN 'Poor' ELSE 'Critical' END AS grade,
  (SELECT upper(key[1]) || key[2:] FROM p ORDER BY score, position LIMIT 1) AS weakest,
  (SELECT upper(key[1]) || key[2:] FROM p ORDER BY score DESC, position LIMIT 1) AS strongest FROM t""")
def health_score(spark, folder):
    return rounded(health.health_score(_components(messy(spark, folder))).select("score", "grade", "weakest", "strongest"))


SEVERITY = "CASE WHEN {0} >= 0.8 THEN 'critical' WHEN {0} >= 0.5 THEN 'high' WHEN {0} >= 0.2 THEN 'moderate' WHEN {0} >= 0.05 THEN 'low' ELSE 'info' END"
MISSING = f"""SELECT 'missing_data' AS category, format('{{:,}}', gaps) || ' missing values in ' || gap_columns || ' column(s)' AS title,
  {SEVERITY.format('(gaps / (n * 6))')} AS severity FROM a
UNION ALL """ + union_all(f"""SELECT 'missing_data', 'Column {c} is ' || printf('%.1f%%', 100 * rate) || ' empty', {SEVERITY.format('rate')}
  FROM (SELECT (count(*) - count({c})) / count(*) AS rate FROM m) x WHERE rate >= 0.2""" for c in COLUMNS)
DUPLICATE = """SELECT 'duplicates' AS category, format('{:,}', dup) || ' duplicate row(s), ' || printf('%.1f%%', 100 * dup / n) AS title,
  CASE WHEN dup / n >= 0.05 THEN 'high' WHEN dup / n >= 0.01 THEN 'moderate' WHEN dup / n >= 0.001 THEN 'low' ELSE 'info' END AS severity FROM a, dup"""
VARIANCE = """SELECT 'low_variance' AS category, constant || ' constant column(s)' AS title, 'moderate' AS severity FROM a WHERE constant > 0
UNION ALL SELECT 'low_variance', near || ' near-constant column(s)', 'low' FROM near WHERE near > 0
UNION ALL SELECT 'low_variance', printf('%.1f%%', 100 * (constant + near) / 6) || ' of the columns hardly vary', 'high' FROM a, near
  WHERE (constant + near) / 6 >= 0.25"""
DTYPE = "SELECT 'dtypes' AS category, 'Numbers kept as text: 1 column(s)' AS title, 'high' AS severity FROM typ WHERE issues = 1"


def _short(df):
    return df.select("category", "title", "severity")


@query("findings_missing", f"{WITH}, {INPUTS} {MISSING}")
def findings_missing(spark, folder):
    df = messy(spark, folder)
    return _short(findings.missing_findings(quality.missing_summary(df), quality.missing_columns(df)))


@query("findings_duplicates", f"{WITH}, {INPUTS} {DUPLICATE}")
def findings_duplicates(spark, folder):
    return _short(findings.duplicate_findings(quality.duplicate_summary(messy(spark, folder))))


@query("findings_low_variance", f"{WITH}, {INPUTS} {VARIANCE}")
def findings_low_variance(spark, folder):
    df = messy(spark, folder)
    return _short(findings.variance_findings(quality.low_variance(df), len(df.columns)))


@query("findings_dtypes", f"{WITH}, {INPUTS} {DTYPE}")
def findings_dtypes(spark, folder):
    return _short(findings.dtype_findings(profile.dtype_issues(messy(spark, folder))))


_NUM = union_all(f"""SELECT '{c}' AS name, count({c}) AS n, count(DISTINCT {c}) AS u, skewness({c}) AS sk, kurtosis({c}) AS ku,
  count(*) FILTER (WHERE {c} = 0) / count({c}) AS z, greatest(abs(min({c})), abs(max({c}))) AS size FROM events_x"""
                 for c in ("user_id", "value", "spend", "flag", "small"))
_EVENTS_X = ["user_id", "value", "case when value < 30 then 0.0 else value end as spend",
             "case when value > 100 then 1 else 0 end as flag", "value / 100000 as small"]


@query("findings_numeric", f"""WITH events_x AS ({sql('events', _EVENTS_X)}), s AS ({_NUM}), t AS (SELECT count(*) AS k FROM s)
SELECT 'numerical' AS category, count(*) || ' clearly skewed column(s)' AS title,
  CASE WHEN count(*) > any_value(k) / 3 THEN 'moderate' ELSE 'low' END AS severity FROM s, t WHERE abs(sk) >= 1 HAVING count(*) > 0
UNION ALL SELECT 'numerical', count(*) || ' column(s) with heavy tails', 'low' FROM s WHERE ku >= 3 HAVING count(*) > 0
UNION ALL SELECT 'numerical', count(*) || ' column(s) with many zeros', 'low' FROM s WHERE z >= 0.3 AND u > 2 HAVING count(*) > 0
UNION ALL SELECT 'numerical', 'Columns of very different magnitude', 'low' FROM s HAVING max(size) / min(size) >= 10000
UNION ALL SELECT 'numerical', count(*) || ' two-valued numeric column(s)', 'info' FROM s WHERE u = 2 HAVING count(*) > 0""")
def findings_numeric(spark, folder):
    df = derived(spark, folder, "events", _EVENTS_X)
    stats = numeric.numeric_stats(df)
    flags = numeric.numeric_flags(stats, profile.integer_valued(df))
    return _short(findings.numeric_findings(stats, flags, numeric.scale_spread(stats)))


_CATS = ["p_name", "p_brand", "p_type", "case when p_size > 1 then 'usual' else 'tiny' end as kind"]
_CAT_STATS = union_all(f"""SELECT '{c}' AS name, count(*) AS u, sum(n) AS n, max(n) / sum(n) AS top, count(*) FILTER (WHERE n / t < 0.01) AS rare
  FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM p WHERE {c} IS NOT NULL GROUP BY {c}) x""" for c in ("p_name", "p_brand", "p_type", "kind"))


@query("findings_categorical", f"""WITH p AS ({sql('part', _CATS)}), s AS ({_CAT_STATS})
SELECT 'categorical' AS category, count(*) || ' column(s) ruled by one value' AS title, CASE WHEN max(top) >= 0.98 THEN 'high' ELSE 'moderate' END AS severity
  FROM s WHERE top >= 0.9 AND u > 1 HAVING count(*) > 0
UNION ALL SELECT 'categorical', count(*) || ' column(s) with very many levels', 'moderate' FROM s WHERE (u >= 50 OR u / n >= 0.5) AND u > 1 HAVING count(*) > 0
UNION ALL SELECT 'categorical', count(*) || ' column(s) with many rare levels', 'low' FROM s WHERE rare >= greatest(5, 0.3 * u) HAVING count(*) > 0""")
def findings_categorical(spark, folder):
    return _short(findings.categorical_findings(categorical.categorical_stats(derived(spark, folder, "part", _CATS))))


_OUT = ["case when value < 5 then -999.0 else value end as reading", "value", "case when value > 100 then 1 else 0 end as flag"]
_OUT_STATS = union_all(f"""SELECT '{c}' AS name, count(*) FILTER (WHERE {HITS['iqr'].format(c=c)}) AS iqr, count(*) FILTER (WHERE {HITS['zscore'].format(c=c)}) AS z,
  count({c}) AS n, count(*) FILTER (WHERE ({HITS['iqr'].format(c=c)}) AND {c} = -999.0) AS code FROM x, ({rule_table(c, 'x')}) r""" for c in ("reading", "value"))


@query("findings_outliers", f"""WITH x AS ({sql('events', _OUT)}), s AS ({_OUT_STATS})
SELECT 'outliers' AS category, count(*) || ' column(s) with values beyond the IQR fences' AS title,
  CASE WHEN max(iqr / n) >= 0.15 THEN 'high' WHEN max(iqr / n) >= 0.05 THEN 'moderate' ELSE 'low' END AS severity FROM s WHERE iqr > 0 HAVING count(*) > 0
UNION ALL SELECT 'outliers', count(*) || ' column(s) where IQR and z-score disagree', 'low' FROM s WHERE abs(iqr - z) / greatest(iqr, z, 1) >= 0.5 HAVING count(*) > 0
UNION ALL SELECT 'outliers', '1 column(s) not tested for outliers', 'info'
UNION ALL SELECT 'outliers', 'Placeholder codes suspected', 'moderate' FROM s WHERE code / greatest(iqr, 1) >= 0.25 HAVING count(*) > 0""")
def findings_outliers(spark, folder):
    df = derived(spark, folder, "events", _OUT)
    stats = outliers.outlier_stats(df)
    return _short(findings.outlier_findings(stats, outliers.rows_flagged(df), outliers.method_disagreement(stats),
                                            outliers.sentinel_suspects(df)))


_REL = ["l_quantity", "l_quantity * 2 + 1 as double_quantity", "l_tax - l_quantity as less", "l_discount"]
_REL_PAIRS = union_all(f"SELECT corr({a}, {b}) AS r FROM d" for a, b in (
    ("l_quantity", "double_quantity"), ("l_quantity", "less"), ("l_quantity", "l_discount"), ("double_quantity", "less"),
    ("double_quantity", "l_discount"), ("less", "l_discount")))


@query("findings_correlations", f"""WITH d AS ({sql('lineitem', _REL)}), p AS ({_REL_PAIRS})
SELECT 'correlations' AS category, count(*) || ' pair(s) rise together' AS title, 'moderate' AS severity FROM p WHERE r >= 0.7 HAVING count(*) > 0
UNION ALL SELECT 'correlations', count(*) || ' pair(s) move against each other', 'moderate' FROM p WHERE r <= -0.7 HAVING count(*) > 0
UNION ALL SELECT 'correlations', count(*) || ' pair(s) of nearly equal columns', 'high' FROM p WHERE abs(r) >= 0.995 HAVING count(*) > 0""")
def findings_correlations(spark, folder):
    df = derived(spark, folder, "lineitem", _REL)
    return _short(findings.correlation_findings(correlation.correlation_pairs(df, with_p=False), 4, "pearson"))


_ASSOC = ["case when l_quantity > 25 then 'many' else 'few' end as amount", "case when l_quantity > 30 then 'bulk' else 'loose' end as size_class"]


@query("findings_associations", f"""WITH d AS ({sql('lineitem', _ASSOC)}), c AS (SELECT amount AS a, size_class AS b, count(*)::DOUBLE AS n FROM d GROUP BY 1, 2),
v AS (SELECT any_value(t) AS t, any_value(t) * (sum(n * n / (ra * cb)) - 1) / any_value(t) AS phi2 FROM (
  SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY a) AS ra, sum(n) OVER (PARTITION BY b) AS cb FROM c) x),
w AS (SELECT sqrt(greatest(0, phi2 - 1 / (t - 1)) / (1 - 1 / (t - 1))) AS v FROM v)
SELECT 'associations' AS category, '1 strongly associated categorical pair(s)' AS title, CASE WHEN v >= 0.7 THEN 'moderate' ELSE 'low' END AS severity FROM w WHERE v >= 0.5""")
def findings_associations(spark, folder):
    return _short(findings.association_findings(association.associations(derived(spark, folder, "lineitem", _ASSOC))))


ALL_QUALITY = f"{MISSING} UNION ALL {DUPLICATE} UNION ALL {VARIANCE} UNION ALL {DTYPE}"


def _quality_findings(spark, folder):
    df = messy(spark, folder)
    p = _parts(df)
    return findings.sort_findings([
        findings.missing_findings(p["missing"], p["by_column"]), findings.duplicate_findings(p["duplicates"]),
        findings.variance_findings(p["low"], len(df.columns)), findings.dtype_findings(p["issues"])])


@query("severity_counts", f"{WITH}, {INPUTS}, f AS ({ALL_QUALITY}) SELECT severity, count(*) AS n FROM f GROUP BY severity")
def severity_counts(spark, folder):
    return findings.severity_counts(_quality_findings(spark, folder)).select("severity", "n")


@query("serious_findings", f"{WITH}, {INPUTS}, f AS ({ALL_QUALITY}) SELECT category, title, severity FROM f WHERE severity IN ('high', 'critical')")
def serious_findings(spark, folder):
    return _short(findings.serious(_quality_findings(spark, folder)))


@query("executive_summary", f"{WITH}, {INPUTS}, f AS ({ALL_QUALITY}) SELECT '[' || upper(severity[1]) || severity[2:] || '] ' || title AS line FROM f WHERE severity <> 'info'")
def executive_summary(spark, folder):
    return findings.executive_summary(_quality_findings(spark, folder)).select("line")


@query("recommendations")
def recommendations(spark, folder):
    df = messy(spark, folder)
    return findings.recommendations(_quality_findings(spark, folder), df.count(), len(df.columns))


@query("investigation_findings")
def investigation_findings(spark, folder):
    """The whole run on the lineitem table, random forest included, so SQL can repeat only its parts."""
    found = investigate.investigate(table(spark, folder, "lineitem"), Options(id_columns=tuple(
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"])))
    return found["findings"]


@query("investigation_quality_findings", f"{WITH}, {INPUTS}, f AS ({ALL_QUALITY}) SELECT category, title, severity FROM f")
def investigation_quality_findings(spark, folder):
    """The findings on quality of a whole run without the forest."""
    found = investigate.investigate(messy(spark, folder), Options(enable_anomalies=False, enable_leakage=False))
    return _short(found["findings"].where(F.col("category").isin("missing_data", "duplicates", "low_variance", "dtypes")))


@query("findings_without_anomalies", "SELECT 'anomalies' AS category, 'No anomaly detection' AS title, 'info' AS severity, count(*) > 0 AS any_rows FROM region")
def findings_without_anomalies(spark, folder):
    """Too few rows for a forest are a finding of their own."""
    from tabscope.operators import anomalies
    df = table(spark, folder, "region")
    found = findings.anomaly_findings(anomalies.anomaly_summary(anomalies.detect_anomalies(df), spark), None)
    return _short(found).withColumn("any_rows", F.lit(df.count() > 0))


@query("investigation_health", f"{WITH}, {INPUTS}, p AS ({COMPONENTS}) SELECT {rnd('sum(weighted_score)', 1)} AS score FROM p")
def investigation_health(spark, folder):
    found = investigate.investigate(messy(spark, folder), Options(enable_anomalies=False, enable_leakage=False))
    return rounded(found["health_score"].select("score"))
