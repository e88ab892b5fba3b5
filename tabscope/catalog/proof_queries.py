"""Findings in full: their order, sentences, evidence and advice, and what is made of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscope.catalog import query, rnd, rounded, table, union_all
from tabscope.catalog.derived import derived, sql
from tabscope.catalog.leakage_queries import COPIES, FACTS, IDENTIFIER, OUTCOME, SEPARATION, WITH as WITH_ORDERS, labelled
from tabscope.catalog.report_queries import COLUMNS, INPUTS, SEVERITY, WITH, _quality_findings, messy
from tabscope.operators import anomalies, association, correlation, findings, leakage

# ---- quality, in order --------------------------------------------------------------

_TYPES = {"event_type": "string", "user_id": "bigint", "level": "double", "amount": "string", "version": "string", "kind": "string"}
_GAPS = union_all(f"SELECT {i} AS position, '{c}' AS name, '{_TYPES[c]}' AS kind, count(*) - count({c}) AS gaps, (count(*) - count({c})) / count(*) AS rate FROM m"
                  for i, c in enumerate(COLUMNS))
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in COLUMNS)
_CONSTANT = union_all(f"SELECT {i} AS position, '{c}' AS name, count(DISTINCT {c}) AS levels, (SELECT max(k) / sum(k) FROM (SELECT count(*) AS k FROM m WHERE {c} IS NOT NULL GROUP BY {c}) x) AS share FROM m"
                      for i, c in enumerate(COLUMNS))


def _named(where: str) -> str:
    return f"(SELECT string_agg('`' || name || '`', ', ' ORDER BY position) FROM flat WHERE {where})"


#: part, seq, category, title, detail, severity, recommendation; the sentence on number text is not repeated.
FULL = f"""gaps_of AS ({_GAPS}), flat AS ({_CONSTANT}), whole AS (SELECT count(*) FILTER ({_COMPLETE}) AS complete FROM m), ordered AS (
SELECT 0 AS part, 1 AS seq, 'missing_data' AS category, format('{{:,}}', gaps) || ' missing values in ' || gap_columns || ' column(s)' AS title,
  printf('%.1f%%', 100 * gaps / (n * 6)) || ' of all cells are empty; ' || format('{{:,}}', complete) || ' rows are complete.' AS detail,
  {SEVERITY.format('(gaps / (n * 6))')} AS severity, 'Find out why values are missing before replacing them.' AS recommendation FROM a, whole
UNION ALL SELECT 0, 2 + row_number() OVER (ORDER BY rate DESC, position), 'missing_data', 'Column ' || name || ' is ' || printf('%.1f%%', 100 * rate) || ' empty',
  format('{{:,}}', gaps) || ' values are missing (type ' || kind || ').', {SEVERITY.format('rate')},
  CASE WHEN rate >= 0.8 THEN 'Dropping the column may be better than filling it.' ELSE 'Check whether the gaps go with the outcome before filling them.' END
  FROM gaps_of WHERE rate >= 0.2
UNION ALL SELECT 1, 0, 'duplicates', format('{{:,}}', dup) || ' duplicate row(s), ' || printf('%.1f%%', 100 * dup / n),
  'They repeat earlier rows in every column and form ' || format('{{:,}}', groups) || ' group(s).',
  CASE WHEN dup / n >= 0.05 THEN 'high' WHEN dup / n >= 0.01 THEN 'moderate' WHEN dup / n >= 0.001 THEN 'low' ELSE 'info' END,
  'Keep true repeats, remove copies that an export or a join has made.' FROM a, dup
UNION ALL SELECT 2, 1, 'low_variance', constant || ' constant column(s)', {_named('levels <= 1')} || '.', 'moderate', 'Drop them before modelling.' FROM a WHERE constant > 0
UNION ALL SELECT 2, 2, 'low_variance', near || ' near-constant column(s)', {_named('levels > 1 AND share >= 0.99')} || '.', 'low',
  'Consider dropping them or merging their rare values.' FROM near WHERE near > 0
UNION ALL SELECT 2, 3, 'low_variance', printf('%.1f%%', 100 * (constant + near) / 6) || ' of the columns hardly vary',
  (constant + near) || ' of 6 columns; the extract may be filtered too narrowly.', 'high', 'Review how the table was extracted.' FROM a, near WHERE (constant + near) / 6 >= 0.25
UNION ALL SELECT 3, 0, 'dtypes', 'Numbers kept as text: 1 column(s)', NULL, 'high', 'Convert them so that they enter the statistics.' FROM typ WHERE issues = 1),
f AS (SELECT *, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS severity_rank FROM ordered),
placed AS (SELECT row_number() OVER (ORDER BY severity_rank DESC, part, seq, title) AS place, * FROM f)"""


def _quality(spark, folder):
    return _quality_findings(spark, folder)


def _without_dtype_detail(df):
    return df.withColumn("detail", F.when(F.col("category") != "dtypes", F.col("detail")))


@query("findings_in_order", f"{WITH}, {INPUTS}, {FULL} SELECT place::BIGINT AS place, category, title, detail, severity, severity_rank::BIGINT AS severity_rank, recommendation FROM placed")
def findings_in_order(spark, folder):
    """All findings on quality with their places, sentences and advice."""
    found = _without_dtype_detail(_quality(spark, folder))
    return rounded(found.select("place", "category", "title", "detail", "severity", "severity_rank", "recommendation"))


@query("findings_by_category", f"{WITH}, {INPUTS}, {FULL} SELECT place::BIGINT AS place, title, detail FROM placed WHERE category = 'missing_data'")
def findings_by_category(spark, folder):
    return rounded(findings.by_category(_quality(spark, folder), "missing_data").select("place", "title", "detail"))


@query("recommendations_in_order", f"""{WITH}, {INPUTS}, {FULL}, chosen AS (
  SELECT place, title || ': ' || recommendation AS recommendation FROM placed WHERE severity_rank >= 1
  QUALIFY row_number() OVER (PARTITION BY lower(trim(recommendation)) ORDER BY place) = 1 ORDER BY place LIMIT 8)
SELECT row_number() OVER (ORDER BY place)::BIGINT AS place, recommendation FROM chosen""")
def recommendations_in_order(spark, folder):
    """Advice of the worst findings, each piece once."""
    df = messy(spark, folder)
    return rounded(findings.recommendations(_quality(spark, folder), df.count(), len(df.columns)))


@query("findings_evidence", f"""{WITH}, {INPUTS}, whole AS (SELECT count(*) FILTER ({_COMPLETE}) AS complete FROM m)
SELECT 'missing_data' AS category, gaps::BIGINT AS first, complete::BIGINT AS second, {rnd('gaps / (n * 6)')} AS rate FROM a, whole
UNION ALL SELECT 'duplicates', dup::BIGINT, groups::BIGINT, {rnd('dup / n')} FROM a, dup""")
def findings_evidence(spark, folder):
    """The numbers behind the findings on missing values and duplicates."""
    found = _quality(spark, folder)
    of = lambda *keys: F.coalesce(*[F.get_json_object("evidence", f"$.{k}") for k in keys])
    return rounded(found.where("category = 'duplicates' or (category = 'missing_data' and title not like 'Column%')").select(
        "category", of("missing_cells", "duplicate_rows").cast("bigint").alias("first"),
        of("complete_rows", "duplicate_group_count").cast("bigint").alias("second"), of("missing_rate", "duplicate_rate").cast("double").alias("rate")))


# ---- relations ------------------------------------------------------------------------

#: Seven columns that follow each other, so that more pairs are strong than a sentence names.
_MANY = ["l_quantity", "l_tax", *[f"l_quantity * {i + 2} + l_linenumber * {i} as like{i}" for i in range(4)], "l_linenumber - l_quantity as against"]
_NAMES = ["l_quantity", "l_tax", "like0", "like1", "like2", "like3", "against"]
_PAIRS = union_all(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(*) AS n FROM d" for i, a in enumerate(_NAMES) for b in _NAMES[i + 1:])
_RULES = (("r >= 0.7", "pair(s) rise together", "One of the two may be redundant; neither need cause the other.", 3),
          ("r <= -0.7", "pair(s) move against each other", "See whether a common scale or the way of collecting explains it.", 3),
          ("abs(r) >= 0.995", "pair(s) of nearly equal columns", "Keep one of each pair.", 4))


@query("findings_correlations_in_full", f"WITH d AS ({sql('lineitem', _MANY)}), p AS ({_PAIRS}), " + ", ".join(
    f"""r{i} AS (SELECT *, row_number() OVER (ORDER BY round(abs(r), 9) DESC, a, b) AS place, count(*) OVER () AS every FROM p WHERE {where})"""
    for i, (where, *_) in enumerate(_RULES)) + " " + union_all(
    f"""SELECT every || ' {title}' AS title, (SELECT string_agg(printf('%s and %s (r = %+.{digits}f)', a, b, r), '; ' ORDER BY place) FROM r{i} WHERE place <= 5) || '.' AS detail,
  a, b, {rnd('r')} AS r, n, '{advice}' AS recommendation FROM r{i}""" for i, (_, title, advice, digits) in enumerate(_RULES)))
def findings_correlations_in_full(spark, folder):
    """Every pair of each finding, as its evidence holds them."""
    pairs = correlation.correlation_pairs(derived(spark, folder, "lineitem", _MANY), with_p=False)
    # pairs that agree to nine digits are ordered by name in the sentence
    even = pairs.withColumn("abs_r", F.round("abs_r", 9))
    found = findings.correlation_findings(even, len(_NAMES), "pearson").where("title like '%pair(s)%'")
    held = F.from_json("evidence", "pairs array<struct<a: string, b: string, r: double, n: bigint>>")["pairs"]
    return rounded(found.select("title", "detail", "recommendation", F.explode(held).alias("p")).select("title", "detail", "p.a", "p.b", "p.r", "p.n", "recommendation"))


_KINDS = [f"case when l_quantity > {5 * i + 5} then 'more' else 'less' end as k{i}" for i in range(5)]
_KIND_NAMES = [f"k{i}" for i in range(5)]


@query("findings_associations_in_full", f"WITH d AS ({sql('lineitem', _KINDS)}), t AS (" + union_all(
    f"""SELECT '{a}' AS a, '{b}' AS b, t, t * (sum(n * n / (ra * cb)) - 1) / t AS phi2 FROM (
  SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY x) AS ra, sum(n) OVER (PARTITION BY y) AS cb
  FROM (SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS n FROM d GROUP BY 1, 2) c) m GROUP BY t""" for i, a in enumerate(_KIND_NAMES) for b in _KIND_NAMES[i + 1:]) + f"""),
v AS (SELECT a, b, round(sqrt(greatest(0, phi2 - 1 / (t - 1)) / (1 - 1 / (t - 1))), 4) AS v FROM t),
s AS (SELECT *, row_number() OVER (ORDER BY v DESC, a, b) AS place, count(*) OVER () AS every, max(v) OVER () AS most FROM v WHERE v >= 0.5)
SELECT every || ' strongly associated categorical pair(s)' AS title,
  (SELECT string_agg(a || ' and ' || b, '; ' ORDER BY place) FROM s WHERE place <= 5) || '.' AS detail,
  CASE WHEN most >= 0.7 THEN 'moderate' ELSE 'low' END AS severity, a, b, {rnd('v', 4)} AS v FROM s""")
def findings_associations_in_full(spark, folder):
    found = findings.association_findings(association.associations(derived(spark, folder, "lineitem", _KINDS), _KIND_NAMES))
    held = F.from_json("evidence", "pairs array<struct<a: string, b: string, v: double>>")["pairs"]
    # without the rounded coefficients, as the engines print halves differently
    named = F.regexp_replace("detail", r" \(V = [0-9.]+\)", "").alias("detail")
    return rounded(found.select("title", named, "severity", F.explode(held).alias("p")).select("title", "detail", "severity", "p.a", "p.b", "p.v"), 4)


# ---- leakage and anomalies ----------------------------------------------------------------

@query("findings_leakage", f"""{WITH_ORDERS}, f AS ({FACTS}), every AS (
  SELECT "column", signal, severity, confidence FROM ({IDENTIFIER}) a
  UNION ALL SELECT CASE WHEN column_b = 'is_big' THEN column_a ELSE column_b END,
    CASE WHEN 'is_big' IN (column_a, column_b) THEN 'target_copy' ELSE 'duplicate_column' END,
    CASE WHEN 'is_big' IN (column_a, column_b) THEN 'critical' ELSE 'high' END, 'high' FROM ({COPIES}) b
  UNION ALL SELECT "column", 'perfect_separation', 'high', 'high' FROM ({SEPARATION}) c WHERE accuracy >= 0.999
  UNION ALL SELECT "column", 'outcome_name', severity, 'low' FROM ({OUTCOME}) e
), one AS (
  SELECT "column" AS name, signal, max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS k FROM every GROUP BY 1, 2
), told AS (
  SELECT *, CASE k WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'moderate' WHEN 1 THEN 'low' ELSE 'info' END AS severity FROM one
)
SELECT 'leakage' AS category, count(DISTINCT name) || ' column(s) with leakage signals' AS title,
  arg_max(severity, k) AS severity, 1::BIGINT AS seq FROM told HAVING count(*) > 0
UNION ALL SELECT 'leakage', 'Possible leakage in ' || name || ' (' || signal || ')', severity, 1 + row_number() OVER (ORDER BY k DESC, name, signal) FROM told""")
def findings_leakage(spark, folder):
    """A finding for all signals together and one for each, worst first."""
    found = findings.leakage_findings(leakage.leakage_signals(labelled(spark, folder)))
    return rounded(found.select("category", "title", "severity", "seq"))


@query("findings_without_forest", """SELECT 'anomalies' AS category, 'No anomaly detection' AS title, 'info' AS severity, 'false' AS available,
  count(*) AS n_rows FROM lineitem""")
def findings_without_forest(spark, folder):
    """One feature is too few for a forest, which is a finding of its own."""
    df = table(spark, folder, "lineitem")
    found = findings.anomaly_findings(anomalies.anomaly_summary(anomalies.detect_anomalies(df, ["l_tax"]), spark), None)
    return found.select("category", "title", "severity", F.get_json_object("evidence", "$.available").alias("available")).crossJoin(
        F.broadcast(df.agg(F.count("*").alias("n_rows"))))  # one row each


_SCORED = ["l_orderkey", "l_linenumber", "l_partkey", "cast(-((l_partkey * 7919 + l_orderkey) % 500) as double) / 500 as anomaly_score", "l_quantity > 45 as is_anomaly"]


@query("anomaly_examples_of_scores", f"""WITH d AS ({sql('lineitem', _SCORED)})
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, {rnd('anomaly_score')} AS anomaly_score FROM d WHERE is_anomaly
ORDER BY d.anomaly_score, d.l_orderkey, d.l_linenumber, l_partkey LIMIT 10""")
def anomaly_examples_of_scores(spark, folder):
    """The ten flagged rows of the lowest given scores."""
    return rounded(anomalies.anomaly_examples(derived(spark, folder, "lineitem", _SCORED)).select("l_orderkey", "l_linenumber", "anomaly_score"))
