"""Leakage signals."""

from __future__ import annotations

from tabscope import settings as S
from tabscope.catalog import query, rnd, rounded, sql_list, union_all
from tabscope.catalog.derived import LABELLED_ORDERS, derived, names, sql
from tabscope.operators import leakage
from tabscope.settings import Settings

WITH = f"WITH d AS ({sql('orders', LABELLED_ORDERS)})"
COLUMNS = names(LABELLED_ORDERS)
NUMERIC = {"o_orderkey", "o_custkey", "o_totalprice", "is_big", "final_flag_copy", "price_again", "price_gaps"}


def labelled(spark, folder):
    return derived(spark, folder, "orders", LABELLED_ORDERS)


def _role(c):
    if c in NUMERIC:
        return "'numeric'"
    if c == "o_orderdate":
        return "'datetime'"
    return f"CASE WHEN count(DISTINCT {c}) > 20 AND count(DISTINCT {c}) > 0.5 * count({c}) THEN 'text-like' ELSE 'categorical' END"


FACTS = union_all(
    f"SELECT {i}::BIGINT AS position, '{c}' AS \"column\", {_role(c)} AS role, {str(c in NUMERIC).lower()} AS numeric, "
    f"false AS number_text, count({c}) AS n_present, count(DISTINCT {c}) AS n_unique FROM d" for i, c in enumerate(COLUMNS))


@query("column_facts", f"{WITH} {FACTS}")
def column_facts(spark, folder):
    return rounded(leakage.column_facts(labelled(spark, folder)))


TOKENS = "list_filter(string_split(lower(\"column\"), '_'), lambda t: t <> '')"


@query("target_candidates", f"""{WITH}, f AS ({FACTS}),
s AS (SELECT position, "column", n_unique, numeric, role,
  CASE WHEN "column" IN ({sql_list(S.TARGET_EXACT)}) THEN 3
       WHEN regexp_matches("column", '^(is_|has_|will_|did_|was_)|(_flag|_target|_label|_class|_outcome)$') THEN 2
       WHEN list_has_any({TOKENS}, [{sql_list(S.TARGET_TOKENS)}]) THEN 2 ELSE 0 END AS base FROM f),
g AS (SELECT position, "column", (CASE WHEN n_unique > 50 AND NOT numeric THEN base - 1 ELSE base END)::BIGINT AS score FROM s
      WHERE n_unique >= 2 AND role <> 'datetime' AND base > 0)
SELECT position, "column", score, row_number() OVER (ORDER BY score DESC, position DESC) = 1 AS chosen FROM g WHERE score > 0""")
def target_candidates(spark, folder):
    return rounded(leakage.target_candidates(leakage.column_facts(labelled(spark, folder))))


IDS = f"[{sql_list(S.ID_TOKENS)}]"


IDENTIFIER = f"""WITH s AS (SELECT *, n_unique / n_present AS ratio, list_has_any({TOKENS}, {IDS}) AS named FROM f),
k AS (SELECT *, ratio >= 0.95 AND NOT numeric AND NOT number_text AS key_like, named AND numeric AND n_unique > 20 AS name_like FROM s)
SELECT "column", 'identifier_like' AS signal, CASE WHEN key_like AND named THEN 'moderate' ELSE 'low' END AS severity,
  CASE WHEN NOT key_like THEN 'low' WHEN ratio >= 0.999 THEN 'high' ELSE 'medium' END AS confidence
FROM k WHERE "column" <> 'is_big' AND (key_like OR name_like)"""


@query("identifier_signals", f"{WITH}, f AS ({FACTS}) SELECT * FROM ({IDENTIFIER}) x")
def identifier_signals(spark, folder):
    facts = leakage.column_facts(labelled(spark, folder))
    return leakage.identifier_signals(facts, "is_big").select("column", "signal", "severity", "confidence")


OUTCOME = f"""WITH s AS (SELECT "column", role = 'datetime' OR n_unique <= 2 AS status, {TOKENS} AS t FROM f WHERE "column" <> 'is_big'),
m AS (SELECT "column", status,
  list_filter(t, lambda x: x IN ({sql_list(S.POST_OUTCOME_TOKENS)})
    OR (status AND x IN ({sql_list(S.CONDITIONAL_OUTCOME_TOKENS)}))
    OR x IN ({sql_list(S.OUTCOME_TOKENS)})) AS strong,
  list_filter(t, lambda x: x IN ({sql_list(S.WEAK_OUTCOME_TOKENS)})) AS weak FROM s)
SELECT "column", CASE WHEN len(strong) = 0 THEN 'info' ELSE 'low' END AS severity, status AS status_like FROM m WHERE len(strong) + len(weak) > 0"""


@query("outcome_name_signals", f"{WITH}, f AS ({FACTS}) SELECT * FROM ({OUTCOME}) x")
def outcome_name_signals(spark, folder):
    from pyspark.sql import functions as F
    facts = leakage.column_facts(labelled(spark, folder))
    return leakage.outcome_name_signals(facts, "is_big").select(
        "column", "severity", F.get_json_object("evidence", "$.status_like").cast("boolean").alias("status_like"))


_SAME_TYPE = [(a, b) for group in (["o_orderkey", "o_custkey"], ["is_big", "final_flag_copy"], ["o_totalprice", "price_again", "price_gaps"],
                                   ["o_orderstatus", "o_orderpriority", "final_status", "order_ref"])
              for i, a in enumerate(group) for b in group[i + 1:]]


COPIES = union_all(f"""
SELECT '{a}' AS column_a, '{b}' AS column_b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS compared FROM d
HAVING count(*) FILTER (WHERE {a} <> {b}) = 0 AND count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) >= greatest(10, 0.5 * count(*))"""
                   for a, b in _SAME_TYPE)


@query("duplicate_column_pairs", f"{WITH} {COPIES}")
def duplicate_column_pairs(spark, folder):
    return leakage.duplicate_pairs(labelled(spark, folder))


_FEATURES = [c for c in COLUMNS if c in NUMERIC and c != "o_totalprice"]


@query("target_correlations", f"{WITH} " + union_all(f"""
SELECT '{c}' AS "column", {rnd('corr(ra, rb)')} AS r, count(*) AS n FROM (
  SELECT rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS ra,
         rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS rb
  FROM d WHERE {c} IS NOT NULL AND o_totalprice IS NOT NULL) x""" for c in _FEATURES))
def target_correlations(spark, folder):
    return rounded(leakage.target_correlations(labelled(spark, folder), "o_totalprice"))


def _threshold(c):
    return f"""SELECT '{c}' AS "column", max(greatest(acc, 1 - acc)) AS accuracy, any_value(total) AS n FROM (
  SELECT (un - up + ones - up) / total AS acc, total FROM (
    SELECT sum(n) OVER w AS un, sum(p) OVER w AS up, sum(n) OVER ()::BIGINT AS total, sum(p) OVER () AS ones FROM (
      SELECT {c} AS v, count(*) AS n, sum(is_big) AS p FROM d WHERE {c} IS NOT NULL GROUP BY 1) a
    WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING)) b) c"""


def _purity(c):
    return f"""SELECT '{c}' AS "column", sum(greatest(p, n - p)) / sum(n) AS accuracy, sum(n)::BIGINT AS n FROM (
  SELECT {c} AS v, count(*) AS n, sum(is_big) AS p FROM d WHERE {c} IS NOT NULL GROUP BY 1) a HAVING count(*) BETWEEN 2 AND 200"""


SEPARATION = union_all([_threshold(c) for c in COLUMNS if c in NUMERIC and c != "is_big"]
                       + [_purity(c) for c in COLUMNS if c not in NUMERIC])


@query("separation_accuracy", f"{WITH}, s AS ({SEPARATION})" + f"""
SELECT "column", {rnd('accuracy')} AS accuracy, n FROM s""")
def separation_accuracy(spark, folder):
    return rounded(leakage.separation(labelled(spark, folder), "is_big"))


#: More features than any earlier limit.
MANY = [f"(o_totalprice * {i + 2}) % {90 + 7 * i} + o_custkey % {i + 2} as x{i:02d}" for i in range(30)]
_WIDE = ["CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END as is_big", *MANY]


@query("separation_many_columns", f"""WITH d AS ({sql('orders', _WIDE)}), s AS ({union_all(_threshold(c) for c in names(MANY))})
SELECT "column", {rnd('accuracy')} AS accuracy, n FROM s""")
def separation_many_columns(spark, folder):
    return rounded(leakage.separation(derived(spark, folder, "orders", _WIDE), "is_big"))


_LEVELS = [c for c in COLUMNS if c not in NUMERIC and c not in ("is_big", "o_orderdate")]


@query("separation_levels", f"{WITH} " + union_all(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique, count(DISTINCT {c}) <= 200 AS available,
  CASE WHEN count(DISTINCT {c}) > 200 THEN 'more than 200 levels' ELSE '' END AS reason FROM d WHERE is_big IS NOT NULL""" for c in _LEVELS))
def separation_levels(spark, folder):
    return leakage.separation_levels(labelled(spark, folder), "is_big")


#: A feature of 300 levels, one of 250 that gives the target away, and one whose values hardly repeat.
_ANY = ["CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END as is_big", "cast(o_custkey * 7 % 300 as varchar(9)) as plain",
        "cast(cast(case when o_totalprice > 150000 then 1000 else 0 end + o_custkey % 250 as bigint) as varchar(9)) as telling", "cast(o_orderkey as varchar(20)) as own"]


@query("separation_any_levels", f"""WITH d AS ({sql('orders', _ANY)}), s AS ({union_all(
    f"""SELECT '{c}' AS "column", sum(greatest(p, n - p)) / sum(n) AS accuracy, sum(n)::BIGINT AS n FROM (SELECT {c}, count(*) AS n, sum(is_big) AS p
    FROM d WHERE {c} IS NOT NULL GROUP BY {c}) x HAVING 2 * count(*) <= sum(n)""" for c in names(_ANY)[1:])})
SELECT "column", {rnd('accuracy')} AS accuracy, n FROM s""")
def separation_any_levels(spark, folder):
    return rounded(leakage.separation(derived(spark, folder, "orders", _ANY), "is_big", settings=Settings(separation_levels=None)))


@query("leakage_signals", f"""{WITH}, f AS ({FACTS}), every AS (
  SELECT "column", signal, severity, confidence FROM ({IDENTIFIER}) a
  UNION ALL SELECT CASE WHEN column_b = 'is_big' THEN column_a ELSE column_b END,
    CASE WHEN 'is_big' IN (column_a, column_b) THEN 'target_copy' ELSE 'duplicate_column' END,
    CASE WHEN 'is_big' IN (column_a, column_b) THEN 'critical' ELSE 'high' END, 'high' FROM ({COPIES}) b
  UNION ALL SELECT "column", 'perfect_separation', 'high', 'high' FROM ({SEPARATION}) c WHERE accuracy >= 0.999
  UNION ALL SELECT "column", 'outcome_name', severity, 'low' FROM ({OUTCOME}) e
  UNION ALL SELECT 'is_big', 'target_selection', 'info', 'n/a')
SELECT DISTINCT "column", signal, severity, confidence FROM every""")
def leakage_signals(spark, folder):
    return leakage.leakage_signals(labelled(spark, folder)).select("column", "signal", "severity", "confidence")
