"""Cleaning steps, on tables with markers, decorated numbers, copies and gaps."""

from __future__ import annotations

from tabscope.catalog import query, rnd, rounded, sql_list, table
from tabscope.catalog.derived import derived, sql
from tabscope.operators import cleaning
from tabscope.settings import CLEAN_MISSING_MARKERS

MARKED = [
    "event_id",
    "case when value > 150 then ' N/A ' when value > 120 then 'null' when value > 110 then '' else event_type end as event_type",
    "case when user_id < 20 then 'None' when user_id < 40 then 'nan' else concat('user ', cast(user_id as varchar(9))) end as who",
]
MARKER = "lower(trim({0})) IN (" + sql_list(CLEAN_MISSING_MARKERS) + ")"
AMOUNTS = [
    "event_id", "event_type",
    "case when value > 120 then 'unknown' when user_id < 30 then concat('$', cast(value as varchar(20))) "
    "when user_id < 60 then concat('(', cast(value as varchar(20)), ')') "
    "when user_id < 90 then concat(cast(value as varchar(20)), '%') else concat(' +', cast(value as varchar(20)), ' ') end as amount",
]
STRIP = "translate(trim(amount), ', $€£¥₹', '')"
NUMBER = f"""CASE WHEN regexp_matches(t, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN t::DOUBLE END"""
PARSED = f"""(SELECT *, {NUMBER} AS parsed FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace({STRIP}, '^\\+', ''),
  '^\\((.*)\\)$', '-\\1'), '%$', '') AS t FROM a) x)"""


@query("markers_to_null", f"""WITH m AS ({sql('events', MARKED)})
SELECT event_id, CASE WHEN NOT {MARKER.format('event_type')} THEN event_type END AS event_type,
  CASE WHEN NOT {MARKER.format('who')} THEN who END AS who FROM m""")
def markers_to_null(spark, folder):
    return cleaning.markers_to_null(derived(spark, folder, "events", MARKED))


@query("text_to_numbers", f"""WITH a AS ({sql('events', AMOUNTS)})
SELECT event_id, event_type, {rnd('parsed')} AS amount FROM {PARSED} p""")
def text_to_numbers(spark, folder):
    return rounded(cleaning.text_to_numbers(derived(spark, folder, "events", AMOUNTS), ["amount"]))


@query("without_duplicates", "SELECT DISTINCT user_id, event_type FROM events")
def without_duplicates(spark, folder):
    return cleaning.without_duplicates(table(spark, folder, "events").select("user_id", "event_type"))


GAPPY = [
    "l_orderkey", "l_partkey", "l_suppkey", "case when l_quantity > 3 then l_quantity end as l_quantity",
    "case when l_tax > 0.01 then l_linenumber end as l_linenumber", "nullif(l_discount, 0.0) as l_discount",
    "case when l_quantity < 40 then l_returnflag end as l_returnflag",
    "case when l_quantity < 30 then l_shipdate end as l_shipdate",
]


@query("complete_rows", f"""WITH g AS ({sql('lineitem', GAPPY)})
SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_linenumber::BIGINT AS l_linenumber, {rnd('l_discount')} AS l_discount,
  l_returnflag, l_shipdate FROM g WHERE l_quantity IS NOT NULL AND l_linenumber IS NOT NULL AND l_discount IS NOT NULL
  AND l_returnflag IS NOT NULL AND l_shipdate IS NOT NULL""")
def complete_rows(spark, folder):
    return rounded(cleaning.complete_rows(derived(spark, folder, "lineitem", GAPPY)))


def _mode(c, source="g"):
    return f"(SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("filled_gaps", f"""WITH g AS ({sql('lineitem', GAPPY)}),
m AS (SELECT median(l_quantity) AS q, median(l_linenumber) AS n, median(l_discount) AS d FROM g)
SELECT l_orderkey, l_partkey, l_suppkey, coalesce(l_quantity, q) AS l_quantity, coalesce(l_linenumber, n)::BIGINT AS l_linenumber,
  {rnd('coalesce(l_discount, d)')} AS l_discount, coalesce(l_returnflag, {_mode('l_returnflag')}) AS l_returnflag,
  coalesce(l_shipdate, {_mode('l_shipdate')}) AS l_shipdate FROM g, m""")
def filled_gaps(spark, folder):
    return rounded(cleaning.clean(derived(spark, folder, "lineitem", GAPPY), missing="fill").frame)


RAW = ["event_type", "user_id % 50 as grp", "case when value > 150 then ' N/A ' when value > 120 then 'null' "
       "else concat('$', cast(cast(round(value) as int) as varchar(9))) end as amount"]


def _cleaned(spark, folder):
    return cleaning.clean(derived(spark, folder, "events", RAW), normalize_markers=True, numeric_columns=["amount"],
                          remove_duplicates=True, missing="fill")


RAW_SQL = f"""WITH r AS ({sql('events', RAW)}), m AS (SELECT event_type, grp,
  CASE WHEN NOT {MARKER.format('amount')} THEN amount END AS amount FROM r),
n AS (SELECT event_type, grp, regexp_replace(amount, '^\\$', '')::DOUBLE AS amount FROM m), u AS (SELECT DISTINCT * FROM n)"""


@query("cleaned_table", f"""{RAW_SQL}
SELECT event_type, grp::BIGINT AS grp, {rnd('coalesce(amount, (SELECT median(amount) FROM u))')} AS amount FROM u""")
def cleaned_table(spark, folder):
    return rounded(_cleaned(spark, folder).frame)


@query("cleaning_audit", f"""{RAW_SQL}
SELECT 1::BIGINT AS step, 'missing markers to NULL' AS operation, count(*) FILTER (WHERE {MARKER.format('amount')}) AS cells_changed, 0::BIGINT AS rows_removed FROM r
UNION ALL SELECT 2, 'number text to double: amount', count(amount), 0 FROM m
UNION ALL SELECT 3, 'duplicate rows removed', 0, (SELECT count(*) FROM n) - (SELECT count(*) FROM u)
UNION ALL SELECT 4, 'missing values filled', count(*) - count(amount), 0 FROM u""")
def cleaning_audit(spark, folder):
    return rounded(_cleaned(spark, folder).audit.drop("detail"))


@query("cleaning_totals", f"""{RAW_SQL}
SELECT (SELECT count(*) FILTER (WHERE {MARKER.format('amount')}) FROM r) + (SELECT count(amount) FROM m)
  + (SELECT count(*) - count(amount) FROM u) AS cells_changed, (SELECT count(*) FROM n) - (SELECT count(*) FROM u) AS rows_removed""")
def cleaning_totals(spark, folder):
    return _cleaned(spark, folder).totals()
