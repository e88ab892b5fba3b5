"""Missing values, duplicates, low variance, profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscope.catalog import query, rnd, rounded, table, union_all
from tabscope.catalog.derived import DIRTY_ORDERS, GAPPY_LINEITEM, GAPPY_TYPES, derived, names, sql
from tabscope.operators import profile, quality

GAPPY = f"WITH g AS ({sql('lineitem', GAPPY_LINEITEM)}) "
BAND = ("CASE WHEN {0} >= 0.8 THEN 'critical' WHEN {0} >= 0.5 THEN 'high' WHEN {0} >= 0.2 THEN 'moderate' "
        "WHEN {0} >= 0.05 THEN 'low' ELSE 'info' END")


def gappy(spark, folder):
    return derived(spark, folder, "lineitem", GAPPY_LINEITEM)


_per_column = union_all(
    f"SELECT {i} AS position, '{c}' AS \"column\", count(*) - count({c}) AS missing, "
    f"(count(*) - count({c})) / count(*) AS missing_rate, '{t}' AS dtype FROM g"
    for i, (c, t) in enumerate(zip(names(GAPPY_LINEITEM), GAPPY_TYPES)))


@query("missing_columns", GAPPY + f"""
, m AS ({_per_column})
SELECT position::BIGINT AS position, "column", missing, {rnd('missing_rate')} AS missing_rate, dtype,
       {BAND.format('missing_rate')} AS severity
FROM m WHERE missing > 0""")
def missing_columns(spark, folder):
    return rounded(quality.missing_columns(gappy(spark, folder)))


_any = " OR ".join(f"{c} IS NULL" for c in names(GAPPY_LINEITEM))
_k = len(GAPPY_LINEITEM)
_miss = " + ".join(f"(count(*) - count({c}))" for c in names(GAPPY_LINEITEM))
_cols = " + ".join(f"(CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END)" for c in names(GAPPY_LINEITEM))


@query("missing_summary", GAPPY + f"""
SELECT count(*) * {_k} AS total_cells, ({_miss})::BIGINT AS missing_cells,
       {rnd(f'({_miss}) / (count(*) * {_k})')} AS missing_rate,
       count(*) FILTER (WHERE NOT ({_any})) AS complete_rows, count(*) FILTER (WHERE {_any}) AS rows_with_missing,
       ({_cols})::BIGINT AS columns_with_missing,
       {rnd(f'count(*) FILTER (WHERE NOT ({_any})) / count(*)')} AS complete_row_rate
FROM g""")
def missing_summary(spark, folder):
    return rounded(quality.missing_summary(gappy(spark, folder)))


@query("missing_map", f"""
WITH g AS (SELECT l_orderkey, l_partkey, l_linenumber AS line, {', '.join(GAPPY_LINEITEM)} FROM lineitem)
SELECT l_orderkey, l_partkey, line::BIGINT AS line, {', '.join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END::BIGINT AS missing_{c}" for c in names(GAPPY_LINEITEM))}
FROM g ORDER BY md5(concat_ws('|', '42', l_orderkey, l_partkey, line)), l_orderkey, l_partkey, line LIMIT 400""")
def missing_map(spark, folder):
    df = derived(spark, folder, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber as line", *GAPPY_LINEITEM])
    return rounded(quality.missing_map(df, names(GAPPY_LINEITEM), id_columns=["l_orderkey", "l_partkey", "line"]))


def _duplicates(name, keys):
    return f"""
WITH d AS (SELECT {keys}, count(*) AS n FROM {name} GROUP BY {keys})
SELECT sum(n)::BIGINT AS total_rows, (sum(n) - count(*))::BIGINT AS duplicate_rows,
       {rnd('(sum(n) - count(*)) / sum(n)')} AS duplicate_rate,
       count(*) FILTER (WHERE n > 1) AS duplicate_group_count, count(*) AS unique_rows FROM d"""


@query("duplicate_texts", _duplicates("documents", "text"))
def duplicate_texts(spark, folder):
    return rounded(quality.duplicate_summary(table(spark, folder, "documents"), ["text"]))


@query("duplicate_rows_all_columns", _duplicates("(SELECT lang, source, text FROM documents)", "lang, source, text"))
def duplicate_rows_all_columns(spark, folder):
    return rounded(quality.duplicate_summary(table(spark, folder, "documents").select("lang", "source", "text")))


@query("duplicate_subset", _duplicates("lineitem", "l_returnflag, l_linestatus, l_linenumber"))
def duplicate_subset(spark, folder):
    return rounded(quality.duplicate_summary(table(spark, folder, "lineitem"),
                                             ["l_returnflag", "l_linestatus", "l_linenumber"]))


@query("duplicate_groups", """
SELECT user_id, event_type, count(*) AS copies FROM events GROUP BY user_id, event_type HAVING count(*) > 1""")
def duplicate_groups(spark, folder):
    return quality.duplicate_groups(table(spark, folder, "events"), ["user_id", "event_type"])


@query("duplicate_examples", """
SELECT doc_id, text, lang, source, n_chars FROM documents
WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)
ORDER BY text, doc_id, lang, source, n_chars LIMIT 10""")
def duplicate_examples(spark, folder):
    return quality.duplicate_examples(table(spark, folder, "documents"), ["text"])


_dirty = names(DIRTY_ORDERS)
_low = union_all(
    f"SELECT {i} AS position, '{c}' AS \"column\", {c}::VARCHAR AS value, "
    f"{c if c in ('o_orderkey', 'o_totalprice', 'small_price') else 'NULL'}::DOUBLE AS num, "
    f"count(*) AS n FROM d GROUP BY {c}" for i, c in enumerate(_dirty))


@query("low_variance", f"""
WITH d AS ({sql('orders', DIRTY_ORDERS)}), long AS ({_low}),
s AS (SELECT position, "column", count(value) AS n_unique, coalesce(sum(n) FILTER (WHERE value IS NOT NULL), 0) AS present,
             sum(n) AS total, max(n) FILTER (WHERE value IS NOT NULL) AS top FROM long GROUP BY ALL),
t AS (SELECT "column", value FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, num, value) AS k
                                 FROM long WHERE value IS NOT NULL) x WHERE k = 1),
j AS (SELECT position::BIGINT AS position, s."column", n_unique, value AS dominant_value,
        CASE WHEN n_unique = 0 THEN 1.0 ELSE top / present END::DOUBLE AS dominant_rate, 1 - present / total AS gap
      FROM s LEFT JOIN t ON s."column" = t."column")
SELECT position, "column", n_unique, dominant_value, {rnd('dominant_rate')} AS dominant_rate,
       n_unique <= 1 AS is_constant, (n_unique = 0 OR (n_unique > 1 AND dominant_rate >= 0.99)) AS is_near_constant,
       CASE WHEN n_unique = 0 THEN 'The column holds no value at all.' WHEN n_unique = 1 THEN 'All values present are the same.'
            ELSE printf('%.1f%%', dominant_rate * 100) || ' of the values present are ''' || dominant_value
                 || '''; the others are too few to learn from.' END
       || CASE WHEN n_unique > 0 AND gap >= 0.5 THEN ' Besides, ' || printf('%.1f%%', gap * 100) || ' of the column is missing.'
               ELSE '' END AS note
FROM j WHERE n_unique <= 1 OR dominant_rate >= 0.99""")
def low_variance(spark, folder):
    return rounded(quality.low_variance(derived(spark, folder, "orders", DIRTY_ORDERS)))


_ORDERS = [("o_orderkey", "bigint", "numeric", 8), ("o_custkey", "bigint", "numeric", 8),
           ("o_orderstatus", "string", None, 0), ("o_totalprice", "double", "numeric", 8),
           ("o_orderdate", "timestamp_ntz", "datetime", 8), ("o_orderpriority", "string", None, 0)]


def _profile_row(i, c, t, role, width):
    size = f"count({c}) * {width}" if width else f"coalesce(sum(octet_length(encode({c}))), 0)"
    role = f"'{role}'" if role else (
        f"CASE WHEN count({c}) = 0 THEN 'empty' WHEN count(DISTINCT {c}) > 20 AND count(DISTINCT {c}) > 0.5 * count({c}) "
        "THEN 'text-like' ELSE 'categorical' END")
    return (f"SELECT {i}::BIGINT AS position, '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null, "
            f"count(*) - count({c}) AS missing, {rnd(f'100.0 * (count(*) - count({c})) / count(*)')} AS missing_pct, "
            f"count(DISTINCT {c}) AS \"unique\", coalesce(min({c})::VARCHAR, '') AS example, {role} AS role, "
            f"({size})::BIGINT AS data_bytes FROM orders")


@query("column_profile", union_all(_profile_row(i, *x) for i, x in enumerate(_ORDERS)))
def column_profile(spark, folder):
    return rounded(profile.column_profile(table(spark, folder, "orders")))


_BYTES = "count(*) * 8 * 8 + count(*) * 4 + sum(octet_length(encode(l_returnflag)) + octet_length(encode(l_linestatus)))"


@query("overview", f"""
WITH b AS (SELECT count(*) AS n, ({_BYTES})::BIGINT AS bytes FROM lineitem),
d AS (SELECT (SELECT n FROM b) - count(*) AS dup FROM (SELECT DISTINCT * FROM lineitem) x)
SELECT n AS n_rows, 11::BIGINT AS n_columns, n * 11 AS total_cells, 0::BIGINT AS missing_cells, 0.0::DOUBLE AS missing_rate,
       dup AS duplicate_rows, bytes AS data_bytes,
       CASE WHEN bytes < 1024 * 1024 THEN printf('%.1f KiB', bytes / 1024.0) ELSE printf('%.1f MiB', bytes / 1048576.0) END AS data_size,
       format('{{:,}}', n) || ' rows x 11 columns' AS shape
FROM b, d""")
def overview(spark, folder):
    return rounded(profile.overview(table(spark, folder, "lineitem")))


@query("empty_columns", f"""
WITH d AS ({sql('orders', DIRTY_ORDERS)})
{union_all(f'''SELECT '{c}' AS "column", count({c}) = 0 AS is_empty FROM d''' for c in _dirty)}""")
def empty_columns(spark, folder):
    return profile.non_empty_columns(derived(spark, folder, "orders", DIRTY_ORDERS))


@query("whole_number_columns", union_all(
    f"SELECT '{c}' AS \"column\", bool_and({c} = floor({c})) AS whole FROM lineitem"
    for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def whole_number_columns(spark, folder):
    return profile.integer_valued(table(spark, folder, "lineitem"))
