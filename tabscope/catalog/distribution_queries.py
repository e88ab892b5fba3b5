"""Numeric and categorical statistics."""

from __future__ import annotations

from tabscope.catalog import query, rnd, rounded, table, union_all
from tabscope.catalog.derived import CODED_EVENTS, GAPPY_LINEITEM, derived, names, sql
from tabscope.operators import categorical, numeric, profile

LINEITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax"]


def stats_sql(source: str, columns: list[str], digits: int = 4) -> str:
    def one(i, c):
        r = lambda e, d=digits: rnd(e, d)
        return f"""
SELECT {i}::BIGINT AS position, '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing,
       {r(f'avg({c})')} AS mean, {r(f'quantile_cont({c}::DOUBLE, 0.5)')} AS median,
       {r(f'CASE WHEN count({c}) = 1 THEN 0.0 ELSE stddev_samp({c}) END')} AS std, {r(f'min({c})')} AS minimum,
       {r(f'quantile_cont({c}::DOUBLE, 0.25)')} AS q1, {r(f'quantile_cont({c}::DOUBLE, 0.75)')} AS q3,
       {r(f'max({c})')} AS maximum,
       {r(f'quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)')} AS iqr,
       {r(f'CASE WHEN min({c}) = max({c}) THEN 0.0 ELSE skewness({c}) END')} AS skewness,
       {r(f'CASE WHEN min({c}) = max({c}) THEN 0.0 ELSE kurtosis({c}) END')} AS kurtosis,
       count(DISTINCT {c}) AS n_unique, {r(f'count(*) FILTER (WHERE {c} = 0) / count({c})')} AS zero_share,
       {r(f'CASE WHEN avg({c}) <> 0 THEN stddev_samp({c}) / abs(avg({c})) END')} AS coefficient_of_variation
FROM {source}"""
    return union_all(one(i, c) for i, c in enumerate(columns))


@query("numeric_stats", stats_sql("lineitem", LINEITEM_NUMBERS))
def numeric_stats(spark, folder):
    return rounded(numeric.numeric_stats(table(spark, folder, "lineitem")), 4)


_GAPPY_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("numeric_stats_with_gaps", f"WITH g AS ({sql('lineitem', GAPPY_LINEITEM)}) " + stats_sql("g", _GAPPY_NUMBERS))
def numeric_stats_with_gaps(spark, folder):
    return rounded(numeric.numeric_stats(derived(spark, folder, "lineitem", GAPPY_LINEITEM)), 4)


_NOT_FINITE = ["case when l_quantity > 45 then cast('NaN' as double) when l_quantity < 3 then cast('Infinity' as double) "
               "when l_quantity < 5 then cast('-Infinity' as double) else l_quantity end as q", "l_tax"]


@query("numeric_stats_not_finite", """WITH g AS (SELECT CASE WHEN l_quantity <= 45 AND l_quantity >= 5 THEN l_quantity END AS q, l_tax FROM lineitem) """
       + stats_sql("g", ["q", "l_tax"]))
def numeric_stats_not_finite(spark, folder):
    """NaN and infinities count as missing."""
    return rounded(numeric.numeric_stats(derived(spark, folder, "lineitem", _NOT_FINITE)), 4)


_CODED_NUMBERS = ["event_id", "user_id", "reading", "spend", "value"]
_CODED = f"WITH e AS ({sql('events', CODED_EVENTS)}) "
_coded_stats = union_all(
    f"""SELECT {i}::BIGINT AS position, '{c}' AS "column", count({c}) AS n, count(DISTINCT {c}) AS u, skewness({c}) AS sk,
kurtosis({c}) AS ku, count(*) FILTER (WHERE {c} = 0) / count({c}) AS z, bool_and({c} = floor({c})) AS whole,
min({c}) AS lo, max({c}) AS hi FROM e""" for i, c in enumerate(_CODED_NUMBERS))


@query("numeric_flags", _CODED + f""", s AS ({_coded_stats})
SELECT position, "column", abs(sk) >= 1 AS skewed, ku >= 3 AS heavy_tailed, z >= 0.3 AND u > 2 AS zero_inflated,
       u = 2 AS binary_flag, u = n AND whole AS unique_whole,
       n > 10 AND u = n AND whole AND lo >= 0 AND "column" IN ('event_id', 'user_id') AS identifier_like
FROM s""")
def numeric_flags(spark, folder):
    df = derived(spark, folder, "events", CODED_EVENTS)
    return rounded(numeric.numeric_flags(numeric.numeric_stats(df), profile.integer_valued(df)))


@query("scale_spread", f"""
WITH m AS ({union_all(f"SELECT greatest(abs(min({c})), abs(max({c})))::DOUBLE AS size FROM lineitem" for c in LINEITEM_NUMBERS)})
SELECT {rnd('min(size)', 4)} AS smallest_range, {rnd('max(size)', 4)} AS largest_range, {rnd('max(size) / min(size)', 2)} AS ratio,
       max(size) / min(size) >= 10000 AS wide_spread FROM m WHERE size > 0""")
def scale_spread(spark, folder):
    stats = numeric.numeric_stats(table(spark, folder, "lineitem"))
    return rounded(numeric.scale_spread(stats), 4, ratio=2)


_CLASSES = ["l_quantity", "l_discount", "two", "three", "one"]
_CLASS_EXPR = ["l_quantity", "nullif(l_discount, 0.0) as l_discount", "case when l_quantity > 10 then 1 else 0 end as two",
               "case when l_quantity > 30 then 2.5 when l_quantity > 10 then 1.5 else 0.5 end as three", "7 as one"]


@query("distinct_classes", f"WITH d AS ({sql('lineitem', _CLASS_EXPR)}), s AS (" + union_all(
    f"SELECT {i}::BIGINT AS position, '{c}' AS \"column\", least(count(DISTINCT {c}), 4) AS k FROM d"
    for i, c in enumerate(_CLASSES)) + """)
SELECT position, "column", k AS distinct_class, k = 2 AS binary_flag, k >= 4 AS outlier_eligible,
       k >= 2 AS correlation_eligible FROM s""")
def distinct_classes(spark, folder):
    return rounded(numeric.distinct_classes(derived(spark, folder, "lineitem", _CLASS_EXPR)))


_FENCE = """f AS (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS q2,
  quantile_cont({c}::DOUBLE, 0.75) AS q3, min({c}) AS lo, max({c}) AS hi, count({c}) AS n FROM {t})"""


@query("histogram", f"""
WITH {_FENCE.format(c='value', t='events')},
p AS (SELECT *, least(60, greatest(10, floor(sqrt(n))::INT + 1)) AS bins FROM f),
b AS (SELECT least(floor((value - lo) / ((hi - lo) / bins)), bins - 1)::BIGINT AS bin, value, p.* FROM events, p)
SELECT bin, {rnd('any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / any_value(bins))', 8)} AS low,
       {rnd('any_value(lo) + (bin + 1) * ((any_value(hi) - any_value(lo)) / any_value(bins))', 8)} AS high,
       count(*) AS n, count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers
FROM b GROUP BY bin""")
def histogram(spark, folder):
    return rounded(numeric.histogram(table(spark, folder, "events"), "value"), 8)


def _box(c):
    low, high = "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)"
    return f"""
SELECT '{c}' AS "column", {rnd('any_value(lo)', 4)} AS minimum, {rnd('any_value(q1)', 4)} AS q1,
  {rnd('any_value(q2)', 4)} AS median, {rnd('any_value(q3)', 4)} AS q3, {rnd('any_value(hi)', 4)} AS maximum,
  {rnd(f'any_value({low})', 4)} AS lower_fence, {rnd(f'any_value({high})', 4)} AS upper_fence,
  {rnd(f'min({c}) FILTER (WHERE {c} >= {low})', 4)} AS lower_whisker,
  {rnd(f'max({c}) FILTER (WHERE {c} <= {high})', 4)} AS upper_whisker,
  count(*) FILTER (WHERE {c} < {low} OR {c} > {high}) AS outside
FROM events_coded, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS q2,
  quantile_cont({c}::DOUBLE, 0.75) AS q3, min({c}) AS lo, max({c}) AS hi FROM events_coded) f"""


@query("box_summary", f"WITH events_coded AS ({sql('events', CODED_EVENTS)}) " + union_all(
    _box(c) for c in ("reading", "spend", "value")))
def box_summary(spark, folder):
    df = derived(spark, folder, "events", CODED_EVENTS)
    return rounded(numeric.box_summary(df, ["reading", "spend", "value"]), 4)


# the normal distribution function as its power series around 0
PHI = """0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * CASE WHEN z = 0 THEN 0 ELSE list_sum(list_transform(range(0, 80),
  lambda k: exp((2 * k + 1) * ln(abs(z)) + 0.5 * ln(pi()) - (k + 1) * ln(2) - lgamma(k + 1.5)))) END"""


@query("normality", f"""
WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS sd FROM lineitem),
v AS (SELECT (l_extendedprice - m) / sd AS z, row_number() OVER (ORDER BY l_extendedprice) AS i, count(*) OVER () AS n FROM lineitem, s WHERE l_extendedprice IS NOT NULL),
f AS (SELECT i, n, {PHI} AS p FROM v)
SELECT 'l_extendedprice' AS "column", any_value(n) AS n, {rnd('max(greatest(i / n - p, p - (i - 1) / n))')} AS statistic, 0.0::DOUBLE AS p_value FROM f""")
def normality(spark, folder):
    """Kolmogorov-Smirnov against the normal law; prices are far from it, so the p-value is 0 to six decimals."""
    return rounded(numeric.normality(table(spark, folder, "lineitem"), "l_extendedprice"))


# ---- categorical ---------------------------------------------------------------

def categorical_sql(source: str, columns: list[str], where: str = "") -> str:
    def one(i, c):
        return f"""
SELECT {i}::BIGINT AS position, '{c}' AS "column", count, total - count AS missing, n_unique,
  {rnd('coalesce(n_unique / nullif(count, 0), 0)')} AS unique_ratio, top_value, coalesce(top_count, 0)::BIGINT AS top_count,
  {rnd('coalesce(top_count / nullif(count, 0), 0)')} AS top_rate, second_value,
  {rnd('coalesce(second_count / nullif(count, 0), 0)')} AS second_rate, rare AS rare_categories,
  {rnd('CASE WHEN n_unique > 1 THEN bits WHEN count > 0 THEN 0.0 END')} AS entropy,
  coalesce(top_count / nullif(count, 0), 0) >= 0.9 AS is_dominant,
  count > 0 AND (n_unique >= 50 OR n_unique / count >= 0.5) AS is_high_cardinality
FROM (SELECT sum(n)::BIGINT AS count, count(*) AS n_unique, count(*) FILTER (WHERE n / t < 0.01) AS rare,
        -sum(n / t * log2(n / t)) AS bits, max(n) FILTER (WHERE k = 1) AS top_count, max(v) FILTER (WHERE k = 1) AS top_value,
        max(n) FILTER (WHERE k = 2) AS second_count, max(v) FILTER (WHERE k = 2) AS second_value
      FROM (SELECT v, n, sum(n) OVER () AS t, row_number() OVER (ORDER BY n DESC, v) AS k
            FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) a) b) s,
     (SELECT count(*) AS total FROM {source}) w"""
    return union_all(one(i, c) for i, c in enumerate(columns))


_PART = ["p_name", "p_brand", "p_type", "case when p_size > 2 then 'large' when p_size = 1 then 'tiny' end as size_class",
         "p_size > 25 as is_large"]


@query("categorical_stats", f"WITH p AS ({sql('part', _PART)}) " + categorical_sql(
    "p", ["p_name", "p_brand", "p_type", "size_class", "is_large"]))
def categorical_stats(spark, folder):
    return rounded(categorical.categorical_stats(derived(spark, folder, "part", _PART)))


@query("categorical_stats_texts", categorical_sql("documents", ["text", "lang", "source"]))
def categorical_stats_texts(spark, folder):
    return rounded(categorical.categorical_stats(table(spark, folder, "documents"), ["text", "lang", "source"]))


@query("rare_levels", f"""
WITH c AS (SELECT p_name AS v, count(*) AS n FROM part GROUP BY 1), o AS (SELECT p_brand AS v, count(*) AS n FROM part GROUP BY 1),
s AS (SELECT 0::BIGINT AS position, 'p_name' AS "column", count(*) AS u, count(*) FILTER (WHERE n / (SELECT sum(n) FROM c) < 0.01) AS r FROM c
      UNION ALL SELECT 1, 'p_brand', count(*), count(*) FILTER (WHERE n / (SELECT sum(n) FROM o) < 0.01) FROM o)
SELECT position, "column", r AS rare_categories, u AS n_unique FROM s WHERE r >= greatest(5, 0.3 * u)""")
def rare_levels(spark, folder):
    stats = categorical.categorical_stats(table(spark, folder, "part"), ["p_name", "p_brand"])
    return rounded(categorical.rare_heavy_columns(stats))


_RARE = ["cast(o_orderkey * 7 % 300 as varchar(9)) as many", "case when o_custkey % 50 = 0 then cast(o_custkey as varchar(9)) else 'usual' end as few", "o_orderpriority"]
_RARE_SQL = union_all(f"""SELECT {i}::BIGINT AS position, '{c}' AS "column", count(*) AS n_unique, count(*) FILTER (WHERE n / total < 0.01) AS rare_categories
  FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS total FROM r GROUP BY {c}) x""" for i, c in enumerate(names(_RARE)))


@query("rare_levels_found", f"""WITH r AS ({sql('orders', _RARE)}), s AS ({_RARE_SQL})
SELECT position, "column", rare_categories, n_unique FROM s WHERE rare_categories >= greatest(5, 0.3 * n_unique)""")
def rare_levels_found(spark, folder):
    """Columns that do have many rare levels."""
    return rounded(categorical.rare_heavy_columns(categorical.categorical_stats(derived(spark, folder, "orders", _RARE))))


@query("frequency_table", f"""
WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS place FROM c), t AS (SELECT sum(n) AS total, count(*) AS levels FROM c)
SELECT place AS position, value, n AS count, {rnd('n * 100 / total', 3)} AS percent FROM k, t WHERE place <= 20
UNION ALL
SELECT 21, '(other ' || (levels - 20) || ' categories)', (SELECT sum(n) FROM k WHERE place > 20)::BIGINT,
       {rnd('(SELECT sum(n) FROM k WHERE place > 20) * 100 / total', 3)} FROM t WHERE levels > 20""")
def frequency_table(spark, folder):
    return rounded(categorical.frequency_table(table(spark, folder, "part"), "p_brand"), 3)
