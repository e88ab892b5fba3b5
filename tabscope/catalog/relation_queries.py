"""Correlation and association."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tabscope.catalog import query, rnd, rounded, table, union_all
from tabscope.catalog.derived import WIDE_LINEITEM, derived, names, sql
from tabscope.operators import association, correlation, findings, leakage, outliers
from tabscope.settings import Settings

WIDE = names(WIDE_LINEITEM)
WITH = f"WITH d AS ({sql('lineitem', WIDE_LINEITEM)})"
LABELS = """CASE WHEN abs(r) >= 0.95 THEN 'near-perfect' WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate'
  WHEN abs(r) >= 0.3 THEN 'weak' ELSE 'very weak' END AS strength, CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction"""


def wide(spark, folder):
    return derived(spark, folder, "lineitem", WIDE_LINEITEM)


def pearson_sql(source: str, columns) -> str:
    return union_all(f"""SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r,
  count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM {source}""" for a, b in combinations(columns, 2))


def spearman_sql(source: str, columns) -> str:
    def one(a, b):
        return f"""SELECT '{a}' AS column_a, '{b}' AS column_b, corr(ra, rb) AS r, count(*) AS n FROM (
  SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS ra,
         rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS rb
  FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) x"""
    return union_all(one(a, b) for a, b in combinations(columns, 2))


def kendall_sql(source: str, columns) -> str:
    """Brute force over distinct value pairs, which are few for the columns used."""
    def one(a, b):
        return f"""SELECT '{a}' AS column_a, '{b}' AS column_b, (
    (SELECT sum(p.n::DOUBLE * q.n * sign(p.x - q.x) * sign(p.y - q.y)) / 2 FROM c p, c q)
    / sqrt((t - (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n)::DOUBLE AS m FROM c GROUP BY x) u))
         * (t - (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n)::DOUBLE AS m FROM c GROUP BY y) u)))) AS r, total::BIGINT AS n
  FROM (SELECT sum(n)::DOUBLE * (sum(n)::DOUBLE - 1) / 2 AS t, sum(n) AS total FROM c) w"""
    return union_all(f"SELECT * FROM (WITH c AS (SELECT {a} AS x, {b} AS y, count(*) AS n FROM {source} "
                     f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2) {one(a, b)}) k" for a, b in combinations(columns, 2))


def labelled(name: str, digits: int = 6) -> str:
    return f"""SELECT column_a, column_b, {rnd('r', digits)} AS r, {rnd('abs(r)', digits)} AS abs_r, n AS n_observations, n >= 10 AS reliable,
  {LABELS} FROM {name}"""


@query("correlation_pearson", f"{WITH}, p AS ({pearson_sql('d', WIDE)}) {labelled('p')}")
def correlation_pearson(spark, folder):
    return rounded(correlation.correlation_pairs(wide(spark, folder), with_p=False).drop("p_value"))


_RANKED = ["l_quantity", "l_extendedprice", "discount", "quantity_near"]


@query("correlation_spearman", f"{WITH}, p AS ({spearman_sql('d', _RANKED)}) {labelled('p')}")
def correlation_spearman(spark, folder):
    return rounded(correlation.correlation_pairs(wide(spark, folder), _RANKED, "spearman", with_p=False).drop("p_value"))


_FEW = ["l_quantity", "l_tax", "quantity_near"]


@query("correlation_kendall", f"{WITH}, p AS ({kendall_sql('d', _FEW)}) {labelled('p')}")
def correlation_kendall(spark, folder):
    return rounded(correlation.correlation_pairs(wide(spark, folder), _FEW, "kendall", with_p=False).drop("p_value"))


# Student's t tail is a finite sum for whole degrees of freedom, of one form for even and one for odd ones
T_TAIL = """greatest(0.0, 1 - CASE WHEN n % 2 = 0 THEN abs(r) * list_sum(list_transform(range(0, ((n - 2) // 2)::BIGINT),
    lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow(1 - r * r, k)))
  ELSE 2 / pi() * (asin(abs(r)) + abs(r) * sqrt(1 - r * r) * coalesce(list_sum(list_transform(range(0, ((n - 3) // 2)::BIGINT),
    lambda k: exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * sqrt(pi()) / 2 * pow(1 - r * r, k))), 0)) END)"""
_TAILS = ["s_suppkey", "s_acctbal", "s_acctbal * (1 + s_nationkey % 5) as scaled", "s_acctbal * s_acctbal as squared",
          "s_suppkey * (7 + s_nationkey % 7) as mixed"]


@query("correlation_p_values", f"""WITH d AS ({sql('supplier', _TAILS)}), p AS ({pearson_sql('d', names(_TAILS))}),
v AS (SELECT *, {T_TAIL} AS tail FROM p), t AS ({labelled('p')})
SELECT t.*, {rnd('v.tail')} AS p_value FROM t JOIN v ON t.column_a = v.column_a AND t.column_b = v.column_b""")
def correlation_p_values(spark, folder):
    """Student's t tail of every pair."""
    return rounded(correlation.correlation_pairs(derived(spark, folder, "supplier", _TAILS)))


#: Thirty columns, all but the first few with gaps of their own.
GAPPED = [f"case when (l_orderkey + l_linenumber * {i + 1}) % {9 - i % 7} <> {i % 2} or {i} < 4 then l_quantity * {i % 5} + (l_partkey * {i + 3}) % {11 + 2 * i} "
          f"+ l_extendedprice * {i % 3} / 1000 end as g{i:02d}" for i in range(30)]


@query("correlation_pearson_gaps", f"WITH d AS ({sql('lineitem', GAPPED)}), p AS ({pearson_sql('d', names(GAPPED))}) {labelled('p')}")
def correlation_pearson_gaps(spark, folder):
    """All pairs of thirty columns with gaps, from one scan of products."""
    return rounded(correlation.correlation_pairs(derived(spark, folder, "lineitem", GAPPED), with_p=False).drop("p_value"))


#: Ten columns of some ten to a hundred values, with gaps and ties.
TIED = [f"case when (l_orderkey + {i}) % {4 + i} > 0 then (l_quantity * {1 + i % 3} + l_linenumber * {i} + l_partkey % {3 + i}) % {12 + 9 * i} end as t{i}" for i in range(10)]


@query("correlation_spearman_gaps", f"WITH d AS ({sql('lineitem', TIED)}), p AS ({spearman_sql('d', names(TIED))}) {labelled('p')}")
def correlation_spearman_gaps(spark, folder):
    """Ranks within the rows of each pair."""
    return rounded(correlation.correlation_pairs(derived(spark, folder, "lineitem", TIED), method="spearman", with_p=False).drop("p_value"))


@query("correlation_kendall_gaps", f"WITH d AS ({sql('lineitem', TIED)}), p AS ({kendall_sql('d', names(TIED))}) {labelled('p')}")
def correlation_kendall_gaps(spark, folder):
    """Discordant pairs of all pairs of ten columns together."""
    return rounded(correlation.correlation_pairs(derived(spark, folder, "lineitem", TIED), method="kendall", with_p=False).drop("p_value"))


_NATIONS = "SELECT avg(c_acctbal) AS mean, max(c_acctbal) AS high, sum(c_acctbal * c_custkey) AS mixed, min(c_custkey + c_acctbal) AS low FROM customer GROUP BY c_nationkey"
_NATION_NAMES = ["mean", "high", "mixed", "low"]


@query("kendall_exact_p_values", f"""WITH RECURSIVE d AS ({_NATIONS}), orders(size, ways) AS (
  SELECT 1, [1.0::DOUBLE] UNION ALL
  SELECT size + 1, list_transform(range(0, len(ways) + size), lambda k: list_sum(ways[greatest(1, k - size + 1):least(len(ways), k + 1)])) FROM orders WHERE size < 33
), counted AS ({union_all(f"SELECT '{a}' AS column_a, '{b}' AS column_b, count(*) FILTER (x.{a} < y.{a} AND x.{b} > y.{b}) AS dis, (SELECT count(*) FROM d) AS n FROM d x, d y" for a, b in combinations(_NATION_NAMES, 2))}
), told AS (
  SELECT *, least(dis, n * (n - 1) / 2 - dis)::BIGINT AS fewest, 1 - 4 * dis / (n * (n - 1)) AS r FROM counted
)
SELECT column_a, column_b, {rnd('r')} AS r, n AS n_observations,
  {rnd('CASE WHEN 4 * fewest = n * (n - 1) THEN 1.0 ELSE least(1.0, 2 * list_sum(ways[1:fewest + 1]) / list_sum(ways)) END')} AS p_value
FROM told JOIN orders ON size = n""")
def kendall_exact_p_values(spark, folder):
    """Kendall's tau between a few numbers of each nation's customers, none of them tied: p-values by counting orders."""
    customer = table(spark, folder, "customer")
    nations = customer.groupBy("c_nationkey").agg(
        F.avg("c_acctbal").alias("mean"), F.max("c_acctbal").alias("high"), F.sum(F.col("c_acctbal") * F.col("c_custkey")).alias("mixed"),
        F.min(F.col("c_custkey") + F.col("c_acctbal")).alias("low")).drop("c_nationkey")
    return rounded(correlation.correlation_pairs(nations, _NATION_NAMES, "kendall")).select("column_a", "column_b", "r", "n_observations", "p_value")


@query("correlation_strong_pairs", f"""{WITH}, p AS ({pearson_sql('d', WIDE)})
SELECT pair_set, column_a, column_b, {rnd('r')} AS r, {rnd('abs(r)')} AS abs_r, n AS n_observations FROM (
  SELECT 'strong_positive' AS pair_set, * FROM p WHERE r >= 0.7 UNION ALL SELECT 'strong_negative', * FROM p WHERE r <= -0.7
  UNION ALL SELECT 'multicollinear', * FROM p WHERE abs(r) >= 0.8 UNION ALL SELECT 'near_duplicate', * FROM p WHERE abs(r) >= 0.995) s""")
def correlation_strong_pairs(spark, folder):
    return rounded(correlation.strong_pairs(correlation.correlation_pairs(wide(spark, folder), with_p=False)))


@query("correlation_top_pairs", f"""{WITH}, p AS ({pearson_sql('d', WIDE)})
SELECT column_a, column_b, {rnd('r', 4)} AS r, {rnd('abs(r)', 4)} AS abs_r, {LABELS}, n AS n_observations
FROM p ORDER BY abs(p.r) DESC, column_a, column_b LIMIT 25""")
def correlation_top_pairs(spark, folder):
    pairs = correlation.correlation_pairs(wide(spark, folder), with_p=False)
    return rounded(correlation.top_pairs(pairs).drop("p_value"), 4)


_M = ["l_quantity", "l_extendedprice", "l_tax"]


@query("correlation_matrix", union_all(
    f"SELECT '{a}' AS \"column\", " + ", ".join(rnd("1.0" if a == b else f"corr({a}, {b})") + f" AS {b}" for b in _M)
    + " FROM lineitem" for a in _M))
def correlation_matrix(spark, folder):
    pairs = correlation.correlation_pairs(table(spark, folder, "lineitem"), _M, with_p=False)
    return rounded(correlation.correlation_matrix(pairs, _M))


@query("scatter_rows", f"""SELECT user_id::DOUBLE AS x, value AS y, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS flagged,
  event_type AS color FROM events, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events) q
WHERE user_id IS NOT NULL AND value IS NOT NULL""")
def scatter_rows(spark, folder):
    """All points of two columns, marked by the IQR rule."""
    df = table(spark, folder, "events")
    low, high = outliers.fences(df, ["value"])["value"]
    return correlation.scatter_rows(df, "user_id", "value", flag=(F.col("value") < low) | (F.col("value") > high),
                                    color="event_type")


# ---- association ---------------------------------------------------------------

GRADED = ["l_returnflag", "l_linestatus", "cast(l_linenumber as varchar(5)) as line",
          "case when l_quantity > 25 then 'many' else 'few' end as amount",
          "case when l_quantity > 30 then 'bulk' when l_quantity > 5 then 'usual' end as size_class"]
GRADE_NAMES = names(GRADED)


def association_sql(source: str, columns) -> str:
    def one(a, b):
        return f"""SELECT '{a}' AS column_a, '{b}' AS column_b, total AS n, lr, lk,
  greatest(total * ((SELECT sum(n * n / (ra * cb)) FROM (SELECT n::DOUBLE AS n, sum(n) OVER (PARTITION BY a)::DOUBLE AS ra, sum(n) OVER (PARTITION BY b)::DOUBLE AS cb FROM c) m) - 1), 0) AS chi2
  FROM (SELECT sum(n)::BIGINT AS total, count(DISTINCT a) AS lr, count(DISTINCT b) AS lk FROM c) w"""
    return union_all(f"SELECT * FROM (WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {source} "
                     f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2) {one(a, b)}) k" for a, b in combinations(columns, 2))


V = """CASE WHEN lr < 2 OR lk < 2 THEN 0.0 ELSE sqrt(greatest(0.0, chi2 / n - (lk - 1) * (lr - 1) / (n - 1))
  / least(lk - (lk - 1) * (lk - 1) / (n - 1) - 1, lr - (lr - 1) * (lr - 1) / (n - 1) - 1)) END"""
# the chi-square tail has a closed form for even degrees of freedom
EVEN_P = "exp(-chi2 / 2) * list_sum(list_transform(range(0, ((lr - 1) * (lk - 1) / 2)::BIGINT), lambda i: pow(chi2 / 2, i) / gamma(i + 1)))"


@query("associations", f"""WITH d AS ({sql('lineitem', GRADED)}), t AS ({association_sql('d', GRADE_NAMES)})
SELECT column_a, column_b, {rnd(V, 4)} AS cramers_v, n AS n_observations, lr AS levels_a, lk AS levels_b,
  ((lr - 1) * (lk - 1))::BIGINT AS dof FROM t""")
def associations(spark, folder):
    return rounded(association.associations(derived(spark, folder, "lineitem", GRADED)).drop("p_value"), 4)


@query("chi_square_test", f"""WITH d AS ({sql('lineitem', GRADED)}), t AS ({association_sql('d', ['l_returnflag', 'line'])})
SELECT column_a, column_b, {rnd('chi2', 4)} AS chi2, ((lr - 1) * (lk - 1))::BIGINT AS dof, {rnd(EVEN_P)} AS p_value,
  {rnd(V)} AS cramers_v, n AS n_observations, lr AS levels_a, lk AS levels_b FROM t""")
def chi_square_test(spark, folder):
    return rounded(association.chi_square_test(derived(spark, folder, "lineitem", GRADED), "l_returnflag", "line"), 6, chi2=4)


@query("contingency_table", "SELECT l_returnflag AS a, l_linenumber::BIGINT AS b, count(*) AS n FROM lineitem GROUP BY 1, 2")
def contingency_table(spark, folder):
    return rounded(association.contingency(table(spark, folder, "lineitem"), "l_returnflag", "l_linenumber"))


@query("association_columns", f"""WITH d AS ({sql('lineitem', GRADED)}) """ + union_all(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS levels FROM d HAVING count(DISTINCT {c}) BETWEEN 2 AND 40" for c in GRADE_NAMES))
def association_columns(spark, folder):
    levels = association.association_columns(derived(spark, folder, "lineitem", GRADED))
    return spark.createDataFrame(list(levels.items()), "column string, levels bigint")


#: More columns than any earlier limit: 18 of few levels, and one of too many to be compared.
MANY = [f"cast((l_orderkey * {i + 3} + l_partkey * {i + 1} + l_linenumber) % {2 + i % 4} as varchar(9)) as k{i:02d}" for i in range(18)]
LEVELS = [*MANY, "cast(l_orderkey as varchar(20)) as many", "'x' as one"]


@query("associations_many_columns", f"""WITH d AS ({sql('lineitem', MANY)}), t AS ({association_sql('d', names(MANY))})
SELECT column_a, column_b, {rnd(V, 4)} AS cramers_v, n AS n_observations, lr AS levels_a, lk AS levels_b,
  ((lr - 1) * (lk - 1))::BIGINT AS dof FROM t""")
def associations_many_columns(spark, folder):
    return rounded(association.associations(derived(spark, folder, "lineitem", MANY)).drop("p_value"), 4)


#: Columns of 4, 45, 200 and nearly as many levels as rows, two of them with gaps.
ANY = ["cast(l_linenumber % 4 as varchar(9)) as few", "cast((l_partkey * 7 + l_linenumber) % 45 as varchar(9)) as more",
       "case when l_quantity > 3 then cast((l_orderkey * 3 + l_partkey) % 200 as varchar(9)) end as many",
       "case when l_tax > 0 then cast((l_orderkey + l_linenumber) % 90 as varchar(9)) end as related", "cast(l_orderkey * 10 + l_linenumber as varchar(20)) as own"]
_ANY = names(ANY)[:-1]
ANY_LEVELS = Settings(association_levels=None)


@query("associations_any_levels", f"""WITH d AS ({sql('lineitem', ANY)}), t AS ({association_sql('d', _ANY)})
SELECT column_a, column_b, {rnd(V, 4)} AS cramers_v, n AS n_observations, lr AS levels_a, lk AS levels_b,
  ((lr - 1) * (lk - 1))::BIGINT AS dof FROM t""")
def associations_any_levels(spark, folder):
    """Columns of any number of levels; only the nearly distinct one is left out."""
    found = association.associations(derived(spark, folder, "lineitem", ANY), names(ANY), settings=ANY_LEVELS)
    return rounded(found.drop("p_value"), 4)


@query("findings_left_out", f"""WITH d AS ({sql('lineitem', ANY)}), o AS ({sql('orders', ["o_orderstatus", "o_orderpriority", "cast(o_custkey as varchar(20)) as customer", "case when o_totalprice > 150000 then 1 else 0 end as is_big"])}),
a AS ({union_all(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS n FROM d" for c in names(ANY))}),
s AS ({union_all(f"SELECT '{c}' AS name, count(DISTINCT {c}) AS n FROM o" for c in ('o_orderstatus', 'o_orderpriority', 'customer'))}),
w AS (SELECT 'associations' AS category, 'categorical column(s) not compared' AS title, name, n, 'more than 40 levels' AS reason,
        'Group rare levels first if these columns matter.' AS recommendation FROM a WHERE n > 40
  UNION ALL SELECT 'leakage', 'text feature(s) not tested for separation', name, n, 'more than 200 levels',
        'Check by hand whether their values give the target away.' FROM s WHERE n > 200)
SELECT category, count(*)::VARCHAR || ' ' || title AS title, string_agg(name || ' (' || reason || ')', ', ' ORDER BY name) || '.' AS detail,
  'info' AS severity, '{{"columns":[' || string_agg('{{"column":"' || name || '","n_unique":' || n || ',"reason":"' || reason || '"}}', ',' ORDER BY name) || ']}}' AS evidence,
  recommendation FROM w GROUP BY category, title, recommendation""")
def findings_left_out(spark, folder):
    """What a whole run says about columns it could not compare for their levels."""
    columns = association.association_levels(derived(spark, folder, "lineitem", ANY), names(ANY))
    orders = derived(spark, folder, "orders", ["o_orderstatus", "o_orderpriority", "cast(o_custkey as varchar(20)) as customer",
                                               "case when o_totalprice > 150000 then 1 else 0 end as is_big"])
    found = findings.left_out_findings(columns, leakage.separation_levels(orders, "is_big"))
    return found.select("category", "title", "detail", "severity", "evidence", "recommendation")


@query("association_levels", f"""WITH d AS ({sql('lineitem', LEVELS)}) """ + union_all(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique, count(DISTINCT {c}) BETWEEN 2 AND 40 AS available,
  CASE WHEN count(DISTINCT {c}) < 2 THEN 'fewer than two levels' WHEN count(DISTINCT {c}) > 40 THEN 'more than 40 levels' ELSE '' END AS reason
FROM d""" for c in names(LEVELS)))
def association_levels(spark, folder):
    return association.association_levels(derived(spark, folder, "lineitem", LEVELS), names(LEVELS))
