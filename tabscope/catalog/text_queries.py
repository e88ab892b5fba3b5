"""Content of text columns, delimited text, fingerprint."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscope.catalog import query, rnd, rounded, table, union_all
from tabscope.catalog.cleaning_queries import AMOUNTS, PARSED
from tabscope.catalog.derived import derived, sql
from tabscope.operators import profile
from tabscope.plans.stored import new_path
from tabscope.sources import delimited, sinks

TEXTS = [
    "concat('$', cast(value as varchar(20))) as amount",
    "cast(cast(ts as date) as varchar(10)) as day",
    "case when value > 60 then event_type else cast(user_id as varchar(9)) end as mixed",
    "case when user_id < 50 then 'yes' else 'No' end as answer",
    "cast(null as varchar(5)) as nothing",
    "concat('E-', cast(event_id as varchar(9))) as code",
    "props", "event_type", "user_id",
]
TEXT_NAMES = ["amount", "day", "mixed", "answer", "nothing", "code", "props", "event_type"]
WITH = f"WITH x AS ({sql('events', TEXTS)})"
PLAIN = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
HINT = ("'[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}|[0-9]{1,2}:[0-9]{2}"
        "|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec'")
PROBE = union_all(f"""
SELECT {i} AS position, '{c}' AS "column", count({c}) AS n, count(DISTINCT {c}) AS u,
  count(*) FILTER (WHERE regexp_matches(regexp_replace(translate(trim({c}), ', $', ''), '%$', ''), {PLAIN})) AS num,
  count(*) FILTER (WHERE regexp_matches(trim({c}), {PLAIN})) AS plain,
  count(*) FILTER (WHERE regexp_matches(lower({c}), {HINT})) AS hint, count(try_cast({c} AS DATE)) AS date,
  count(*) FILTER (WHERE lower({c}) IN ('true','false','yes','no','y','n','0','1','t','f')) AS word FROM x"""
                  for i, c in enumerate(TEXT_NAMES))


def texts(spark, folder):
    return derived(spark, folder, "events", TEXTS)


@query("text_probe", f"""{WITH}, p AS ({PROBE})
SELECT "column", n AS n_present, num AS n_number, plain AS n_plain_number, hint AS n_date_hint, date AS n_date, word AS n_boolean_word FROM p""")
def text_probe(spark, folder):
    return profile.text_probe(texts(spark, folder))


ISSUE = """CASE WHEN n > 0 AND num / n >= 0.9 THEN 'numeric_stored_as_text' WHEN n > 0 AND hint / n >= 0.8 AND date / n >= 0.9 THEN 'datetime_stored_as_text'
  WHEN n > 0 AND plain / n > 0.05 AND plain / n < 0.95 THEN 'mixed_types' END"""


@query("column_roles", f"""{WITH}, p AS ({PROBE})
SELECT position::BIGINT AS position, "column", 'string' AS spark_type,
  CASE WHEN n = 0 THEN 'empty' WHEN {ISSUE} = 'datetime_stored_as_text' THEN 'datetime' WHEN num / n >= 0.9 AND u / n > 0.5 THEN 'text-like'
       WHEN word / n > 0.95 THEN 'categorical' WHEN u / n > 0.5 AND u > 20 THEN 'text-like' ELSE 'categorical' END AS role FROM p
UNION ALL SELECT 8, 'user_id', 'bigint', 'numeric'""")
def column_roles(spark, folder):
    return rounded(profile.column_roles(texts(spark, folder)).drop("text_like"))


def _smallest(c, k):
    return f"(SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM x WHERE {c} IS NOT NULL ORDER BY v LIMIT {k}) s)"


@query("dtype_issues", f"""{WITH}, p AS ({PROBE}), i AS (SELECT *, {ISSUE} AS issue FROM p)
SELECT "column", issue, CASE issue WHEN 'numeric_stored_as_text' THEN 'double' WHEN 'datetime_stored_as_text' THEN 'timestamp' ELSE 'mixed' END AS suggested_dtype,
  {rnd("CASE issue WHEN 'numeric_stored_as_text' THEN num WHEN 'datetime_stored_as_text' THEN date ELSE plain END / n")} AS affected_rate,
  CASE "column" WHEN 'amount' THEN {_smallest('amount', 3)} WHEN 'day' THEN {_smallest('day', 3)} WHEN 'mixed' THEN {_smallest('mixed', 5)} END AS examples
FROM i WHERE issue IS NOT NULL""")
def dtype_issues(spark, folder):
    issues = profile.dtype_issues(texts(spark, folder))
    return rounded(issues.select("column", "issue", "suggested_dtype", "affected_rate",
                                 F.array_join("example_values", "|").alias("examples")))


@query("number_text_columns", f"""{WITH}, p AS ({PROBE}) SELECT "column" FROM p WHERE n > 0 AND num / n >= 0.9 AND "column" <> 'code'""")
def number_text_columns(spark, folder):
    return profile.number_text_columns(texts(spark, folder))


@query("parse_numbers", f"""WITH a AS ({sql('events', AMOUNTS)})
SELECT event_type, count(*) AS n, count(parsed) AS n_parsed, count(*) FILTER (WHERE parsed < 0) AS n_negative, {rnd('sum(parsed)', 2)} AS total
FROM {PARSED} p GROUP BY event_type""")
def parse_numbers(spark, folder):
    from tabscope.functions.columns import parse_number
    df = derived(spark, folder, "events", AMOUNTS).withColumn("parsed", parse_number(F.col("amount")))
    return rounded(df.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count("parsed").alias("n_parsed"), F.count_if(F.col("parsed") < 0).alias("n_negative"),
        F.sum("parsed").alias("total")), 2)


@query("name_tokens", """
SELECT column_name AS "column", array_to_string(list_filter(string_split(lower(column_name), '_'), lambda t: t <> ''), ' ') AS words
FROM (SELECT unnest(['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority']) AS column_name) c""")
def name_tokens(spark, folder):
    words = profile.name_words(profile.column_roles(table(spark, folder, "orders")))
    return words.select("column", F.array_join("words", " ").alias("words"))


# ---- delimited text: the events table is written as text and read back -----------

def _lines(spark, folder, separator=";"):
    """Events as delimited text with a repeated header, markers, blanks, short and long lines."""
    path = new_path(spark, "lines")
    e = table(spark, folder, "events")
    field = F.concat_ws(separator, F.col("event_id"), F.when(F.col("value") > 150, "NA").otherwise(F.col("event_type")),
                        F.concat(F.col("user_id"), F.when(F.col("user_id") < 10, " ").otherwise("")),
                        F.when(F.col("value") < 2, "").otherwise(F.col("value").cast("string")))
    line = (F.when(F.col("value") > 250, F.concat(field, F.lit(separator + "extra")))
            .when(F.col("value") > 240, F.concat_ws(separator, "event_id", "event_type"))
            .when(F.col("value") < 0.5, F.lit(separator * 3)).otherwise(field))
    header = separator.join(["event_id", " kind ", "user", "kind"])
    # one column named like the header: the writer then starts every file with it
    (e.select(line.alias(header)).write.option("header", True).option("sep", "\u0001").option("quote", "\u0000")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


_SHAPE = """x AS (SELECT * FROM events WHERE value <= 250 AND value >= 0.5)"""


@query("delimited_table", f"""WITH {_SHAPE}
SELECT event_id, CASE WHEN value > 240 THEN event_type WHEN value > 150 THEN NULL ELSE event_type END AS kind,
  CASE WHEN value > 240 THEN NULL ELSE user_id END AS "user",
  CASE WHEN value > 240 OR value < 2 THEN NULL ELSE value END AS kind_duplicate_1 FROM x""")
def delimited_table(spark, folder):
    return delimited.read_delimited(spark, _lines(spark, folder)).frame


@query("delimited_notes", """
SELECT * FROM (
  SELECT 'headers_normalised' AS note_code, '' AS "column", 0::BIGINT AS n
  UNION ALL SELECT 'rows_too_long', '', count(*) FROM events WHERE value > 250
  UNION ALL SELECT 'rows_too_short', '', count(*) FROM events WHERE value > 240 AND value <= 250
  UNION ALL SELECT 'rows_empty', '', count(*) FROM events WHERE value < 0.5
  UNION ALL SELECT 'delimiter_guessed', '', 0 WHERE false
  UNION ALL SELECT 'values_trimmed', 'user', count(*) FROM events WHERE user_id < 10 AND value <= 240 AND value >= 0.5) t
WHERE note_code = 'headers_normalised' OR n > 0""")
def delimited_notes(spark, folder):
    notes = delimited.read_delimited(spark, _lines(spark, folder), ";").notes
    return notes.select("note_code", F.coalesce("column", F.lit("")).alias("column"), F.coalesce("n", F.lit(0)).alias("n"))


@query("delimiter_detected", "SELECT ';' AS delimiter, count(*) > 0 AS found FROM events")
def delimiter_detected(spark, folder):
    lines = spark.read.text(_lines(spark, folder))
    return spark.createDataFrame([(delimited.detect_delimiter(lines)[0], True)], "delimiter string, found boolean")


@query("delimited_reordered", """SELECT p_partkey, p_retailprice, p_size::BIGINT AS p_size, CASE WHEN p_size > 25 THEN p_brand END AS p_brand FROM part""")
def delimited_reordered(spark, folder):
    """Two sets of files whose headers differ in order and columns, read as one folder."""
    path, part = new_path(spark, "reordered"), table(spark, folder, "part")
    part.where("p_size <= 25").select("p_partkey", "p_retailprice", "p_size").write.option("header", True).csv(path)
    part.where("p_size > 25").select("p_size", "p_brand", "p_retailprice", "p_partkey").write.mode("append").option("header", True).csv(path)
    return delimited.read_delimited(spark, path, ",").frame


@query("delimited_undecodable", "SELECT 'undecodable' AS note_code, count(*) AS n FROM part WHERE p_size <= 25")
def delimited_undecodable(spark, folder):
    """Rows written in another encoding than they are read in."""
    path = new_path(spark, "latin")
    name = F.when(F.col("p_size") <= 25, F.concat("p_name", F.lit(" caf\u00e9"))).otherwise(F.col("p_name"))
    table(spark, folder, "part").select("p_partkey", name.alias("name")).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return delimited.read_delimited(spark, path, ",").notes.where("note_code = 'undecodable'").select("note_code", "n")


@query("delimited_index_column", "SELECT p_size::BIGINT AS p_size, p_brand FROM part")
def delimited_index_column(spark, folder):
    """A first column without a name is a row index and goes."""
    path, comma = new_path(spark, "index"), F.lit(",")
    line = F.concat(F.col("p_partkey").cast("string"), comma, F.col("p_size").cast("string"), comma, F.col("p_brand"))
    (table(spark, folder, "part").select(line.alias(",p_size,p_brand")).write.option("header", True).option("sep", "\u0001")
     .option("quote", "\u0000").csv(path))
    return delimited.read_delimited(spark, path, ",").frame


@query("preview_rows", "SELECT least(count(*), 7) AS n_rows FROM part")
def preview_rows(spark, folder):
    return sinks.preview(table(spark, folder, "part"), 7).agg(F.count("*").alias("n_rows"))


@query("delimited_limited", "SELECT least(count(*), 50) AS n_rows, max(CASE WHEN total > 50 THEN 50 END) AS limited FROM (SELECT *, count(*) OVER () AS total FROM part) p")
def delimited_limited(spark, folder):
    """The optional limit on rows, and its note."""
    path = new_path(spark, "limited")
    sinks.write_csv(table(spark, folder, "part"), path)
    loaded = delimited.read_delimited(spark, path, ",", max_rows=50)
    limited = loaded.notes.where("note_code = 'rows_limited'").agg(F.max("n").alias("limited"))
    return loaded.frame.agg(F.count("*").alias("n_rows")).join(F.broadcast(limited))


@query("written_csv", "SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part")
def written_csv(spark, folder):
    path = new_path(spark, "csv")
    sinks.write_csv(table(spark, folder, "part"), path)
    return delimited.read_delimited(spark, path, ",").frame


@query("written_tables", f"SELECT o_orderkey, {rnd('o_totalprice')} AS o_totalprice FROM orders")
def written_tables(spark, folder):
    path = new_path(spark, "tables")
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    sinks.write_tables({"orders": df}, path, "json")
    return rounded(spark.read.schema(df.schema).json(f"{path}/orders"))


def _fingerprint_sql(name: str, columns: dict[str, str]) -> str:
    row = ", ".join(f"coalesce({c}::VARCHAR, chr(0))" for c in columns)
    schema = ",".join(f"{c}:{t}" for c, t in columns.items())
    return f"""WITH h AS (SELECT count(*) AS n_rows, sum(('0x' || substr(md5(concat_ws(chr(31), {row})), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS hash_sum FROM {name})
SELECT n_rows, hash_sum, substr(sha256('{schema}|' || n_rows || '|' || hash_sum), 1, 16) AS fingerprint FROM h"""


@query("fingerprint", _fingerprint_sql("lineitem", {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
    "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}))
def fingerprint(spark, folder):
    return sinks.fingerprint(table(spark, folder, "lineitem"))
