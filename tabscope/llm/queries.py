"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabscope.llm import chat, decontaminate, html_text, line_dedup, phrases, pieces, quality_rules, quality_trees, repair, sharding, simhash, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_sharding")
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return sharding.shuffled(documents, "doc_id", shards=16).select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"), "shard", "slot", "grown_shard", "bucket")


@query("op2_chat_formatting")
def op2_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one more, -1, whose texts hold the template's control strings."""
    hard = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    summary = chat.read_back(chat.formatted(turns))
    conv_id = F.get_json_object("conv", "$.id").cast("bigint").alias("conv_id")
    return summary.select(conv_id, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows")


@query("op3_html_extraction")
def op3_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html_text.main_text(pages).withColumn("n_chars", F.length("text").cast("bigint"))


@query("op4_benchmark_decontamination", r"""
WITH doc_words AS (
  SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), docs AS (
  SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n FROM doc_words
), items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, w, least(len(w), 10) AS size FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, size, array_to_string(w[pos:pos + size - 1], ' ') AS words FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM items)
), places AS (
  SELECT r, size, pos, array_to_string(w[pos:pos + size - 1], ' ') AS words FROM (
    SELECT r, w, size, unnest(range(1, n - size + 2)) AS pos FROM docs, (SELECT DISTINCT size FROM items) WHERE n >= size)
), found AS (
  SELECT r, item, p.size AS size, pos FROM places p JOIN windows USING (size, words)
), hit AS (
  SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(pos, pos + size)) AS word FROM found) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT doc_id, n::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)""")
def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.scan(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, span: n + span["beyond"] - span["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


#: Rules on hosts and paths.
ALLOWED_URLS = ["org/", "com/fr/"]
BLOCKED_URLS = ["example.org/es/", "example.org/en/1", "com/de/"]


@query("op5_url_filters", """
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS whole FROM pages
), parts AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(translate(regexp_extract(whole, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(substr(whole, length(regexp_extract(whole, '^[^/]*')) + 1), '') AS path FROM cut
), rules(rule, of_host, of_path, verdict) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
         ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
), best AS (
  SELECT r, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM parts JOIN rules ON (host = of_host OR ends_with(host, '.' || of_host)) AND starts_with(path, of_path) GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (r)""")
def op5_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judge(pages, ALLOWED_URLS, BLOCKED_URLS).drop("url")


@query("op6_sentencepiece_codec")
def op6_sentencepiece_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and digests of the ids and of the text they decode to, and whether it is the document's."""
    documents = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"), "text")
    decoded = pieces.round_trip(documents, decoded="text")
    return decoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        F.length("text").cast("bigint").alias("decoded_chars"), F.sha2("text", 256).alias("decoded_sha256"),
        F.sha2("text", 256).eqNullSafe(F.col("text_sha256")).alias("lossless"))


@query("op7_line_dedup", """
WITH lines AS (
  SELECT doc_id, text, source, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents
), cleaned AS (
  SELECT doc_id, text, source, raw, line_no, trim(raw, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM lines
), common AS (
  SELECT line, min((doc_id, line_no)) AS first FROM cleaned WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce('=' || source, '')) >= 10
), marked AS (
  SELECT c.*, m.line IS NOT NULL AND (c.doc_id, c.line_no) <> m.first AS gone FROM cleaned c LEFT JOIN common m ON c.line = m.line
), kept AS (
  SELECT doc_id, text, coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS kept,
         count(*) AS n_lines, count(*) FILTER (gone) AS n_removed
  FROM marked GROUP BY doc_id, text
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, length(k.kept)::BIGINT AS kept_chars,
       sha256(k.kept) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id AND d.text = k.text""")
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "source")
    return line_dedup.remove_boilerplate(documents).select(
        "doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    return toxicity.scored(documents, labels.select("doc_id", "toxic")).drop("text")


@query("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.with_component(table(spark, folder, "documents").select("doc_id", "text"))


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return quality_rules.judge(documents).drop("text", "lang")


@query("op11_phrase_collocations", r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL
), words AS (
  SELECT lang, w FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces) WHERE len(w) > 0
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), counts AS (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, array_to_string(w[pos:pos + size - 1], ' ') AS phrase
    FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM words, (VALUES (1), (2), (3)) sizes(size)))
  GROUP BY lang, size, phrase
), phrases AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 10
), around AS (
  SELECT lang, inside, max(a) AS most FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS inside FROM phrases WHERE size = 3) GROUP BY lang, inside
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS one, array_to_string(w[k + 1:size], ' ') AS two
  FROM (SELECT p.*, unnest(range(1, size)) AS k FROM phrases p LEFT JOIN around o ON p.lang = o.lang AND p.phrase = o.inside
        WHERE o.most IS NULL OR 100 * o.most < 50 * a)
), scored AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON c.lang = x.lang AND c.one = x.phrase JOIN counts y ON c.lang = y.lang AND c.two = y.phrase
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) JOIN totals USING (lang) WHERE rank <= 2000""")
def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents").select("lang", "text"))


@query("op13_quality_classifier")
def op13_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    return quality_trees.scored(documents, labels.select("doc_id", "quality")).drop("text")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with one row in twenty dropped, emptied, without its sentence marks, repeated, or called user's."""
    def part(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"),
                        F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20)).alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("damage") == 3, 2).otherwise(1)
    return rows.where("damage <> 0").select(
        "conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.sequence(F.lit(1), times)).alias("time")).drop("time")


@query("op12_conversation_repair", r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, x: CASE WHEN (c & 1) = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(n))
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, t,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT) AS codes
  FROM conversations, crc_table
), marked AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295, codes),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS damage FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE damage WHEN 3 THEN 2 ELSE 1 END)) AS again FROM marked WHERE damage <> 0
), placed AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), faults AS (
  SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS seen, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut_off, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before FROM placed
), symbols AS (
  SELECT *, blank OR seen AS gone, CASE WHEN cut_off THEN 5 ELSE 0 END AS extra FROM faults
), counts AS (
  SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (NOT blank AND seen) AS duplicate, count(*) FILTER (NOT gone AND cut_off) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM symbols GROUP BY c
), back(c, i, w0, w1, w2, w3) AS (
  SELECT c, n, {'v': 0, 's': ''}, {'v': 10, 's': 'II'}, {'v': 5, 's': 'I'}, {'v': 0, 's': ''} FROM counts
  UNION ALL
  SELECT c, i, list_min([p0, {'v': p2.v + 5, 's': 'I' || p2.s}, {'v': p3.v + 10, 's': 'II' || p3.s}]),
         list_min([p1, {'v': p2.v + 5, 's': 'I' || p2.s}, {'v': p3.v + 10, 's': 'II' || p3.s}]),
         list_min([p2, {'v': p3.v + 5, 's': 'I' || p3.s}]), list_min([p3, {'v': p2.v + 5, 's': 'I' || p2.s}])
  FROM (
    SELECT b.c, b.i - 1 AS i,
      list_min([{'v': 2 + w0.v, 's': 'D' || w0.s}, {'v': CASE WHEN gone THEN 99 ELSE 1 END + extra + w2.v, 's': 'R' || w2.s},
                {'v': CASE WHEN gone OR initial <> 's' THEN 99 ELSE 0 END + extra + w1.v, 's': 'K' || w1.s},
                {'v': CASE WHEN gone OR initial <> 'u' THEN 99 ELSE 0 END + extra + w2.v, 's': 'K' || w2.s}]) AS p0,
      list_min([{'v': 2 + w1.v, 's': 'D' || w1.s}, {'v': CASE WHEN gone THEN 99 ELSE 1 END + extra + w2.v, 's': 'R' || w2.s},
                {'v': CASE WHEN gone OR initial <> 'u' THEN 99 ELSE 0 END + extra + w2.v, 's': 'K' || w2.s}]) AS p1,
      list_min([{'v': 2 + w2.v, 's': 'D' || w2.s}, {'v': CASE WHEN gone THEN 99 ELSE 1 END + extra + w3.v, 's': 'R' || w3.s},
                {'v': CASE WHEN gone OR initial <> 'a' THEN 99 ELSE 0 END + extra + w3.v, 's': 'K' || w3.s}]) AS p2,
      list_min([{'v': 2 + w3.v, 's': 'D' || w3.s}, {'v': CASE WHEN gone THEN 99 ELSE 1 END + extra + w2.v, 's': 'R' || w2.s},
                {'v': CASE WHEN gone OR initial <> 'u' THEN 99 ELSE 0 END + extra + w2.v, 's': 'K' || w2.s}]) AS p3
    FROM back b JOIN symbols s ON b.c = s.c AND b.i = s.i)
), audits AS (
  SELECT c, w0.v AS cost, w0.s AS audit FROM back WHERE i = 0
), letters AS (
  SELECT c, k, substr(audit, k, 1) AS letter FROM (SELECT c, audit, unnest(range(1, length(audit) + 1)) AS k FROM audits)
), aligned AS (
  SELECT c, k, letter, count(*) FILTER (letter <> 'I') OVER (PARTITION BY c ORDER BY k) AS i,
         count(*) FILTER (letter <> 'D') OVER (PARTITION BY c ORDER BY k) AS place FROM letters
), turns AS (
  SELECT a.c, k, letter, place, CASE letter WHEN 'I' THEN '' ELSE text END AS text, role,
         coalesce(bool_or(place = 1 AND letter = 'K' AND initial = 's') OVER (PARTITION BY a.c), false) AS system
  FROM aligned a LEFT JOIN symbols s ON a.c = s.c AND a.i = s.i WHERE letter <> 'D'
), repaired AS (
  SELECT c, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - system::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS turns
  FROM turns GROUP BY c
)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(turns, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM d.conv_id
  LEFT JOIN audits a ON a.c = n.c LEFT JOIN repaired r ON r.c = n.c""")
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    found = repair.Repair(damaged(turns))
    every = turns.select("conv_id").distinct().withColumn("conv", F.to_json(F.struct(F.col("conv_id").alias("id"))))
    zero = [F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found.counts(), "conv", "left").join(found.audits(), "conv", "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
