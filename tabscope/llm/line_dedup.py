"""Line dedup by distinct-site spread: lines found on many sites are boilerplate and stay in one place only.

A line is what stands between line feeds, compared without blanks around it, by its XXH64 hash.  One aggregation
merges a HyperLogLog sketch of the sites of each line hash; where the estimate lies within ``margin`` of the
threshold, distinct sites are counted exactly.  A line on ``min_sites`` sites or more stays where it stands first
(smallest document id, null ids first, then line number) and goes everywhere else.

Only hashes, line numbers and sketches are shuffled in search of such lines, so texts move once, to meet their hits.

Defined results: null texts have no lines and stay null, blank lines are never removed, a null site is a site of
its own, rows that share id and text share their hits, rows that share an id are one document when the first place
is chosen (of equal places every row keeps its line), other columns pass through, empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabscope.functions.columns import col
from tabscope.plans.stored import stored

#: HyperLogLog of 2^12 registers: a relative standard error of 1.6 %; the margin is some six of these.
LG_REGISTERS = 12
MARGIN = 0.1


BLANKS = " \t\x0b\f\r"


def _lines(df: DataFrame, text: str, *columns: Column) -> DataFrame:
    """One row per line that is not blank: the given columns, ``line_no`` and ``line_hash``."""
    lines = df.select(*columns, F.posexplode(F.split(col(text), "\n", -1)).alias("line_no", "line"))
    bare = lines.withColumn("line", F.trim("line", F.lit(BLANKS))).where("line != ''")
    return bare.select(*[c for c in lines.columns if c != "line"], F.xxhash64("line").alias("line_hash"))


def spread(df: DataFrame, min_sites: int, doc: str = "doc_id", text: str = "text", site: str = "source", margin: float = MARGIN) -> DataFrame:
    """Lines on ``min_sites`` sites or more: line_hash, first_doc, first_line, sites (exact where near the threshold)."""
    lines = _lines(df, text, col(doc).alias("doc"), F.coalesce(F.concat(F.lit("="), col(site).cast("string")), F.lit("")).alias("site"))
    sketched = lines.groupBy("line_hash").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_REGISTERS))).alias("estimate"),
        F.min(F.struct("doc", "line_no")).alias("first"))
    # stored: the few lines left are broadcast if small, and else joined by a shuffle in which frequent lines can be split
    likely = stored(sketched.where(F.col("estimate") >= min_sites * (1 - margin)), "likely-lines")
    near = likely.where(F.col("estimate") <= min_sites * (1 + margin)).select("line_hash")
    exact = stored(lines.join(near, "line_hash", "left_semi").select("line_hash", "site").distinct()
                   .groupBy("line_hash").agg(F.count("*").alias("exact")), "counted-lines")
    sites = F.coalesce("exact", "estimate")
    return (likely.join(exact, "line_hash", "left").where(sites >= min_sites)
            .select("line_hash", F.col("first.doc").alias("first_doc"), F.col("first.line_no").alias("first_line"), sites.alias("sites")))


def remove_boilerplate(df: DataFrame, min_sites: int = 10, doc: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """``df`` without the lines that stand on many sites; ``n_lines`` counts its lines, ``n_removed`` those removed."""
    common = stored(spread(df, min_sites, doc, text, site), "common-lines")
    key = [col(doc).alias("doc"), F.xxhash64(col(text)).alias("text_hash")]
    found = _lines(df, text, *key).join(common, "line_hash")
    elsewhere = found.where(~(F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("line_no") == F.col("first_line"))))
    hits = elsewhere.groupBy("doc", "text_hash").agg(F.collect_set("line_no").alias("gone"))
    own = df.select(*[col(c).alias(f"own_{c}") for c in df.columns], F.xxhash64(col(text)).alias("hash_of_text"))
    joined = own.join(hits, col(f"own_{doc}").eqNullSafe(F.col("doc")) & (F.col("hash_of_text") == F.col("text_hash")), "left")
    before = F.split(col(f"own_{text}"), "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(before) - 1), F.col("gone"))
    kept = F.array_join(F.transform(places, lambda i: before[i]), "\n")
    results = {
        text: F.when(F.col("gone").isNull(), col(f"own_{text}")).otherwise(kept),
        "n_lines": F.when(col(f"own_{text}").isNull(), 0).otherwise(F.size(before)).cast("bigint"),
        "n_removed": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint"),
    }
    kept_as = [c for c in df.columns if c.lower() not in ("n_lines", "n_removed")]
    return joined.select(*[results[c].alias(c) if c == text else col(f"own_{c}").alias(c) for c in kept_as],
                         results["n_lines"].alias("n_lines"), results["n_removed"].alias("n_removed"))
