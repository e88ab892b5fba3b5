"""Delimited text into a typed table, with notes on everything that had to be repaired."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabscope import settings as S
from tabscope.functions.columns import as_rows, col
from tabscope.plans.stored import stored

NOTE_SCHEMA = "note_code string, column string, n bigint, message string"
CORRUPT, LONG, SHORT = "__malformed", "__long", "__short"
WHOLE = r"^[+-]?[0-9]{1,18}$"


class LoadError(ValueError):
    """The path does not hold a readable table."""


@dataclass
class Loaded:
    frame: DataFrame
    notes: DataFrame
    delimiter: str
    encoding: str


def detect_delimiter(lines: DataFrame, fallback: str = ",") -> tuple[str, bool]:
    """(delimiter, sure) from up to 50 non-blank lines of column ``value``.

    Sure is a delimiter that occurs equally often, at least once, on every line outside
    quotes; else the most frequent candidate is returned, else the fallback.
    """
    bare = F.regexp_replace("value", '"[^"]*"', "")
    per_line = lines.where(F.trim("value") != "").limit(50).select(*[
        F.regexp_count(bare, F.lit(re.escape(d))).alias(f"d{i}") for i, d in enumerate(S.DELIMITERS)])
    row = per_line.agg(*[e for i in range(len(S.DELIMITERS)) for e in (
        F.min(f"d{i}").alias(f"lo{i}"), F.max(f"d{i}").alias(f"hi{i}"), F.sum(f"d{i}").alias(f"n{i}"))]).first()
    steady = [(row[f"lo{i}"], -i) for i in range(len(S.DELIMITERS))
              if row[f"lo{i}"] and row[f"lo{i}"] == row[f"hi{i}"]]
    if steady:
        return S.DELIMITERS[-max(steady)[1]], True
    total = [(row[f"n{i}"] or 0, -i) for i in range(len(S.DELIMITERS))]
    most, index = max(total)
    return (S.DELIMITERS[-index], False) if most else (fallback, False)


def clean_names(raw: Sequence[str | None]) -> list[str]:
    """Trimmed names; repeats become x_duplicate_n, blanks unnamed_column."""
    seen: dict[str, int] = {}
    out = []
    for name in raw:
        name = (name or "").strip() or "unnamed_column"
        seen[name] = seen.get(name, -1) + 1
        out.append(name if not seen[name] else f"{name}_duplicate_{seen[name]}")
    return out


def _check_text(lines: DataFrame, path) -> None:
    try:
        head = [r["value"] for r in lines.limit(20).collect()]
    except AnalysisException as error:
        raise LoadError(f"cannot read {path}: {error}") from error
    if not head:
        raise LoadError(f"{path} is empty")
    start = head[0][:8]
    if any("\x00" in h for h in head) or start.startswith(("PK\x03\x04", "%PDF")) or "PNG" in start[:4]:
        raise LoadError(f"{path} is binary, not text")


@dataclass
class _HeaderGroup:
    """Files with one header: its text, its fields, clean names, and the names of the columns that are kept, by position."""

    header: str
    raw: list[str | None]
    names: list[str]
    dropped: bool

    @property
    def kept(self) -> list[str]:
        # an empty first header is a written-out row index
        return clean_names(self.raw[1:]) if self.dropped else self.names


def _headers(lines: DataFrame) -> DataFrame:
    """(file, header): the first line of each file that is not blank, stored: file names do not come to the driver."""
    first = (lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                          F.monotonically_increasing_id().alias("place"))
             .where((F.col("start") == 0) & (F.trim("value") != ""))
             .groupBy("file").agg(F.min_by("value", "place").alias("header")))
    return stored(first, "headers")


def _header_groups(plain, headers: DataFrame) -> list[_HeaderGroup]:
    """One group for each header, in the order of the first file that has it."""
    found = headers.groupBy("header").agg(F.min("file").alias("file")).orderBy("file").collect()
    groups = []
    for row in found:
        raw = list(plain.csv(row["file"]).first())
        groups.append(_HeaderGroup(row["header"], raw, clean_names(raw), len(raw) > 1 and not (raw[0] or "").strip()))
    return groups


def _group_rows(reader, path, group: _HeaderGroup, files: DataFrame | None, codes: dict[str, str], delimiter: str) -> DataFrame:
    """Rows of a group's files, values by the codes of their columns, and whether a row is too long or too short.

    ``files``: the group's own, where the path holds others, too.
    """
    n = len(group.raw)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*(f"f{i}" for i in range(n)), CORRUPT]])
    rows = (reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(schema).csv(path))
    if files is not None:
        own = files.select(F.col("file").alias("__file"))
        rows = rows.select("*", F.col("_metadata.file_path").alias("__path")).join(own, F.col("__path") == F.col("__file"), "left_semi").drop("__path")
    outside_quotes = F.regexp_replace(F.col(CORRUPT), '"[^"]*"', "")
    n_fields = F.regexp_count(outside_quotes, F.lit(re.escape(delimiter))) + 1
    bad = F.col(CORRUPT).isNotNull()
    place = {name: i + group.dropped for i, name in enumerate(group.kept)}
    return rows.select(
        *[(F.col(f"f{place[name]}") if name in place else F.lit(None).cast("string")).alias(c) for name, c in codes.items()],
        F.coalesce(bad & (n_fields > n), F.lit(False)).alias(LONG), F.coalesce(bad & (n_fields < n), F.lit(False)).alias(SHORT))


def read_delimited(spark: SparkSession, path, delimiter: str | None = None, *, encoding: str = "UTF-8",
                   max_rows: int | None = None, multiline: bool = False) -> Loaded:
    """Read one file or a folder of files with a header each; columns of several files are matched by name.

    All values are read as text; one pass then finds types and everything worth a note, and
    the returned frame applies trimming, missing tokens and types lazily.
    """
    try:
        lines = spark.read.option("encoding", encoding).text(path)
    except AnalysisException as error:
        raise LoadError(f"cannot read {path}: {error}") from error
    _check_text(lines, path)
    if lines.where(F.trim("value") != "").isEmpty():
        raise LoadError(f"{path} is empty")
    sure = True
    if delimiter is None:
        delimiter, sure = detect_delimiter(lines)

    def reader(header: bool):
        return (spark.read.option("sep", delimiter).option("encoding", encoding).option("header", header)
                .option("quote", '"').option("escape", '"').option("multiLine", multiline)
                .option("ignoreLeadingWhiteSpace", True).option("columnPruning", False))

    headers = _headers(lines)
    groups = _header_groups(reader(False), headers)
    # columns of all files by name, in the order of the first file that has them
    order = list(dict.fromkeys(name for g in groups for name in g.kept))
    kept = [(f"c{i}", name) for i, name in enumerate(order)]
    rows = None
    for g in groups:
        files = headers.where(F.col("header") == g.header) if len(groups) > 1 else None
        own = _group_rows(reader(True), path, g, files, dict(zip(order, (c for c, _ in kept))), delimiter)
        rows = own if rows is None else rows.unionByName(own)
    too_long, short = F.col(LONG), F.col(SHORT)

    value = {c: F.when(~F.trim(c).isin(*S.READ_MISSING_TOKENS), F.trim(c)) for c, _ in kept}
    empty = F.lit(True)
    for c, _ in kept:
        empty = empty & value[c].isNull()
    broken = F.lit(False)
    for c, _ in kept:
        broken = broken | F.coalesce(F.contains(F.col(c), F.lit("�")) | ~F.is_valid_utf8(F.col(c)), F.lit(False))

    good = ~too_long
    full = good & ~empty
    exprs = [F.count_if(full).alias("rows"), F.count_if(too_long).alias("long"), F.count_if(short & good).alias("short"),
             F.count_if(good & empty).alias("empty"), F.count_if(good & broken).alias("broken")]
    row = rows.agg(*exprs).first().asDict()
    per_column = {}
    for c, _ in kept:
        v = F.when(good, value[c])
        per_column[c] = [F.count(v).alias(f"n_{c}"), F.count_if(v.rlike(S.PLAIN_NUMBER)).alias(f"num_{c}"),
                  F.count_if(v.rlike(WHOLE)).alias(f"int_{c}"),
                  F.count_if(F.lower(v).isin("true", "false")).alias(f"bool_{c}"),
                  F.count_if(good & value[c].isNotNull() & (F.col(c) != F.trim(c))).alias(f"trim_{c}")]
    step = max(1, S.DEFAULT.fields_per_pass // 5)
    for start in range(0, len(kept), step):  # few enough fields a scan for generated code
        row |= rows.agg(*[e for c, _ in kept[start:start + step] for e in per_column[c]]).first().asDict()
    if not row["rows"]:
        raise LoadError(f"{path} holds a header but no data rows")

    def typed(c: str) -> Column:
        n = row[f"n_{c}"]
        if n and row[f"int_{c}"] == n:
            return value[c].cast("bigint")
        if n and row[f"num_{c}"] == n:
            return value[c].cast("double")
        if n and row[f"bool_{c}"] == n:
            return F.lower(value[c]) == "true"
        return value[c]

    frame = rows.where(full).select(*[typed(c).alias(n) for c, n in kept])
    notes = []
    if not sure:
        notes.append(("delimiter_guessed", None, None, f"The delimiter was not certain; {delimiter!r} was used."))
    if len(groups) > 1:
        notes.append(("headers_differ", None, len(groups), f"The files have {len(groups)} different headers; columns were matched by name."))
    if any(g.names != [n or "" for n in g.raw] for g in groups):
        notes.append(("headers_normalised", None, None, "Headers were trimmed, or repeated or blank ones renamed."))
    if any(g.dropped for g in groups):
        notes.append(("index_column_dropped", None, None, "The first column had no name and was dropped as a row index."))
    for code, n, text in (("rows_too_long", row["long"], "row(s) with more fields than the header were skipped."),
                          ("rows_too_short", row["short"], "row(s) with fewer fields than the header were padded."),
                          ("rows_empty", row["empty"], "fully empty row(s) were removed."),
                          ("undecodable", row["broken"], f"row(s) hold characters that are not valid {encoding}.")):
        if n:
            notes.append((code, None, n, f"{n:,} {text}"))
    for c, name in kept:
        if not row[f"n_{c}"]:
            notes.append(("column_empty", name, None, f"Column {name} holds no value."))
        if row[f"trim_{c}"]:
            notes.append(("values_trimmed", name, row[f"trim_{c}"], f"{row[f'trim_{c}']:,} value(s) of {name} were trimmed."))
    if max_rows is not None and row["rows"] > max_rows:
        notes.append(("rows_limited", None, max_rows, f"Only {max_rows:,} of {row['rows']:,} rows are used."))
        frame = frame.limit(max_rows)
    return Loaded(frame, spark.createDataFrame(notes, NOTE_SCHEMA), delimiter, encoding)
