"""Opt-in cleaning: every step is chosen by the caller and counted in an audit table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabscope import settings as S
from tabscope.functions.columns import COUNT_FIELDS, col, count_text, fields, parse_number, present, stored_kind, without_nan
from tabscope.plans.counts import value_counts
from tabscope.plans.quantiles import exact_quantiles
from tabscope.plans.stored import stored
from tabscope.settings import DEFAULT, Settings

AUDIT_SCHEMA = "step int, operation string, cells_changed bigint, rows_removed bigint, detail string"
STRATEGIES = ("keep", "drop_rows", "fill")


@dataclass
class Cleaned:
    frame: DataFrame
    audit: DataFrame

    def totals(self) -> DataFrame:
        return self.audit.agg(F.coalesce(F.sum("cells_changed"), F.lit(0)).alias("cells_changed"),
                              F.coalesce(F.sum("rows_removed"), F.lit(0)).alias("rows_removed"))


def is_missing_marker(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(*S.CLEAN_MISSING_MARKERS), F.lit(False))


def markers_to_null(df: DataFrame) -> DataFrame:
    """Texts such as NA, null or none become NULL."""
    return df.select(*[
        F.when(~is_missing_marker(col(f.name)), col(f.name)).alias(f.name)
        if stored_kind(f.dataType) == "text" else col(f.name) for f in df.schema.fields])


def text_to_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Decorated number text as doubles; what cannot be read becomes NULL."""
    chosen = {f.name for f in fields(df, columns) if stored_kind(f.dataType) == "text"}
    return df.select(*[parse_number(col(f.name)).alias(f.name) if f.name in chosen else col(f.name)
                       for f in df.schema.fields])


def without_duplicates(df: DataFrame) -> DataFrame:
    return without_nan(df).dropDuplicates()


def complete_rows(df: DataFrame) -> DataFrame:
    return without_nan(df).na.drop("any")


def fill_values(df: DataFrame, *, settings: Settings = DEFAULT) -> list[dict]:
    """Per column with gaps: how many, and its median (numbers) or most frequent value.

    Of equally frequent values the smallest is taken. Columns without any value, and
    nested ones, have no fill value.
    """
    wanted = fields(df)
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(present(f)).alias(f"p{i}") for i, f in enumerate(wanted)]).first()
    gaps = [(f, row["rows"] - row[f"p{i}"]) for i, f in enumerate(wanted) if 0 < row[f"p{i}"] < row["rows"]]
    numbers = [f for f, _ in gaps if stored_kind(f.dataType) == "numeric"]
    others = [f for f, _ in gaps if stored_kind(f.dataType) in ("text", "boolean", "datetime")]
    medians = exact_quantiles(df, {f.name: F.when(present(f), col(f.name).cast("double")) for f in numbers}, [0.5], settings)
    modes = {}
    if others:
        top = value_counts(df, [f.name for f in others]).groupBy("column").agg(
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
        modes = {r["column"]: r["mode"] for r in top.collect()}  # one row per column
    out = []
    for f, missing in gaps:
        if f.name in medians and medians[f.name]:
            out.append(dict(field=f, missing=missing, value=medians[f.name][0]))
        elif f.name in modes:
            out.append(dict(field=f, missing=missing, value=modes[f.name]))
    return out


def filled(df: DataFrame, values: Sequence[dict]) -> DataFrame:
    """Gaps replaced; a whole-number column whose median is fractional becomes double."""
    by_name = {v["field"].name: v for v in values}
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if f.name in by_name:
            value = by_name[f.name]["value"]
            kept = F.when(present(f), c)
            if isinstance(f.dataType, COUNT_FIELDS) and value != int(value):
                c = F.coalesce(kept.cast("double"), F.lit(value)).alias(f.name)
            else:
                c = F.coalesce(kept, F.lit(value).cast(f.dataType)).alias(f.name)
        out.append(c)
    return df.select(*out)


def clean(df: DataFrame, *, normalize_markers: bool = False, numeric_columns: Sequence[str] = (),
          remove_duplicates: bool = False, missing: str = "keep", settings: Settings = DEFAULT) -> Cleaned:
    """Markers to NULL, text to numbers, duplicates out, then rows dropped or gaps filled."""
    if missing not in STRATEGIES:
        raise ValueError(f"missing must be one of {STRATEGIES}")
    fields(df, numeric_columns)  # unknown names are an error
    frame, audit = without_nan(df), []

    def note(operation, cells=0, rows=0, detail=""):
        if cells or rows:
            audit.append((len(audit) + 1, operation, cells, rows, detail))

    marked = markers_to_null(frame) if normalize_markers else frame
    texts = [f.name for f in frame.schema.fields if stored_kind(f.dataType) == "text"]
    chosen = [c for c in dict.fromkeys(numeric_columns) if c in texts]
    counters = []
    if normalize_markers:
        counters += [F.count_if(is_missing_marker(col(c))).alias(f"marker{i}") for i, c in enumerate(texts)]
    for i, c in enumerate(chosen):
        value = F.when(~is_missing_marker(col(c)), col(c)) if normalize_markers else col(c)
        counters += [F.count(parse_number(value)).alias(f"ok{i}"), F.count(value).alias(f"all{i}")]
    if counters:  # both steps are counted in one scan
        row = frame.agg(*counters).first()
        if normalize_markers:
            n = sum(row[f"marker{i}"] for i in range(len(texts)))
            note("missing markers to NULL", n, 0, f"{n:,} text value(s) that mean missing became NULL.")
        for i, c in enumerate(chosen):
            ok, every = row[f"ok{i}"], row[f"all{i}"]
            note(f"number text to double: {c}", every, 0, f"{ok:,} value(s) read, {every - ok:,} unreadable became NULL.")
    frame = text_to_numbers(marked, chosen) if chosen else marked
    if remove_duplicates:
        before = frame.count()
        frame = stored(frame.dropDuplicates(), "distinct")  # read several times below
        removed = before - frame.count()
        note("duplicate rows removed", 0, removed, f"{removed:,} repeated row(s) removed, one copy of each kept.")
    if missing == "drop_rows":
        before = frame.count()
        frame = frame.na.drop("any")
        removed = before - frame.count()
        note("incomplete rows removed", 0, removed, f"{removed:,} row(s) with a missing value removed.")
    elif missing == "fill":
        values = fill_values(frame, settings=settings)
        n = sum(v["missing"] for v in values)
        names = ", ".join(v["field"].name for v in values)
        note("missing values filled", n, 0, f"{n:,} value(s) filled by median or most frequent value in: {names}.")
        frame = filled(frame, values)
    return Cleaned(frame, df.sparkSession.createDataFrame(audit, AUDIT_SCHEMA))


def cleaned_name(name: str) -> str:
    """File name for the cleaned copy, without folders."""
    stem = name.replace("\\", "/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return f"{stem or 'dataset'}_cleaned.csv"
