"""Column expressions used by several operators; everything stays inside Catalyst."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabscope import settings as S

COUNT_FIELDS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_FIELDS = (T.FloatType, T.DoubleType)
TIME_FIELDS = (T.DateType, T.TimestampType, T.TimestampNTZType)
TEXT_FIELDS = (T.StringType, T.VarcharType, T.CharType)


def col(name: str) -> Column:
    """A column by its literal name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fields(df: DataFrame, columns: Iterable[str] | None = None) -> list[T.StructField]:
    """Schema fields of ``columns`` in the given order; unknown names are an error."""
    if columns is None:
        return list(df.schema.fields)
    by_name = {f.name: f for f in df.schema.fields}
    unknown = [c for c in columns if c not in by_name]
    if unknown:
        raise ValueError(f"unknown column(s): {unknown}")
    return [by_name[c] for c in columns]


def stored_kind(dtype: T.DataType) -> str:
    """numeric, boolean, datetime, text or other, from the stored type alone."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.NumericType,)):
        return "numeric"
    if isinstance(dtype, TIME_FIELDS):
        return "datetime"
    if isinstance(dtype, TEXT_FIELDS):
        return "text"
    return "other"


def of_kind(df: DataFrame, kind: str, columns: Sequence[str] | None = None) -> list[str]:
    return [f.name for f in fields(df, columns) if stored_kind(f.dataType) == kind]


def present(field: T.StructField) -> Column:
    """True where a value exists: NULL and NaN are missing, infinity is not."""
    c = col(field.name)
    if isinstance(field.dataType, FLOAT_FIELDS):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def finite(field: T.StructField) -> Column:
    """The value as a double, NULL where it is missing, NaN or infinite."""
    c = col(field.name).cast("double")
    if isinstance(field.dataType, FLOAT_FIELDS):
        # NaN sorts above infinity, so one comparison removes both
        return F.when(F.abs(c) < F.lit(float("inf")), c)
    return c


def without_nan(df: DataFrame) -> DataFrame:
    """Same table with NaN turned into NULL; infinities are kept."""
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, FLOAT_FIELDS):
            c = F.when(~F.isnan(c), c).alias(f.name)
        out.append(c)
    return df.select(*out)


def groupable(df: DataFrame) -> list[str]:
    """Columns that may serve as grouping keys (maps and variants may not)."""
    def bad(dtype: T.DataType) -> bool:
        if isinstance(dtype, (T.MapType, T.VariantType)):
            return True
        if isinstance(dtype, T.ArrayType):
            return bad(dtype.elementType)
        if isinstance(dtype, T.StructType):
            return any(bad(f.dataType) for f in dtype.fields)
        return False

    return [f.name for f in df.schema.fields if not bad(f.dataType)]


def share(part: Column, whole: Column, default: float | None = 0.0) -> Column:
    """part / whole as a double, ``default`` when the division is not defined."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(default))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(F.coalesce(value, F.lit(low)), F.lit(low)), F.lit(high))


def rescale(value: Column, low: Column, high: Column) -> Column:
    """Where value lies between low and high, limited to 0..1; 0 for an empty interval."""
    return F.when(low == high, F.lit(0.0)).otherwise(
        clamp(F.try_divide(value - low, high - low), 0.0, 1.0))


def close_to(value: Column, code: float) -> Column:
    """Equality up to 1e-8 absolute plus 1e-5 relative to the code."""
    return F.abs(value - F.lit(code)) <= F.lit(1e-8 + 1e-5 * abs(code))


def whole_numbers(value: Column) -> Column:
    """Aggregate: do all values lack a fractional part? (false for no values)"""
    return F.coalesce(F.bool_and(value % 1 == 0), F.lit(False))


def undecorated(text: Column) -> Column:
    """Number text without separators, currency signs, accounting brackets or percent sign."""
    t = F.translate(F.trim(text), S.NUMBER_DECORATION, "")
    t = F.when(t.startswith("+"), F.substr(t, F.lit(2))).otherwise(t)
    bracketed = t.startswith("(") & t.endswith(")")
    t = F.when(bracketed, F.concat(F.lit("-"), F.substr(t, F.lit(2), F.length(t) - 2))).otherwise(t)
    return F.when(t.endswith("%"), F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t)


def plain_number(text: Column) -> Column:
    """Text as a double if it is a number as it stands, else NULL."""
    t = F.trim(text)
    return F.when(t.rlike(S.PLAIN_NUMBER), t.try_cast("double"))


#: Every character of a decorated number is one of these.
_NUMBER_CHARACTERS = "^[" + "".join(f"\\x{{{ord(c):x}}}" for c in S.NUMBER_DECORATION) + "0-9.eE()%+-]+$"
#: Every hint of a date holds one of these, found sooner than the hint: a separator between digits, or letters as months have them.
_MAYBE_DATE = "[0-9][-/:][0-9]|[jfmasondJFMASOND][aepucoAEPUCO][nbrylgptvcNBRYLGPTVC]"


def parse_number(text: Column) -> Column:
    """Decorated number text as a double: ``$1,200`` 1200, ``(12)`` -12, ``72%`` 72."""
    t = undecorated(text)
    return F.when(text.rlike(_NUMBER_CHARACTERS), F.when(t.rlike(S.PLAIN_NUMBER), t.try_cast("double")))


def date_hinted(text: Column) -> Column:
    return text.rlike(_MAYBE_DATE) & text.rlike(S.DATE_HINT)


def layout_shape(layout: str) -> str:
    """A pattern that every text of a date layout fits."""
    def one(run: re.Match) -> str:
        letter, n = run.group()[0], len(run.group())
        if not letter.isalpha():
            return re.escape(run.group())
        if letter == "a":
            return "[AaPp][Mm]"
        if letter in "ME" and n >= 3:
            return r"\p{L}+\.?"
        return "[0-9]{2}" if n == 2 and letter == "y" else "[+-]?[0-9]{4,}" if letter == "y" else "[0-9]{1,9}"

    return "^" + re.sub(r"([A-Za-z])\1*|[^A-Za-z]+", one, layout) + "$"


def parse_date(text: Column, hinted: Column | None = None) -> Column:
    """Text as a timestamp under the first layout that fits, else NULL; ``hinted`` may hold ``date_hinted`` of the text."""
    t = F.trim(text)
    iso = F.regexp_replace(t, r"(?<=[0-9])T(?=[0-9])", " ")
    iso = F.regexp_replace(iso, r"(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})?$", "")
    # a layout is tried only on text of its shape, since a failed attempt costs an exception
    tries = [F.when(t.rlike(layout_shape(p)), F.try_to_timestamp(t, F.lit(p))) for p in S.DATE_FORMATS]
    tries.append(F.when(iso.rlike(layout_shape("yyyy-M-d H:m:s")), F.try_to_timestamp(iso, F.lit("yyyy-M-d H:m:s"))))
    return F.when((F.length(t) <= 64) & (date_hinted(t) if hinted is None else hinted), F.coalesce(*tries))


def name_tokens(name: Column) -> Column:
    """Lower-case words of a column name, split at case changes and punctuation."""
    spaced = F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+"), lambda t: t != "")


def words(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for name, rank in S.SEVERITY_RANK.items():
        out = F.when(severity == name, F.lit(rank)).otherwise(out)
    return out


def banded(rate: Column, bands: Sequence[tuple[float, str]], otherwise: str = "info") -> Column:
    """Label of the highest band whose lower edge the rate reaches."""
    out = F.lit(otherwise)
    for edge, label in sorted(bands):
        out = F.when(rate >= edge, F.lit(label)).otherwise(out)
    return out


def missing_band(rate: Column, s: S.Settings = S.DEFAULT) -> Column:
    return banded(rate, [(s.missing_low, "low"), (s.missing_moderate, "moderate"),
                         (s.missing_high, "high"), (s.missing_critical, "critical")])


def as_rows(row: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn the one row of a wide aggregate into one row per struct."""
    return row.select(F.inline(F.array(*structs)))


def in_passes(df: DataFrame, items: Sequence, buffers: int, build, limit: int) -> DataFrame:
    """One row per item from as few scans as keep each aggregate code-generated.

    ``build(i, item)`` gives the item's aggregates, aliased with i, and the struct that reads
    them; an item takes ``buffers`` aggregation buffer fields out of ``limit`` per scan.
    """
    step = max(1, limit // buffers)
    parts = []
    for start in range(0, len(items), step):
        built = [build(i, item) for i, item in enumerate(items[start:start + step])]
        row = df.agg(*[e for exprs, _ in built for e in exprs])
        parts.append(as_rows(row, [s for _, struct in built for s in (struct if isinstance(struct, list) else [struct])]))
    return reduce(DataFrame.unionByName, parts)


# ---- text for people ---------------------------------------------------------

def percent_text(rate: Column, decimals: int = 1) -> Column:
    return F.format_string(f"%.{decimals}f%%", rate.cast("double") * 100)


def count_text(n: Column) -> Column:
    return F.format_number(n.cast("long"), 0)


def number_text(value: Column, decimals: int = 2) -> Column:
    """Thousands separators; whole numbers without decimals; exponents for extremes."""
    v = value.cast("double")
    whole = (v % 1 == 0) & (F.abs(v) < 1e15)
    extreme = (F.abs(v) >= 1e12) | ((F.abs(v) > 0) & (F.abs(v) < 1e-4))
    return (F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit("n/a"))
            .when(whole, F.format_number(v.cast("long"), 0))
            .when(extreme, F.format_string("%.3e", v))
            .otherwise(F.format_number(v, decimals)))


def bytes_text(size: Column) -> Column:
    v = size.cast("double")
    out = F.format_string("%.1f TiB", v / 1024.0 ** 4)
    for power, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB")):
        out = F.when(v < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", v / 1024.0 ** power)).otherwise(out)
    return F.when(v.isNull() | (v < 0), F.lit("n/a")).when(v < 1024, F.format_string("%.0f B", v)).otherwise(out)


def shortened(text: Column, limit: int = 60) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substr(text, F.lit(1), F.lit(limit - 1)), F.lit("…")))


def name_list(names: Column, limit: int = S.DEFAULT.names_in_text) -> Column:
    """Names in backticks, the tail of a long list replaced by its size."""
    quoted = F.transform(F.slice(names, 1, limit), lambda n: F.concat(F.lit("`"), n, F.lit("`")))
    more = F.size(names) - limit
    return (F.when(F.coalesce(F.size(names), F.lit(0)) <= 0, F.lit("none"))
            .when(more > 0, F.concat(F.array_join(quoted, ", "), F.format_string(" and %d more", more)))
            .otherwise(F.array_join(quoted, ", ")))
