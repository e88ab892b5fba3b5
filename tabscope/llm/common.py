"""Helpers of the operators on texts.

Columns an operator adds replace input columns of the same name (compared without case, as Spark does).
Null texts are handed to the functions as empty bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabscope.functions.columns import col


def as_bytes(column: pa.Array) -> list[bytes]:
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def others(df: DataFrame, names: Iterable[str]) -> list[Column]:
    """The columns of ``df`` not called as any of ``names``."""
    taken = {n.lower() for n in names}
    return [col(f.name) for f in df.schema.fields if f.name.lower() not in taken]


def replaced(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with the given columns, in the place of those of the same name."""
    return df.select(*others(df, columns), *[c.alias(name) for name, c in columns.items()])


def in_order_of(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[col(c) for c in like.columns])


#: Bytes of a batch that a function is given at a time, so that a task's memory does not follow the batch.
PART_BYTES = 4 << 20


def add_columns(df: DataFrame, added: str, function: Callable[..., list], *inputs: Column) -> DataFrame:
    """Append columns that ``function`` makes of the Arrow arrays of ``inputs``, part by part."""
    fields = T.StructType.fromDDL(added)
    kept = others(df, fields.names)
    base = df.select(*kept, *[c.alias(f"__input_{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([*base.schema.fields[: len(kept)], *fields.fields])
    first, last, names = len(kept), len(kept) + len(inputs), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows = max(1, whole.num_rows * PART_BYTES // max(1, whole.nbytes))
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                made = [x if isinstance(x, pa.Array) else pa.array(x) for x in function(*[batch.column(i) for i in range(first, last)])]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(first)], *made], names=names)

    return base.mapInArrow(run, schema)


def planes(values: np.ndarray, width: int) -> bytes:
    """Little-endian numbers byte by byte, all lowest bytes first, so that high zeros compress."""
    return values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def numbers(data: bytes, width: int) -> np.ndarray:
    """The numbers of ``planes``."""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(f"<u{width}").reshape(-1).astype(np.uint64)
