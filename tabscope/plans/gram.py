"""Sums over pairs of columns by masked matrix products.

For all pairs of columns and the rows where both have a value, one scan gives the number of rows, the sums of either
column, of its squares, and of the products.  A task multiplies matrices of values, squares and presence batch by
batch and hands over one row per pair; gaps cost nothing extra.  Values are taken relative to the column's mean and
spread, so that products of large or distant values keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PAIR_SUMS = "a int, b int, n bigint, sum_a double, sum_b double, squares_a double, squares_b double, products double"
NAMES = ["a", "b", "n", "sum_a", "sum_b", "squares_a", "squares_b", "products"]


def pair_sums(table: DataFrame, center: Sequence[float], spread: Sequence[float]) -> DataFrame:
    """PAIR_SUMS of all pairs of the double columns of ``table``, NULL being a gap, as numbers relative to center and spread.

    ``a`` and ``b`` are places of columns, a < b.
    """
    k = len(table.columns)
    shift = np.asarray(center, float)
    scale = np.array([s if s and np.isfinite(s) else 1.0 for s in spread], float)
    first, second = np.triu_indices(k, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((k, k), np.int64)
        sums, squares, products = (np.zeros((k, k)) for _ in range(3))
        for batch in batches:
            values = np.empty((batch.num_rows, k))
            for i in range(k):
                values[:, i] = batch.column(i).to_numpy(zero_copy_only=False)
            present = ~np.isnan(values)
            values = np.where(present, (values - shift) / scale, 0.0)
            mask = present.astype(float)
            counts += (mask.T @ mask).astype(np.int64)
            sums += values.T @ mask  # [i, j]: of column i over the rows where j has a value, too
            squares += (values * values).T @ mask
            products += values.T @ values
        if counts.any():
            yield pa.RecordBatch.from_arrays([
                pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)), pa.array(counts[first, second]),
                pa.array(sums[first, second]), pa.array(sums[second, first]), pa.array(squares[first, second]),
                pa.array(squares[second, first]), pa.array(products[first, second])], names=NAMES)

    return table.mapInArrow(run, PAIR_SUMS).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in NAMES[2:]])
