"""Measurements of numeric columns that several operators need, taken once.

Three or four scans, each returning one row, give count, range, mean, deviation, quartiles,
median absolute deviation and whether there are fewer than four distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tabscope.functions.columns import fields, finite, of_kind
from tabscope.plans.quantiles import exact_quantiles
from tabscope.settings import DEFAULT, Settings

QUARTILES = [0.25, 0.5, 0.75]


@dataclass
class NumberFacts:
    """Of the finite values of one column; None where there are none."""

    column: str
    n: int
    low: float | None = None
    high: float | None = None
    mean: float | None = None
    std: float | None = None  # of the population
    distinct_class: int = 0  # number of distinct values, 4 standing for four or more
    quartiles: list[float] | None = None
    mad: float | None = None


def number_facts(df: DataFrame, columns: Sequence[str] | None = None, *, settings: Settings = DEFAULT,
                 mads: bool = True, quartiles: bool = True) -> dict[str, NumberFacts]:
    names = of_kind(df, "numeric", columns)
    values = {f.name: finite(f) for f in fields(df, names)}
    facts: dict[str, NumberFacts] = {}
    step = max(1, settings.fields_per_pass // 8)
    for start in range(0, len(names), step):
        _measure(df, {n: values[n] for n in names[start:start + step]}, facts)
    filled = {n: values[n] for n in names if facts[n].n}
    sizes = {n: facts[n].n for n in filled}
    if quartiles or mads:
        for n, q in exact_quantiles(df, filled, QUARTILES, settings, sizes).items():
            facts[n].quartiles = q
    if mads:
        wanted = {n: F.abs(v - F.lit(facts[n].quartiles[1])) for n, v in filled.items() if facts[n].distinct_class > 1}
        for n, q in exact_quantiles(df, wanted, [0.5], settings, sizes).items():
            facts[n].mad = q[0]
        for n in filled:
            facts[n].mad = facts[n].mad or 0.0
    return facts


def _measure(df: DataFrame, values: dict[str, Column], facts: dict[str, NumberFacts]) -> None:
    names = list(values)
    table = df.select(*[values[n].alias(f"v{i}") for i, n in enumerate(names)])
    row = table.agg(F.lit(0), *[e for i in range(len(names)) for e in (
        F.count(f"v{i}").alias(f"n{i}"), F.min(f"v{i}").alias(f"lo{i}"), F.max(f"v{i}").alias(f"hi{i}"),
        F.avg(f"v{i}").alias(f"m{i}"), F.stddev_pop(f"v{i}").alias(f"s{i}"))]).first()
    for i, n in enumerate(names):
        facts[n] = NumberFacts(n, row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"], row[f"m{i}"], row[f"s{i}"])
        facts[n].distinct_class = min(row[f"n{i}"], 1)
    # smallest and largest value settle one or two; the next ones inward settle three or more
    wide = [i for i, n in enumerate(names) if facts[n].n and facts[n].low < facts[n].high]
    if not wide:
        return
    v = lambda i: F.col(f"v{i}")
    inner = table.agg(*[e for i in wide for e in (
        F.min(F.when(v(i) > row[f"lo{i}"], v(i))).alias(f"lo{i}"),
        F.max(F.when(v(i) < row[f"hi{i}"], v(i))).alias(f"hi{i}"))]).first()
    for i in wide:
        fact = facts[names[i]]
        if inner[f"lo{i}"] == fact.high:
            fact.distinct_class = 2
        else:
            fact.distinct_class = 3 if inner[f"lo{i}"] == inner[f"hi{i}"] else 4
