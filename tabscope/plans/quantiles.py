"""Exact order statistics without sorting the table, by one way at every size.

A mergeable sketch per column (KLL, from one aggregation) brackets every wanted rank, one scan counts what lies below and
inside each bracket, which proves that it holds the rank, and only the distinct values inside the brackets are grouped
and walked by running totals.  A bracket that missed its rank is sought again, wider.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tabscope.plans.running import grouped_totals
from tabscope.settings import DEFAULT, Settings

#: Size of a sketch, some 200 kB, and the share of ranks by which it is off, rarely more.
SKETCH, ERROR = 8192, 0.0007
#: How many times that a bracket reaches to either side of a rank.
SLACK = 2.0


def exact_quantiles(
    df: DataFrame,
    values: Mapping[str, Column],
    probabilities: Sequence[float],
    settings: Settings = DEFAULT,
    sizes: Mapping[str, int] | None = None,
) -> dict[str, list[float] | None]:
    """Linearly interpolated quantiles per named expression; None where no value exists.

    ``sizes`` gives the number of values per expression if it is known already.
    """
    keys = {name: f"v{i}" for i, name in enumerate(values)}
    if not keys:
        return {}
    table = df.select(*[values[n].cast("double").alias(k) for n, k in keys.items()])
    known = {keys[n]: sizes[n] for n in keys} if sizes is not None else _in_parts(table, list(keys.values()), settings, lambda k: [F.count(k).alias(k)])
    wanted = {}
    for k in keys.values():
        if known[k]:
            places = [(known[k] - 1) * p for p in probabilities]
            wanted[k] = sorted({r for h in places for r in (math.floor(h), math.ceil(h))})
    found = order_statistics(table, wanted, known, settings)
    out: dict[str, list[float] | None] = {}
    for n, k in keys.items():
        result = []
        for p in probabilities if k in wanted else ():
            h = (known[k] - 1) * p
            lo, hi = found[k, math.floor(h)], found[k, math.ceil(h)]
            result.append(lo + (hi - lo) * (h - math.floor(h)))
        out[n] = result if k in wanted else None
    return out


def _in_parts(table: DataFrame, columns: Sequence[str], settings: Settings, build) -> dict:
    """One-row aggregates of all columns by name, a bounded number of fields a scan."""
    row: dict = {}
    step = max(1, settings.fields_per_pass // 8)
    for start in range(0, len(columns), step):
        row |= table.agg(*[e for c in columns[start:start + step] for e in build(c)]).first().asDict()
    return row


def order_statistics(
    table: DataFrame, wanted: Mapping[str, Sequence[int]], sizes: Mapping[str, int], settings: Settings = DEFAULT, slack: float = SLACK
) -> dict[tuple[str, int], float]:
    """The values at the given zero-based ranks of each double column, exactly.

    Neighbouring ranks share a bracket, which reaches ``slack`` times the sketch's error to either side of them; a
    sketch that still holds all values brackets each rank by the value itself.
    """
    if not wanted:
        return {}
    reach_of = {c: 0.0 if sizes[c] <= SKETCH and slack <= SLACK else slack * ERROR * sizes[c] + 1 for c in wanted}
    spans: list[tuple[str, int, int]] = []  # column, first and last rank
    for c, ranks in wanted.items():
        for r in ranks:
            if reach_of[c] and spans and spans[-1][0] == c and spans[-1][2] + 1 >= r:
                spans[-1] = (c, spans[-1][1], r)
            else:
                spans.append((c, r, r))
    edges = {c: [] for c in wanted}
    for c, first, last in spans:
        edges[c] += [(min(max(r, 0.0), sizes[c] - 1.0) + 0.5) / sizes[c] for r in (first - reach_of[c], last + reach_of[c])]
    sketch = _in_parts(table, list(wanted), settings, lambda c: [
        F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(c, SKETCH), F.array(*[F.lit(e) for e in edges[c]])).alias(f"q_{c}"),
        F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")])
    brackets: dict[tuple[str, int, int], tuple[float, float]] = {}
    at = dict.fromkeys(wanted, 0)
    for c, first, last in spans:
        lo, hi = sketch[f"q_{c}"][at[c]:at[c] + 2]
        reach = reach_of[c]
        brackets[c, first, last] = (sketch[f"lo_{c}"] if first <= reach else lo, sketch[f"hi_{c}"] if last >= sizes[c] - 1 - reach else hi)
        at[c] += 2

    below = _below(table, brackets)
    missed: dict[str, list[int]] = {}
    for (c, first, last), (under, inside) in below.items():
        if not (under <= first and last < under + inside):
            missed.setdefault(c, []).extend(range(first, last + 1))
            del brackets[c, first, last]
    found = {(c, r): lo for (c, first, last), (lo, hi) in brackets.items() if lo == hi for r in range(first, last + 1)}
    if missed:
        found.update(order_statistics(table, missed, sizes, settings, slack * 16))
    open_keys = [k for k, (lo, hi) in brackets.items() if lo != hi]
    if not open_keys:
        return found
    candidates = table.select(F.explode(F.array(*[
        F.when(F.col(c).between(*brackets[c, first, last]), F.struct(F.lit(i).alias("bracket"), F.col(c).alias("value")))
        for i, (c, first, last) in enumerate(open_keys)
    ])).alias("x")).where("x is not null").groupBy("x.bracket", "x.value").agg(F.count("*").alias("n"))
    upto = grouped_totals(candidates, ["bracket"], "value", ["n"])
    needs = F.array(*[F.array(*[F.lit(r - below[k][0]) for r in range(k[1], k[2] + 1)]) for k in open_keys])
    held = upto.select("bracket", "value", "n", "upto_n", F.posexplode(F.element_at(needs, F.col("bracket") + 1)).alias("nth", "need"))
    for row in held.where((F.col("upto_n") > F.col("need")) & (F.col("upto_n") - F.col("n") <= F.col("need"))).select("bracket", "nth", "value").collect():
        c, first, _ = open_keys[row["bracket"]]
        found[c, first + row["nth"]] = row["value"]
    return found


def _below(table, brackets):
    """Per bracket, how many values lie below it and how many inside."""
    out, items = {}, list(brackets.items())
    for start in range(0, len(items), 40):
        part = items[start:start + 40]
        row = table.agg(*[e for i, ((c, *_), (lo, hi)) in enumerate(part) for e in (
            F.count_if(F.col(c) < lo).alias(f"b{i}"), F.count_if(F.col(c).between(lo, hi)).alias(f"i{i}"))]).first()
        out.update({key: (row[f"b{i}"], row[f"i{i}"]) for i, (key, _) in enumerate(part)})
    return out
