"""Pearson, Spearman and Kendall correlation of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabscope.functions.columns import banded, col, fields, finite, in_passes, of_kind
from tabscope.functions.pvalues import EXACT_ROWS, correlation_p_value, kendall_p_value, normal_p_value
from tabscope.plans.facts import NumberFacts, number_facts
from tabscope.plans.gram import pair_sums
from tabscope.plans.running import grouped_totals, with_ranks
from tabscope.plans.stored import fixed, stored
from tabscope.settings import DEFAULT, Settings

PAIR_SCHEMA = ("column_a string, column_b string, r double, abs_r double, p_value double, "
               "n_observations bigint, reliable boolean, strength string, direction string")


def eligible_columns(df: DataFrame, columns: Sequence[str] | None = None, *,
                     facts: dict[str, NumberFacts] | None = None) -> list[str]:
    """Numeric columns with two distinct finite values or more."""
    names = of_kind(df, "numeric", columns)
    facts = number_facts(df, names, mads=False, quartiles=False) if facts is None else facts
    return [n for n in names if facts[n].distinct_class >= 2]


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson", *,
                      settings: Settings = DEFAULT, eligible: Sequence[str] | None = None,
                      with_p: bool = True) -> DataFrame:
    """Every pair of distinct columns once, over the rows where both are finite."""
    names = list(eligible) if eligible is not None else eligible_columns(df, columns)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    table = df.select(*[finite(f).alias(f"v{i}") for i, f in enumerate(fields(df, names))])
    pairs = list(combinations(range(len(names)), 2))
    if method == "pearson":
        raw = pearson(table, pairs, settings)
    elif method == "spearman":
        raw = spearman(table, pairs, settings)
    elif method == "kendall":
        raw = kendall(table, pairs, settings)
    else:
        raise ValueError("method must be pearson, spearman or kendall")
    label = F.array(*[F.lit(n) for n in names])
    raw = raw.where("r is not null and not isnan(r)").select(
        "*", F.element_at(label, F.col("a") + 1).alias("column_a"),
        F.element_at(label, F.col("b") + 1).alias("column_b"), F.abs("r").alias("abs_r"))
    p = F.lit(None).cast("double")
    if with_p:
        wanted = (F.col("abs_r") >= settings.p_value_from) & (F.col("n") >= 3)
        if method == "kendall":
            value = F.coalesce(kendall_p_value("exact", "n"), normal_p_value(F.coalesce("z", F.lit(0.0))))
        else:
            value = correlation_p_value("r", "n")
        p = F.when(wanted, value)
    s = settings
    return raw.select(
        "column_a", "column_b", "r", "abs_r", p.alias("p_value"), F.col("n").alias("n_observations"),
        (F.col("n") >= s.min_pair_rows).alias("reliable"), strength("abs_r", s).alias("strength"),
        F.when(F.col("r") >= 0, "positive").otherwise("negative").alias("direction"))


def strength(abs_r, s: Settings = DEFAULT):
    return banded(F.col(abs_r), [(s.r_weak, "weak"), (s.r_moderate, "moderate"), (s.r_strong, "strong"),
                                 (s.r_near_perfect, "near-perfect")], "very weak")


#: Of a column's mean square over a pair's rows, the share its variance there must exceed for its digits to be kept.
SPREAD_SHARE = 1e-6


def pearson(table: DataFrame, pairs: Sequence[tuple[int, int]], settings: Settings = DEFAULT) -> DataFrame:
    """(a, b, r, n, z) per pair, from one scan of matrix products, whatever the gaps.

    A column that hardly varies over a pair's rows, compared with how far these lie from its mean, is measured again for
    that pair alone.
    """
    used = sorted({i for p in pairs for i in p})
    place = {c: i for i, c in enumerate(used)}
    values = table.select(*[f"v{i}" for i in used])
    center, spread = _moments(values, settings)
    wanted = table.sparkSession.createDataFrame(
        [(min(place[a], place[b]), max(place[a], place[b]), place[a] > place[b]) for a, b in pairs], "a int, b int, turned boolean")
    sums = pair_sums(values, center, spread).join(F.broadcast(wanted), ["a", "b"])
    n = F.col("n")
    variance = {c: F.col(f"squares_{c}") / n - F.pow(F.col(f"sum_{c}") / n, 2) for c in "ab"}
    flat = F.lit(False)
    for c in "ab":
        flat = flat | ((F.col(f"squares_{c}") > 0) & (variance[c] <= SPREAD_SHARE * F.col(f"squares_{c}") / n))
    r = F.try_divide(F.col("products") / n - F.col("sum_a") / n * F.col("sum_b") / n, F.sqrt(F.greatest(variance["a"], F.lit(0.0)) * F.greatest(variance["b"], F.lit(0.0))))
    at = F.array(*[F.lit(c) for c in used])
    one, two = F.element_at(at, F.col("a") + 1), F.element_at(at, F.col("b") + 1)
    found = fixed(sums.select(
        F.when(F.col("turned"), two).otherwise(one).alias("a"), F.when(F.col("turned"), one).otherwise(two).alias("b"),
        _limited(r).alias("r"), "n", F.lit(None).cast("double").alias("z"), flat.alias("flat")))
    again = [(row["a"], row["b"]) for row in found.where("flat").collect()]
    found = found.where("not flat").drop("flat")
    return found.unionByName(_pearson_alone(table, again, settings)) if again else found


def _limited(r: Column) -> Column:
    """Within -1 and 1; NULL where it is not defined, which least and greatest would pass over."""
    return F.when(r.isNotNull() & ~F.isnan(r), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))


def _moments(values: DataFrame, settings: Settings) -> tuple[list[float], list[float]]:
    """Means and deviations of all columns."""
    center, spread = [], []
    step = max(1, settings.fields_per_pass // 8)
    for start in range(0, len(values.columns), step):
        some = values.columns[start:start + step]
        row = values.agg(*[e for c in some for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
        center += [row[f"m_{c}"] or 0.0 for c in some]
        spread += [row[f"s_{c}"] or 0.0 for c in some]
    return center, spread


def _pearson_alone(table: DataFrame, pairs: Sequence[tuple[int, int]], settings: Settings) -> DataFrame:
    """(a, b, r, n, z) per pair, each over its own rows, in scans small enough for generated code."""
    def build(i, pair):
        a, b = pair
        both = F.col(f"v{a}").isNotNull() & F.col(f"v{b}").isNotNull()
        # within the pair's rows a column may be constant
        x, y = F.when(both, F.col(f"v{a}")), F.when(both, F.col(f"v{b}"))
        exprs = [F.covar_pop(f"v{a}", f"v{b}").alias(f"c{i}"), F.stddev_pop(x).alias(f"x{i}"), F.stddev_pop(y).alias(f"y{i}")]
        r = F.try_divide(F.col(f"c{i}"), F.col(f"x{i}") * F.col(f"y{i}"))
        return [*exprs, F.count_if(both).alias(f"n{i}")], F.struct(
            F.lit(a).alias("a"), F.lit(b).alias("b"), _limited(r).alias("r"),
            F.col(f"n{i}").alias("n"), F.lit(None).cast("double").alias("z"))

    return in_passes(table, list(pairs), 11, build, settings.fields_per_pass)


def spearman(table: DataFrame, pairs: Sequence[tuple[int, int]], settings: Settings = DEFAULT) -> DataFrame:
    """Pearson correlation of average ranks within the pair's complete rows.

    Columns without gaps are ranked once and share one matrix product; pairs with gaps are counted by their values and
    ranked within themselves, all of them together.
    """
    used = sorted({i for p in pairs for i in p})
    row = table.agg(F.count(F.lit(1)).alias("rows"), *[F.count(f"v{i}").alias(f"n{i}") for i in used]).first()
    full = {i for i in used if row[f"n{i}"] == row["rows"]}
    shared = [p for p in pairs if p[0] in full and p[1] in full]
    others = [p for p in pairs if not (p[0] in full and p[1] in full)]
    parts = []
    if shared:
        needed = sorted({i for p in shared for i in p})
        only = table.select(*[f"v{i}" for i in needed])
        ranked = with_ranks(only, only, {f"v{i}": f"r{i}" for i in needed})
        # stored, as means and products are two scans
        parts.append(pearson(stored(ranked.select(*[F.col(f"r{i}").alias(f"v{i}") for i in needed]), "ranked"), shared, settings))
    if others:
        cells, sides = pair_cells(table, others)
        ranks = grouped_totals(sides, ["pair", "side"], "value", ["n"]).select(
            "pair", "side", "value", (F.col("upto_n") - (F.col("n") - 1) / 2).alias("rank"))
        both = with_sides(cells, stored(ranks, "ranks"), "rank")
        middle = (cells.groupBy("pair").agg(F.sum("n").alias("total")).select("pair", ((F.col("total") + 1) / 2).alias("middle")))
        weight, x, y = F.col("n").cast("double"), F.col("rank_a") - F.col("middle"), F.col("rank_b") - F.col("middle")
        sums = both.join(F.broadcast(middle), "pair").groupBy("pair").agg(
            F.sum("n").alias("n"), F.sum(weight * x * y).alias("xy"), F.sum(weight * x * x).alias("xx"), F.sum(weight * y * y).alias("yy"))
        r = F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy"))
        parts.append(_of_pair(sums, others).select("a", "b", _limited(r).alias("r"), "n",
                                                   F.lit(None).cast("double").alias("z")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def pair_cells(table: DataFrame, pairs: Sequence[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """Distinct value pairs (pair, a, b, n) of all pairs of columns, and their sides (pair, side, value, n, cells)."""
    each = F.array(*[F.when(F.col(f"v{a}").isNotNull() & F.col(f"v{b}").isNotNull(),
                            F.struct(F.lit(p).alias("pair"), F.col(f"v{a}").alias("a"), F.col(f"v{b}").alias("b"))) for p, (a, b) in enumerate(pairs)])
    cells = stored(table.select(F.explode(each).alias("cell")).where("cell is not null").groupBy("cell.pair", "cell.a", "cell.b").agg(
        F.count("*").alias("n")), "pair-cells")
    sides = cells.select("pair", "n", F.posexplode(F.array("a", "b")).alias("side", "value")).groupBy("pair", "side", "value").agg(
        F.sum("n").alias("n"), F.count("*").alias("cells"))
    return cells, sides


def with_sides(cells: DataFrame, sides: DataFrame, name: str) -> DataFrame:
    """Add ``<name>_a`` and ``<name>_b``, looked up by pair, side and value: two joins whatever the number of pairs."""
    for side, key in enumerate("ab"):
        own = sides.where(F.col("side") == side).select(F.col("pair").alias("of_pair"), F.col("value").alias("of"), F.col(name).alias(f"{name}_{key}"))
        cells = cells.join(own, (F.col("pair") == F.col("of_pair")) & (F.col(key) == F.col("of"))).drop("of_pair", "of")
    return cells


def _of_pair(df: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """``df`` with the columns a and b of its pair numbers."""
    known = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    return df.withColumn("of_pair", F.element_at(known, F.col("pair") + 1)).select("*", "of_pair.a", "of_pair.b").drop("of_pair")


def kendall(table: DataFrame, pairs: Sequence[tuple[int, int]], settings: Settings = DEFAULT) -> DataFrame:
    """(a, b, r, n, z): tau-b per pair, with the z-value of the tie-corrected normal approximation."""
    cells, sides = pair_cells(table, pairs)
    sides = stored(sides, "pair-sides")
    wrong = discordant(cells, sides, settings.inversion_block)
    t = F.col("n").cast("double")
    ties = sides.groupBy("pair").agg(*[F.sum(F.when(F.col("side") == side, term)).alias(f"{name}{key}") for side, key in enumerate("xy") for name, term in (
        ("t", t * (t - 1) / 2), ("t0", t * (t - 1) * (t - 2)), ("t1", t * (t - 1) * (2 * t + 5)))])
    whole = cells.groupBy("pair").agg(F.sum("n").alias("n"), F.sum(t * (t - 1) / 2).alias("txy"))
    row = whole.join(ties, "pair").join(wrong, "pair", "left").withColumn("dis", F.coalesce("dis", F.lit(0.0)))
    n = F.col("n").cast("double")
    total = n * (n - 1) / 2
    excess = total - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("dis")
    tau = F.try_divide(excess, F.sqrt(total - F.col("tx")) * F.sqrt(total - F.col("ty")))
    mm = n * (n - 1)
    variance = ((mm * (2 * n + 5) - F.col("t1x") - F.col("t1y")) / 18 + F.coalesce(F.try_divide(2 * F.col("tx") * F.col("ty"), mm), F.lit(0.0))
                + F.coalesce(F.try_divide(F.col("t0x") * F.col("t0y"), 9 * mm * (n - 2)), F.lit(0.0)))
    exact = F.when((F.col("tx") == 0) & (F.col("ty") == 0) & exact_from(n, F.col("dis")), F.col("dis").cast("bigint"))
    return _of_pair(row, pairs).select("a", "b", tau.alias("r"), "n", F.try_divide(excess, F.sqrt(variance)).alias("z"), exact.alias("exact"))


def exact_from(n, dis):
    """Whether the exact distribution of discordant pairs is used, for samples without ties: small ones, or almost ordered ones."""
    return (n <= EXACT_ROWS) | (F.least(dis, n * (n - 1) / 2 - dis) <= 1)


def discordant(cells: DataFrame, sides: DataFrame, block: int) -> DataFrame:
    """(pair, dis): rows that are in one order by a and in the other by b, from distinct values and their counts.

    Values of either side are cut into blocks of consecutive ones of some ``block`` cells; a value of more is a block
    alone.  Two discordant cells share their block of a, or share that of b only, or share none.  The first two kinds are
    counted within groups of bounded size; the third is the same question over blocks instead of values, asked again
    until a pair is one block.
    """
    parts = None
    while True:
        placed = grouped_totals(sides, ["pair", "side"], "value", ["cells"])
        before = F.floor((F.col("upto_cells") - F.col("cells")) / block)
        number = (2 * before + F.when(F.col("cells") > block, 1).otherwise(0)).cast("double").alias("block")
        blocks = stored(placed.select("pair", "side", "value", number), "blocks")
        at = stored(with_sides(cells, blocks, "block"), "placed-cells")
        # (group, x, y): within a block of a by both values, within a block of b by the block of a and b's value
        two = F.array(F.struct(F.lit(0).alias("kind"), F.col("block_a").alias("of"), F.col("a").alias("x"), F.col("b").alias("y")),
                      F.struct(F.lit(1).alias("kind"), F.col("block_b").alias("of"), F.col("block_a").alias("x"), F.col("b").alias("y")))
        # blocks of one value hold nothing discordant, however large
        varied = blocks.groupBy("pair", "side", "block").agg(F.count("*").alias("values")).where("values > 1").select(
            F.col("pair").alias("of_pair"), F.col("side").alias("of_side"), F.col("block").alias("of_block"))
        groups = at.select("pair", "n", F.explode(two).alias("g")).select("pair", "g.kind", "g.of", "g.x", "g.y", "n").join(
            varied, (F.col("pair") == F.col("of_pair")) & (F.col("kind") == F.col("of_side")) & (F.col("of") == F.col("of_block")), "left_semi")
        found = groups.groupBy("pair", "kind", "of").applyInArrow(_inversions_of_group, "pair int, dis double")
        parts = found if parts is None else parts.unionByName(found)
        grid = at.groupBy("pair", "block_a", "block_b").agg(F.sum("n").alias("n")).select(
            "pair", F.col("block_a").alias("a"), F.col("block_b").alias("b"), "n")
        several = blocks.groupBy("pair", "side").agg(F.count_distinct("block").alias("blocks")).groupBy("pair").agg(
            F.min("blocks").alias("blocks")).where("blocks > 1").select(F.col("pair").alias("of_pair"))
        cells = stored(grid.join(several, F.col("pair") == F.col("of_pair"), "left_semi"), "block-cells")
        if cells.isEmpty():
            return parts.groupBy("pair").agg(F.sum("dis").alias("dis"))
        sides = cells.select("pair", F.posexplode(F.array("a", "b")).alias("side", "value")).groupBy("pair", "side", "value").agg(
            F.count("*").alias("cells"))
        block *= 4  # so that it ends even where every value had more cells than a block


def _inversions_of_group(group: pa.Table) -> pa.Table:
    x, y, n = (group[c].to_numpy() for c in ("x", "y", "n"))
    return pa.table({"pair": pa.array([group["pair"][0].as_py()], pa.int32()), "dis": pa.array([inversions(x, y, n)])})


def inversions(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Sum of n n' over all couples with x < x' and y > y'.

    Two numbers of y first differ at one binary digit: of those that agree above it, each with a 0 there is discordant
    with every one of smaller x that has a 1.
    """
    order = np.lexsort((y, x))  # of equal x, smaller y first, so that these are not counted
    code = np.unique(y, return_inverse=True)[1][order]
    weight = n[order].astype(float)
    total = 0.0
    for digit in range(int(code.max(initial=0)).bit_length() - 1, -1, -1):
        prefix = code >> (digit + 1)
        by_prefix = np.argsort(prefix, kind="stable")
        bit = (code[by_prefix] >> digit) & 1
        own = weight[by_prefix]
        ones = np.cumsum(own * bit)
        heads = np.flatnonzero(np.diff(prefix[by_prefix], prepend=-1))
        before = np.concatenate([[0.0], ones])[heads]
        ones -= np.repeat(before, np.diff(np.append(heads, len(code))))
        total += float((own * (1 - bit) * ones).sum())
    return total


def kendall_pair(table: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One row (r, n, z) for columns x and y."""
    return kendall(table.select(F.col("x").alias("v0"), F.col("y").alias("v1")), [(0, 1)], settings).select("r", "n", "z")


def correlation_matrix(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Square matrix (one row per column, one field per column) from a pairs table."""
    one = pairs.select(F.col("column_a").alias("column"), F.col("column_b").alias("other"), "r")
    two = pairs.select(F.col("column_b").alias("column"), F.col("column_a").alias("other"), "r")
    diagonal = pairs.sparkSession.createDataFrame([(c, c, 1.0) for c in columns],
                                                  "column string, other string, r double")
    return (one.unionByName(two).unionByName(diagonal).groupBy("column")
            .pivot("other", list(columns)).agg(F.first("r")))


def strong_pairs(pairs: DataFrame, *, settings: Settings = DEFAULT) -> DataFrame:
    """Pairs of note, one row per set they belong to: positive, negative, multicollinear, near duplicate."""
    s, r = settings, F.col("r")
    sets = F.filter(F.array(
        F.when(r >= s.r_strong, F.lit("strong_positive")),
        F.when(r <= -s.r_strong, F.lit("strong_negative")),
        F.when(F.col("abs_r") >= s.r_multicollinear, F.lit("multicollinear")),
        F.when(F.col("abs_r") >= s.r_near_duplicate, F.lit("near_duplicate"))), lambda x: x.isNotNull())
    return (pairs.select(F.explode(sets).alias("pair_set"), "column_a", "column_b", "r", "abs_r", "n_observations")
            .orderBy("pair_set", F.desc("abs_r"), "column_a", "column_b"))


def top_pairs(pairs: DataFrame, limit: int | None = None, *, settings: Settings = DEFAULT) -> DataFrame:
    """The strongest pairs, coefficients rounded to four decimals."""
    limit = settings.correlation_table_rows if limit is None else limit
    return (pairs.orderBy(F.desc("abs_r"), "column_a", "column_b").limit(limit)
            .select("column_a", "column_b", F.round("r", 4).alias("r"), F.round("abs_r", 4).alias("abs_r"),
                    "strength", "direction", "n_observations", "p_value"))


def scatter_rows(df: DataFrame, x: str, y: str, *, flag=None, color: str | None = None) -> DataFrame:
    """All points of two columns that are finite in both, marked by ``flag`` and coloured."""
    fx, fy = [finite(f) for f in fields(df, [x, y])]
    extra = [F.coalesce(flag, F.lit(False)).alias("flagged")] if flag is not None else [F.lit(False).alias("flagged")]
    if color:
        extra.append(col(color).alias("color"))
    return df.select(fx.alias("x"), fy.alias("y"), *extra).where("x is not null and y is not null")
