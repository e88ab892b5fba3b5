"""Signals that a column may leak the prediction target. Signals are hints, not verdicts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabscope import settings as S
from tabscope.functions.columns import (
    col, count_text, fields, finite, groupable, name_list, name_tokens, of_kind, percent_text, plain_number, present,
    severity_rank, share, stored_kind, words,
)
from tabscope.operators.correlation import spearman
from tabscope.operators.profile import column_roles, is_number_text, text_probe, value_facts
from tabscope.plans.counts import distinct_counts, value_counts
from tabscope.plans.facts import number_facts
from tabscope.plans.running import grouped_totals, long_counts
from tabscope.plans.stored import fixed, stored
from tabscope.settings import DEFAULT, Settings

SIGNAL_SCHEMA = ("column string, signal string, severity string, reasoning string, recommendation string, "
                 "confidence string, evidence string")
CHECK = "Possible leakage: look into this column. "


def column_facts(df: DataFrame, *, settings: Settings = DEFAULT, roles: DataFrame | None = None,
                 probe: DataFrame | None = None, distinct: DataFrame | None = None) -> DataFrame:
    """One row per column: what the name and value rules need."""
    if probe is None and distinct is None:
        texts = of_kind(df, "text")
        known = fixed(value_facts(value_counts(df), texts))
        probe, distinct = known.where(F.col("column").isin(*texts)).drop("n_unique"), known.select("column", "n_present", "n_unique")
    probe = text_probe(df) if probe is None else probe
    distinct = distinct_counts(value_counts(df)) if distinct is None else distinct
    roles = column_roles(df, settings=settings, probe=probe, distinct=distinct) if roles is None else roles
    numeric = [f.name for f in fields(df) if stored_kind(f.dataType) in ("numeric", "boolean")]
    number_text = probe.select("column", (is_number_text(settings) & (F.col("n_present") > 0)).alias("number_text"))
    return (roles.select("position", "column", "role")
            .join(distinct, "column", "left").join(number_text, "column", "left")
            .select("position", "column", "role", F.col("column").isin(*numeric).alias("numeric"),
                    F.coalesce("number_text", F.lit(False)).alias("number_text"),
                    F.coalesce("n_present", F.lit(0)).cast("long").alias("n_present"),
                    F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique")))


def target_candidates(facts: DataFrame, *, settings: Settings = DEFAULT) -> DataFrame:
    """Columns named like a prediction target; the best score wins, the last one on ties."""
    name = F.lower(F.trim("column"))
    tokens = name_tokens(name)
    lone = F.when(F.size(tokens) == 1, F.element_at(tokens, 1))
    affix = F.lit(False)
    for p in S.TARGET_PREFIXES:
        affix = affix | name.startswith(p)
    for p in S.TARGET_SUFFIXES:
        affix = affix | name.endswith(p)
    score = (F.when(name.isin(*S.TARGET_EXACT) | F.coalesce(lone.isin(*S.TARGET_EXACT), F.lit(False)), F.lit(3))
             .when(affix | F.arrays_overlap(tokens, words(S.TARGET_TOKENS)), F.lit(2)).otherwise(F.lit(0)))
    score = F.when((score > 0) & (F.col("n_unique") > settings.target_levels) & ~F.col("numeric"), score - 1).otherwise(score)
    found = (facts.where((F.col("n_unique") >= 2) & (F.col("role") != "datetime"))
             .select("position", "column", score.alias("score")).where("score > 0"))
    last = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("position")))  # <= #columns rows
    return found.withColumn("chosen", last == 1).orderBy("score", "position")


def guess_target(facts: DataFrame, *, settings: Settings = DEFAULT) -> str | None:
    row = target_candidates(facts, settings=settings).where("chosen").first()
    return row["column"] if row else None


def _literal(name: str) -> str:
    return name.replace("%", "%%")


def _not_target(target: str | None) -> Column:
    return F.lit(True) if target is None else F.col("column") != target


def identifier_signals(facts: DataFrame, target: str | None = None, *, settings: Settings = DEFAULT) -> DataFrame:
    """Columns that behave or are named like record keys."""
    s = settings
    ratio = share(F.col("n_unique"), F.col("n_present"))
    named = F.arrays_overlap(name_tokens(F.lower("column")), words(S.ID_TOKENS))
    key_like = (ratio >= s.identifier_ratio) & ~F.col("numeric") & ~F.col("number_text")
    name_like = named & F.col("numeric") & (F.col("n_unique") > s.identifier_numeric_distinct)
    reasoning = F.when(key_like, F.concat(
        percent_text(ratio, 2), F.lit(" of the "), count_text(F.col("n_present")),
        F.lit(" values are distinct, as in a record key; a new record brings a value never seen before."),
        F.when(named, F.lit(" The name reads like an identifier too.")).otherwise(F.lit("")))).otherwise(
        F.concat(F.lit("The name reads like an identifier and there are "), count_text(F.col("n_unique")),
                 F.lit(" distinct values.")))
    return (facts.where(_not_target(target) & (key_like | name_like)).select(
        "column", F.lit("identifier_like").alias("signal"),
        F.when(key_like & named, F.lit("moderate")).otherwise(F.lit("low")).alias("severity"),
        reasoning.alias("reasoning"),
        F.lit(CHECK + "Keep keys out of the features unless their values recur.").alias("recommendation"),
        F.when(~key_like, F.lit("low")).when(ratio >= s.identifier_sure_ratio, F.lit("high"))
        .otherwise(F.lit("medium")).alias("confidence"),
        F.to_json(F.struct(ratio.alias("unique_ratio"), "n_unique")).alias("evidence")))


def duplicate_pairs(df: DataFrame, columns: Sequence[str] | None = None, *,
                    settings: Settings = DEFAULT) -> DataFrame:
    """(column_a, column_b, compared): columns of one type equal on every row where both exist.

    One scan refutes pairs by hashes of their values, whatever their number; the few left are compared over all rows.
    """
    usable = set(groupable(df))
    wanted = [f for f in fields(df, columns) if f.name in usable]
    pairs = [(a, b) for a, b in combinations(wanted, 2) if a.dataType == b.dataType]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, compared bigint")
    place = {f.name: i for i, f in enumerate(wanted)}
    refuted = refuted_pairs(df, wanted, [(place[a.name], place[b.name]) for a, b in pairs])
    pairs = [p for k, p in enumerate(pairs) if k not in refuted]
    rows = df.count()
    floor = max(settings.copy_min_rows, settings.copy_min_overlap * rows)
    same = [(a.name, b.name, both) for (a, b), (both, differ) in _compare(df, pairs, settings)
            if both >= floor and not differ]
    return df.sparkSession.createDataFrame(same, "column_a string, column_b string, compared bigint")


#: Rows of a batch that are compared first, pairs compared at a time, and pairs in one of Spark's bitmaps.
FIRST_LOOK, PAIRS_AT_ONCE, BITMAP = 64, 1 << 14, 1 << 15


def refuted_pairs(df: DataFrame, columns: Sequence[T.StructField], pairs: Sequence[tuple[int, int]]) -> set[int]:
    """Numbers of the pairs (places in ``columns``) that differ in a row where both have a value, by one job.

    A task keeps the pairs that nothing refutes yet, which are few after its first rows, and hands over a bitmap of those
    refuted; bitmaps are joined by one aggregation.
    """
    hashes = []
    for i, f in enumerate(columns):
        c = col(f.name)
        value = c + F.lit(0.0) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c  # one zero
        hashes.append(F.when(present(f), F.xxhash64(value)).alias(f"h{i}"))
    one, two = (np.array(side, np.int64) for side in zip(*pairs, strict=True))
    buckets = -(-len(pairs) // BITMAP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = np.arange(len(one))
        for batch in batches:
            if not len(left):
                break
            known = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            value = np.stack([c.fill_null(0).to_numpy() for c in batch.columns], axis=1)
            for rows in (slice(0, FIRST_LOOK), slice(FIRST_LOOK, None)):
                same = np.ones(len(left), bool)
                for at in range(0, len(left), PAIRS_AT_ONCE):
                    for k in range(at, min(len(left), at + PAIRS_AT_ONCE)) if rows.stop is None else ():
                        a, b = one[left[k]], two[left[k]]
                        same[k] = not ((value[rows, a] != value[rows, b]) & known[rows, a] & known[rows, b]).any()
                    if rows.stop is not None:
                        part = left[at:at + PAIRS_AT_ONCE]
                        a, b = one[part], two[part]
                        same[at:at + len(part)] = ~((value[rows][:, a] != value[rows][:, b]) & known[rows][:, a] & known[rows][:, b]).any(axis=0)
                left = left[same]
        bits = np.ones(buckets * BITMAP, bool)
        bits[left] = False
        packed = np.packbits(bits, bitorder="little").reshape(buckets, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int64)), pa.array([p.tobytes() for p in packed], pa.binary())], names=["bucket", "bits"])

    found = df.select(*hashes).mapInArrow(run, "bucket bigint, bits binary").groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    refuted: set[int] = set()
    for row in found.toArrow().to_pylist():
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
        refuted.update((row["bucket"] * BITMAP + np.flatnonzero(bits)).tolist())
    return refuted


def _compare(df, pairs, settings):
    out = []
    for start in range(0, len(pairs), settings.fields_per_pass // 2):
        part = pairs[start:start + settings.fields_per_pass // 2]
        exprs = []
        for i, (a, b) in enumerate(part):
            both = present(a) & present(b)
            exprs += [F.count_if(both).alias(f"b{i}"), F.count_if(both & (col(a.name) != col(b.name))).alias(f"d{i}")]
        row = df.agg(*exprs).first()
        out += [(p, (row[f"b{i}"], row[f"d{i}"])) for i, p in enumerate(part)]
    return out


def duplicate_column_signals(df: DataFrame, target: str | None = None, *, settings: Settings = DEFAULT,
                             pairs: DataFrame | None = None) -> DataFrame:
    """Columns that copy another column, or the target."""
    pairs = duplicate_pairs(df, settings=settings) if pairs is None else pairs
    hit = F.lit(False) if target is None else (F.col("column_a") == target) | (F.col("column_b") == target)
    column = F.col("column_b") if target is None else (
        F.when(F.col("column_b") == target, F.col("column_a")).otherwise(F.col("column_b")))
    return pairs.select(
        column.alias("column"), F.when(hit, F.lit("target_copy")).otherwise(F.lit("duplicate_column")).alias("signal"),
        F.when(hit, F.lit("critical")).otherwise(F.lit("high")).alias("severity"),
        F.concat(F.col("column_a"), F.lit(" and "), F.col("column_b"), F.lit(" are equal on all "),
                 count_text(F.col("compared")), F.lit(" rows that have both."),
                 F.when(hit, F.lit(" One of them is the target.")).otherwise(F.lit(""))).alias("reasoning"),
        F.lit(CHECK + "Keep one copy.").alias("recommendation"), F.lit("high").alias("confidence"),
        F.to_json(F.struct(F.col("column_a").alias("identical_to"), F.col("compared").alias("rows_compared"))).alias("evidence"))


def target_correlations(df: DataFrame, target: str, *, settings: Settings = DEFAULT) -> DataFrame:
    """(column, r, n): Spearman correlation of each numeric column with a numeric target."""
    schema = "column string, r double, n bigint"
    spark = df.sparkSession
    f = fields(df, [target])[0]
    kind = stored_kind(f.dataType)
    if kind not in ("numeric", "text"):
        return spark.createDataFrame([], schema)
    goal = finite(f) if kind == "numeric" else plain_number(col(target))
    features = [x for x in fields(df) if x.name != target and stored_kind(x.dataType) == "numeric"]
    usable, rows = df.agg(F.count(goal), F.count(F.lit(1))).first()
    named = df.select(goal.alias("goal"))
    if (not features or usable < max(settings.copy_min_rows, settings.copy_min_overlap * rows)
            or number_facts(named, mads=False, quartiles=False)["goal"].distinct_class <= 2):
        return spark.createDataFrame([], schema)
    table = df.select(goal.alias("v0"), *[finite(x).alias(f"v{i + 1}") for i, x in enumerate(features)])
    raw = spearman(table, [(i + 1, 0) for i in range(len(features))], settings)
    label = F.element_at(F.array(*[F.lit(x.name) for x in features]), F.col("a"))
    return raw.where((F.col("n") >= settings.min_pair_rows) & F.col("r").isNotNull() & ~F.isnan("r")).select(
        label.alias("column"), "r", "n")


def target_correlation_signals(df: DataFrame, target: str, *, settings: Settings = DEFAULT) -> DataFrame:
    found = target_correlations(df, target, settings=settings).where(F.abs("r") >= settings.target_correlation)
    return found.select(
        "column", F.lit("target_correlation").alias("signal"), F.lit("high").alias("severity"),
        F.format_string(f"Spearman r = %+.4f with the target {_literal(target)} over %,d rows; a feature this close is "
                        "often computed from the outcome.", "r", "n").alias("reasoning"),
        F.lit(CHECK + "Ask when the value becomes known.").alias("recommendation"),
        F.lit("medium").alias("confidence"),
        F.to_json(F.struct(F.col("r").alias("correlation"), F.lit(target).alias("target"), "n")).alias("evidence"))


def separation(df: DataFrame, target: str, *, settings: Settings = DEFAULT,
               facts: DataFrame | None = None) -> DataFrame:
    """(column, accuracy, n): how well one rule on the column reproduces a two-valued target.

    Numeric columns: the best single threshold in either direction, set only between
    distinct values.  Others: majority class per level, up to ``separation_levels`` levels; without that limit, all
    whose levels stand twice on average.
    """
    s, spark = settings, df.sparkSession
    schema = "column string, accuracy double, n bigint"
    t = fields(df, [target])[0]
    goal = F.when(present(t), col(target))
    low, high, known, rows = df.agg(F.min(goal), F.max(goal), F.count(goal), F.count(F.lit(1))).first()
    if known < s.separation_rows or low == high:
        return spark.createDataFrame([], schema)
    low, high = F.lit(low).cast(t.dataType), F.lit(high).cast(t.dataType)
    positive = F.when(goal == high, F.lit(1)).when(goal == low, F.lit(0))
    between, ones = df.agg(F.count_if(goal.isNotNull() & positive.isNull()), F.sum(positive)).first()
    if between or min(ones, known - ones) < s.separation_class_rows:
        return spark.createDataFrame([], schema)

    usable = set(groupable(df))
    features = [f for f in fields(df) if f.name != target and f.name in usable]
    kinds = {f.name: stored_kind(f.dataType) for f in features}
    is_number = lambda f: kinds[f.name] in ("numeric", "boolean")
    value = {f.name: (finite(f) if kinds[f.name] == "numeric" else
                      col(f.name).cast("int").cast("double") if kinds[f.name] == "boolean" else
                      col(f.name).cast("string")) for f in features}
    levels, filled = {}, {}
    if facts is not None and known == rows:  # then overall counts are the counts that matter
        for r in facts.select("column", "n_present", "n_unique").collect():
            levels[r["column"]], filled[r["column"]] = r["n_unique"], r["n_present"]
    settled = {f.name for f in features if f.name in levels and kinds[f.name] in ("text", "datetime")}
    varying = {f.name for f in _varying(df.where(goal.isNotNull()), [f for f in features if f.name not in settled], value, s)}
    varying |= {c for c in settled if filled[c] >= s.separation_rows and levels[c] >= 2}
    kept = [f for f in features if f.name in varying]
    numbers = [f for f in kept if is_number(f)]
    most = s.separation_levels
    texts = [f for f in kept if not is_number(f) and (most is None or levels.get(f.name, 0) <= most)]
    labelled = df.where(goal.isNotNull()).select(
        positive.cast("long").alias("pos"), *[value[f.name].alias(f"f{i}") for i, f in enumerate(kept)])
    place = {f.name: i for i, f in enumerate(kept)}
    label = F.element_at(F.array(*[F.lit(f.name) for f in kept] or [F.lit("")]), F.col("feature").cast("int") + 1)
    parts = []
    long = lambda fs: (labelled.select("pos", *[F.col(f"f{place[f.name]}").alias(str(place[f.name])) for f in fs])
                       .unpivot(["pos"], [str(place[f.name]) for f in fs], "feature", "value").where("value is not null")
                       .groupBy("feature", "value").agg(F.count("*").alias("n"), F.sum("pos").alias("pos")))
    if texts:
        parts.append(long(texts).groupBy("feature").agg(
            F.count("*").alias("levels"), F.sum("n").alias("n"),
            F.sum(F.greatest(F.col("pos"), F.col("n") - F.col("pos"))).alias("right"))
            .where(2 * F.col("levels") <= F.col("n") if most is None else F.col("levels") <= most)
            .select(label.alias("column"), (F.col("right") / F.col("n")).alias("accuracy"), "n"))
    if numbers:
        columns = [f"f{place[f.name]}" for f in numbers]
        counts = stored(long_counts(labelled, columns, F.sum("pos").alias("pos")), "separation-counts")
        totals = counts.groupBy("feature").agg(F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos"))
        names = F.array(*[F.lit(f.name) for f in numbers])
        # one row per feature
        parts.append(grouped_totals(counts, ["feature"], "value", ["n", "pos"]).join(F.broadcast(totals), "feature").groupBy("feature").agg(
            F.max(_accuracy()).alias("accuracy"), F.max("all_n").alias("n"))
            .select(F.element_at(names, F.col("feature") + 1).alias("column"), "accuracy", "n"))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def separation_levels(df: DataFrame, target: str, *, settings: Settings = DEFAULT) -> DataFrame:
    """(column, n_unique, available, reason) of every text feature: those of too many levels are not tested for separation."""
    rows = df.where(present(fields(df, [target])[0]))
    names = [n for n in of_kind(df, "text") if n != target]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, n_unique bigint, available boolean, reason string")
    most = settings.separation_levels
    many = 2 * F.col("n_unique") > F.col("n_present") if most is None else F.col("n_unique") > most
    reason = "nearly distinct values" if most is None else f"more than {most} levels"
    return distinct_counts(value_counts(rows, names)).select(
        "column", "n_unique", (~many).alias("available"), F.when(many, reason).otherwise("").alias("reason"))


def _accuracy() -> Column:
    right = (F.col("upto_n") - F.col("upto_pos") + F.col("all_pos") - F.col("upto_pos")) / F.col("all_n")
    return F.greatest(right, 1 - right)


def _varying(df, features, value, s):
    """Features with enough rows and at least two distinct values beside the target."""
    kept = []
    for start in range(0, len(features), 20):
        part = features[start:start + 20]
        row = df.agg(*[e for i, f in enumerate(part) for e in (
            F.count(value[f.name]).alias(f"n{i}"), (F.min(value[f.name]) < F.max(value[f.name])).alias(f"v{i}"))]).first()
        kept += [f for i, f in enumerate(part) if row[f"n{i}"] >= s.separation_rows and row[f"v{i}"]]
    return kept


def separation_signals(df: DataFrame, target: str, *, settings: Settings = DEFAULT,
                       facts: DataFrame | None = None) -> DataFrame:
    found = separation(df, target, settings=settings, facts=facts).where(
        F.col("accuracy") >= settings.separation_purity)
    return found.select(
        "column", F.lit("perfect_separation").alias("signal"), F.lit("high").alias("severity"),
        F.format_string(f"One rule on this column gives {_literal(target)} right in %.1f%% of %,d rows; such columns are "
                        "mostly recorded after the outcome.", F.col("accuracy") * 100, "n").alias("reasoning"),
        F.lit(CHECK + "Find out whether the value exists when the prediction is made.").alias("recommendation"),
        F.lit("high").alias("confidence"),
        F.to_json(F.struct("accuracy", F.lit(target).alias("target"), "n")).alias("evidence"))


def outcome_name_signals(facts: DataFrame, target: str | None = None) -> DataFrame:
    """Columns whose names speak of the time after the outcome."""
    tokens = name_tokens(F.col("column"))
    matched = lambda names: F.array_intersect(tokens, words(names))
    status = (F.col("role") == "datetime") | (F.col("n_unique") <= 2)
    post = F.when(status, matched(S.POST_OUTCOME_TOKENS + S.CONDITIONAL_OUTCOME_TOKENS)).otherwise(
        matched(S.POST_OUTCOME_TOKENS))
    strong = F.array_union(post, matched(S.OUTCOME_TOKENS))
    every = F.array_sort(F.array_union(strong, matched(S.WEAK_OUTCOME_TOKENS)))
    weak = F.size(strong) == 0
    return facts.where(_not_target(target) & (F.size(every) > 0)).select(
        "column", F.lit("outcome_name").alias("signal"),
        F.when(weak, F.lit("info")).otherwise(F.lit("low")).alias("severity"),
        F.concat(F.lit("The name holds "), name_list(every), F.when(weak, F.lit(
            ", common in plain measurements: a reminder to check the timing.")).otherwise(F.lit(
                ", words often given to what happens after the event."))).alias("reasoning"),
        F.lit(CHECK + "See in the documentation when it is filled in.").alias("recommendation"),
        F.lit("low").alias("confidence"),
        F.to_json(F.struct(every.alias("matched_tokens"), status.alias("status_like"))).alias("evidence"))


def chosen_target(signals: DataFrame) -> str | None:
    """The target that was guessed for want of a given one."""
    row = signals.where("signal = 'target_selection' and column <> 'n/a'").select("column").first()
    return row["column"] if row else None


def leakage_signals(df: DataFrame, target: str | None = None, *, settings: Settings = DEFAULT,
                    facts: DataFrame | None = None) -> DataFrame:
    """All signals, one per column and kind (the most severe), worst first.

    Without a target one is guessed from the names; the choice is the last row.
    """
    facts = fixed(column_facts(df, settings=settings)) if facts is None else facts  # read by five parts
    guessed, candidates = None, []
    if target is None:
        listed = target_candidates(facts, settings=settings).collect()  # <= #columns rows
        candidates = [r["column"] for r in listed]
        guessed = next((r["column"] for r in listed if r["chosen"]), None)
    goal = guessed if target is None else (target if target in df.columns else None)
    parts = [identifier_signals(facts, goal, settings=settings),
             duplicate_column_signals(df, goal, settings=settings)]
    if goal is not None:
        parts += [target_correlation_signals(df, goal, settings=settings),
                  separation_signals(df, goal, settings=settings, facts=facts)]
    parts.append(outcome_name_signals(facts, goal))
    out = None
    for seq, part in enumerate(parts):
        part = part.withColumn("seq", F.lit(seq))
        out = part if out is None else out.unionByName(part)
    out = out.withColumn("rank", severity_rank(F.col("severity")))
    best = Window.partitionBy("column", "signal").orderBy(F.desc("rank"), "seq", "reasoning")
    signals = (out.withColumn("place", F.row_number().over(best)).where("place = 1")
               .select(*[c.split()[0] for c in SIGNAL_SCHEMA.split(", ")], "rank"))
    if target is None:
        text = (f"{guessed} was taken as the target because of its name (candidates: {', '.join(candidates[:5])})."
                if guessed else "No column is named like a target, so checks against a target were left out.")
        note = df.sparkSession.createDataFrame(
            [(guessed or "n/a", "target_selection", "info", text,
              "Name the target if the guess is wrong.", "n/a", None, -1)], SIGNAL_SCHEMA + ", rank int")
        signals = signals.unionByName(note)
    return signals.orderBy(F.desc("rank"), "column", "signal").drop("rank")
