"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary texts.

The models' expressions are whole words of lower-cased letters and digits, pairs of words that follow each other, two and
three characters in a row of each run of characters beyond ASCII (texts without blanks are one long word), and the
beginnings of words, 4 to 8 bytes, so that inflected and compound words share counts.  For each kind, a class's
probability of an expression is its count in the class less a discount, and the discounted mass goes to expressions by
continuation counts, which both classes share: in how many ways a beginning goes on, or after how many words a word
stands; a pair backs off to its second word.  An expression whose counts differ between the classes by
less than ``least_z`` standard deviations of chance is rare or indifferent: it is left to the shared counts in both, so it
speaks for neither.  A text's value is the sum of the log-likelihood ratios of its expressions, divided by its words; a
logistic curve turns it into a score.

Counts are taken from all labelled texts of the folds for counting, by partial sums per task and one aggregation; the
curve is fitted on at most ``MOST_FITTED`` labelled texts of one other fold, chosen by hash.  The expressions that
speak for a class go to every task, in parts of at most ``MOST_SENT`` whose sums are added up.

Defined results: null and empty texts have value 0 and get the curve's score there; rows of one id with several labels
count as toxic if one says so, null labels and null ids do not count; without toxic (ordinary) labels every score is
0 (1), without any it is 0; rows are scored one by one; input columns called as a result column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabscope.functions.columns import col
from tabscope.llm.common import add_columns, as_bytes, numbers, planes, replaced
from tabscope.plans.stored import stored

DISCOUNT = 0.75
MOST_FITTED = 20_000
MOST_SENT = 2_000_000
#: Bytes of labelled text whose expressions a hash partition holds on average.
PART_TEXT = 4 << 20
#: Labels (8 bytes of id, a flag) up to this number are broadcast to the texts, more are joined by a shuffle.
MOST_LABELS = 1_000_000
#: A-Z to lower case; ASCII that is neither letter nor digit to a blank.
PLAIN = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


SIZES = (4, 5, 6, 7, 8)
#: The first bytes of a number of eight, the first byte highest.
MASKS = {k: np.uint64(((1 << 64) - 1) ^ ((1 << (8 * (8 - k))) - 1)) for k in (3, *SIZES)}


def expressions(text: bytes) -> tuple[np.ndarray, int]:
    """The beginnings of all words, packed into numbers (zeros after the last byte), and the number of words."""
    plain = np.frombuffer(text.translate(PLAIN) + bytes(8), np.uint8)
    inside = plain[:-7] > 32
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.int64), 0
    packed = np.zeros(len(starts), np.uint64)
    for k in range(8):
        packed = (packed << np.uint64(8)) | np.where(lengths > k, plain[starts + k], 0).astype(np.uint64)
    return np.concatenate([packed[lengths >= k] & MASKS[k] for k in SIZES]).view(np.int64), len(starts)


#: Kinds of expressions, in the lowest bits of their hashes; beginnings have their length.
WORD, PAIR, TWO, THREE = 1, 2, 9, 10
KINDS = (WORD, PAIR, *SIZES, TWO, THREE)
#: Odd multipliers of the hashes.
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _gram(values: np.ndarray, kind: int) -> np.ndarray:
    """Hashes with the kind in the lowest four bits."""
    mixed = (values ^ (values >> np.uint64(31))) * A
    return ((mixed ^ (mixed >> np.uint64(29))) & ~np.uint64(15)) | np.uint64(kind)


def grams(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of the expressions of a text, those of the shorter ones they go on from (0 if none), and the number of words."""
    plain = np.frombuffer(text.translate(PLAIN) + b" ", np.uint8)
    inside = plain > 32
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    with np.errstate(over="ignore"):
        begins, _ = expressions(text)
        packed = begins.view(np.uint64)
        lengths = ends - starts
        sizes = np.repeat(np.array(SIZES), [int((lengths >= k).sum()) for k in SIZES])
        shorter = packed & np.array([MASKS.get(k - 1, 0) for k in range(SIZES[-1] + 1)], np.uint64)[sizes]
        every = [(_gram(packed * B, 0) | sizes.astype(np.uint64),
                  np.where(sizes > SIZES[0], _gram(shorter * B, 0) | (sizes - 1).astype(np.uint64), np.uint64(0)))]
        # a word's bytes, each weighed by its place
        places = _places(starts, ends, len(plain))
        own = (plain.astype(np.uint64) + np.uint64(1)) * B
        own = (own ^ (own >> np.uint64(31))) * (places.astype(np.uint64) * A + C)
        own[~inside] = 0
        words = _gram(np.add.reduceat(own, starts), WORD)
        every.append((words, np.zeros(len(words), np.uint64)))
        every.append((_gram(words[:-1] * B + words[1:] * C, PAIR), words[1:]))
        every += _characters(plain)
    return np.concatenate([g for g, _ in every]).view(np.int64), np.concatenate([o for _, o in every]).view(np.int64), len(starts)


def _places(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """The place of each byte in its word, 0 outside of words."""
    out = np.zeros(n, np.int64)
    lengths = ends - starts
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(len(first)) - first
    out[np.repeat(starts, lengths) + place] = place
    return out


def _characters(plain: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two and three characters in a row of each run of characters beyond ASCII."""
    heads = np.flatnonzero(plain >= 0xC0)
    if len(heads) < 2:
        return []
    wide = np.flatnonzero(plain >= 128)
    upto = np.searchsorted(wide, heads)
    beyond = np.append(heads[1:], wide[-1] + 1)
    inside = np.diff(np.append(upto, len(wide)))  # bytes from this head to the next
    joined = beyond - heads == inside  # the next character follows at once
    joined[-1] = False
    bits = plain.astype(np.uint64)
    value = np.zeros(len(heads), np.uint64)
    for k in range(4):
        at = np.minimum(heads + k, len(plain) - 1)
        value = (value << np.uint64(8)) | np.where(k < inside, bits[at], np.uint64(0))
    two = _gram(value[:-1] * B + value[1:] * C, TWO)
    first = joined[:-1]
    found = [(two[first], np.zeros(int(first.sum()), np.uint64))]
    if len(heads) > 2:
        both = first[:-1] & first[1:]
        found.append((_gram((two[:-1] * B + value[2:] * C)[both], THREE), two[:-1][both]))
    return found


def labelled(df: DataFrame, labels: DataFrame, doc: str, text: str, folds: int) -> DataFrame:
    """(text, toxic, fold, pick) of the labelled rows outside of fold 0."""
    own = labels.where(col("toxic").isNotNull() & col(doc).isNotNull()).groupBy(col(doc).alias("label_of")).agg((F.max("toxic") > 0).alias("toxic"))
    rows = df.select(col(doc).alias("doc"), col(text).alias("text"), fold_of(col(doc), folds).alias("fold")).where("fold != 0")
    few = own.limit(MOST_LABELS + 1).count() <= MOST_LABELS
    return rows.join(F.broadcast(own) if few else own, F.col("doc") == F.col("label_of")).select(
        "text", "toxic", "fold", F.xxhash64("doc").alias("pick"))


def fold_of(doc: Column, folds: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def counted(rows: DataFrame, partitions: int) -> DataFrame:
    """(gram, of_gram, toxic, ordinary): how often each expression stands in texts of either kind, and what it goes on from.

    Tasks add up what they meet and deal it by hash to ``partitions``, as sorted numbers of which the differences are sent.
    """
    held_most, new_most = 1 << 22, 1 << 21
    top = np.uint64(32)

    def summed(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        """Distinct expressions in order, with sums of their counts; a column at a time, to hold little twice."""
        gram = np.concatenate([x[0] for x in found])
        order = np.argsort(gram, kind="stable")
        gram = gram[order]
        heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(gram)), bool), gram[1:] != gram[:-1]]))
        gram = gram[heads]
        shorter = np.concatenate([x[1] for x in found])[order[heads]]
        counts = [np.add.reduceat(np.concatenate([x[k] for x in found])[order], heads) if len(heads) else np.zeros(0, np.int64) for k in (2, 3)]
        return gram, shorter, *counts

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, distinct = [], 0, 0

        def dealt() -> pa.RecordBatch:
            gram, shorter, toxic, ordinary = summed(held)
            parts = ((gram >> top) * np.uint64(partitions)) >> top
            bounds = np.searchsorted(parts, np.arange(partitions + 1, dtype=np.uint64))
            own = [p for p in range(partitions) if bounds[p] < bounds[p + 1]]
            spans = [slice(bounds[p], bounds[p + 1]) for p in own]
            columns = [[planes(np.diff(gram[x], prepend=np.uint64(0)), 8) for x in spans], [shorter[x].tobytes() for x in spans],
                       [planes(toxic[x], 4) for x in spans], [planes(ordinary[x], 4) for x in spans]]
            return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *[pa.array(c, pa.binary()) for c in columns]],
                                              names=["part", "steps", "shorter", "toxic", "ordinary"])

        for batch in batches:
            for text, toxic in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                own, shorter, _ = grams(text)
                kind = np.full(len(own), int(bool(toxic)), np.int32)
                held.append((own.view(np.uint64), shorter, kind, 1 - kind))
                size += len(own)
                if size - distinct >= new_most:
                    held = [summed(held)]
                    size = distinct = len(held[0][0])
                    if distinct >= held_most:
                        yield dealt()
                        held, size, distinct = [], 0, 0
        if size:
            yield dealt()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            for steps, shorter, toxic, ordinary in zip(*[batch.column(c) for c in ("steps", "shorter", "toxic", "ordinary")], strict=True):
                with np.errstate(over="ignore"):
                    found.append((np.cumsum(numbers(steps.as_py(), 8)), np.frombuffer(shorter.as_py(), np.int64),
                                  *(numbers(x.as_py(), 4).astype(np.int64) for x in (toxic, ordinary))))
        gram, *others = summed(found)
        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), *[pa.array(x) for x in others]], names=["gram", "of_gram", "toxic", "ordinary"])

    dealt_out = rows.select("text", "toxic").mapInArrow(deal, "part int, steps binary, shorter binary, toxic binary, ordinary binary")
    return dealt_out.groupBy("part").applyInArrow(merged, "gram bigint, of_gram bigint, toxic bigint, ordinary bigint")


def weights(counts: DataFrame, least_z: float) -> DataFrame:
    """(gram, weight): log of the ratio of both models' probabilities of the expressions that speak for a class."""
    kinds = ("toxic", "ordinary")
    sized = counts.withColumn("size", F.col("gram").bitwiseAND(F.lit(15)))
    # in how many ways an expression goes on, besides by its end
    ways = stored(sized.where("of_gram <> 0").groupBy(F.col("of_gram").alias("from_gram")).agg(F.count("*").alias("more")), "continuations")
    totals = sized.groupBy("size").agg(F.count("*").alias("n"), *[
        x for kind in kinds for x in (F.sum(kind).alias(kind), F.sum(F.least(col(kind), F.lit(DISCOUNT))).alias(f"{kind}_mass"))]).collect()
    goes_on = {r["size"]: r for r in ways.groupBy(F.col("from_gram").bitwiseAND(F.lit(15)).alias("size")).agg(
        F.sum("more").alias("more"), F.sum(F.col("more") * (F.col("more") + 1)).alias("pairs")).collect()}
    chosen, weight = F.lit(False), F.lit(None).cast("double")
    for total in totals:  # one row for each kind
        if not (total["toxic"] and total["ordinary"]):
            continue
        kind_of = F.col("size") == total["size"]
        # the ways of all expressions of the kind; every pair has those of its second word
        every = goes_on[WORD]["pairs"] if total["size"] == PAIR else total["n"] + (goes_on[total["size"]]["more"] if total["size"] in goes_on else 0)
        shared = (F.coalesce("more", F.lit(0)) + 1) / every
        chance = [(F.greatest(col(kind) - DISCOUNT, F.lit(0.0)) + total[f"{kind}_mass"] * shared) / total[kind] for kind in kinds]
        expected = (F.col("toxic") + F.col("ordinary")) * (total["toxic"] / (total["toxic"] + total["ordinary"]))
        speaks = F.abs(F.col("toxic") - expected) >= least_z * F.sqrt(F.greatest(expected, F.lit(0.5)))
        chosen, weight = chosen | (kind_of & speaks), F.when(kind_of, F.log(chance[0] / chance[1])).otherwise(weight)
    base = F.when(F.col("size") == PAIR, F.col("of_gram")).otherwise(F.col("gram"))
    speaking = stored(sized.where(chosen).withColumn("base", base), "expressions")
    return speaking.join(ways, F.col("base") == F.col("from_gram"), "left").select("gram", weight.alias("weight"))


def with_value(df: DataFrame, text: str, found: DataFrame, name: str) -> DataFrame:
    """``df`` with the weight of its texts' expressions per word."""
    parts = max(1, math.ceil(found.count() / MOST_SENT))
    context = df.sparkSession.sparkContext
    out = df.withColumn(name, F.lit(0.0))
    for part in range(parts):
        own = found.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == part).orderBy("gram").toArrow()
        sent = context.broadcast((own["gram"].to_numpy(), own["weight"].to_numpy()))

        def run(texts, before, sent=sent):
            known, weight = sent.value
            values = before.to_numpy(zero_copy_only=False).copy()
            for i, data in enumerate(as_bytes(texts)):
                own, _, n = grams(data)
                if len(own) and len(known):
                    at = np.searchsorted(known, own)
                    at[at == len(known)] = 0
                    values[i] += weight[at[known[at] == own]].sum() / n
            return [values]

        out = add_columns(out, f"`{name}` double", run, col(text), col(name))
    return out


@dataclass(frozen=True)
class Curve:
    slope: float
    base: float

    @staticmethod
    def of(values: np.ndarray, toxic: np.ndarray) -> Curve:
        """Logistic regression of one value, with a slight pull to 0, by Newton steps."""
        if not len(toxic) or toxic.all() or not toxic.any():
            return Curve(0.0, math.inf if len(toxic) and toxic.all() else -math.inf)
        scale = values.std() or 1.0
        x = np.stack([values / scale, np.ones(len(values))], axis=1)
        w = np.zeros(2)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (toxic - p) - 1e-3 * w)
            w += np.clip(step, -5, 5)
        return Curve(float(w[0] / scale), float(w[1]))

    def score(self, value: Column) -> Column:
        if math.isinf(self.base):
            return F.lit(1.0 if self.base > 0 else 0.0)
        return 1 / (1 + F.exp(-(value * self.slope + self.base)))


def scored(df: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", least_z: float = 5.0, folds: int = 5) -> DataFrame:
    """``df`` with held_out (the row is in fold 0), score and predicted; labels: ``doc`` and ``toxic``."""
    rows = labelled(df, labels, doc, text, folds)
    learnt = rows.where(F.col("fold") < folds - 1)
    size = learnt.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    partitions = max(1, math.ceil(size / PART_TEXT))
    found = stored(weights(stored(counted(learnt, partitions), "expression-counts"), least_z), "expression-weights")
    fitted = with_value(rows.where(F.col("fold") == folds - 1), "text", found, "value")
    sample = fitted.select("pick", "value", "toxic").orderBy("pick", "value").limit(MOST_FITTED).toArrow()  # numbers alone are sorted
    curve = Curve.of(sample["value"].to_numpy(), sample["toxic"].to_numpy(zero_copy_only=False).astype(bool))
    held = replaced(df, held_out=fold_of(col(doc), folds) == 0)
    valued = with_value(held, text, found, "score")
    return replaced(valued, score=curve.score(F.col("score"))).transform(
        lambda made: replaced(made, predicted=(F.col("score") >= 0.5).cast("int")))
