"""Collocations by Misra-Gries summaries: phrases of a few words that stand together more often than their parts explain.

Texts are cut into pieces at sentence marks and line ends, pieces into words at blanks, and all runs of at most
``most_words`` words within a piece are counted per language.  Two passes over the texts find those that stand at least
``least`` times:

1. Every task hashes its n-grams, adds up equal ones and deals them by hash to partitions of bounded mass.  A partition
   merges what it gets in a Misra-Gries summary: counters, of which an equal amount is taken off all once there are more
   than ``capacity``, which exceeds the partition's mass divided by ``least``.  What was taken off in all stays below
   ``least`` (where one frequent n-gram makes a partition heavier, the capacity is doubled instead), so every n-gram of
   at least ``least`` occurrences survives.
2. Survivors become a table of bits of bounded size.  Tasks look the n-grams up there, and those that hit, false hits
   too, are counted by their words, by tasks and then by one aggregation; what stays below ``least`` goes.  Hashes decide
   nothing but what is counted: counts are exact.

With a = f(phrase), l and r the counts of its first k and its other words, a cut scores floor(1000000 a a / (l r)); the
lowest cut counts, of equal ones that of the smallest k.  A phrase contained in a longer candidate of at least
``share`` percent of its count is dropped; the longest of such chains are one word longer, since a phrase between has
at least the longer one's count.

Defined results: a null or empty text has no words; a null language is ``und``; equal rows count as often as they stand;
ties are ordered by count, then by the phrase's bytes, so ranks are the same on every run; very long texts are read in
slices cut at the end of a piece; a table without words gives an empty result; only the two named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from xxhash import xxh64_intdigest

from tabscope.functions.columns import col
from tabscope.llm.common import as_bytes, numbers, planes
from tabscope.plans.stored import stored

#: A-Z to lower case, ends of pieces to a line feed, tabs to a blank.
CUT, BLANK = 10, 32
PLAIN = bytes(CUT if b in b".,;:!?\x0a\x0b\x0c\x0d" else BLANK if b in b"\x20\x09" else b | 32 if 65 <= b <= 90 else b for b in range(256))
WORDS = r"[^\x20\x09.,;:!?\x0A-\x0D]+"
#: Bytes of text read, and n-grams added up in a task, at a time.
SLICE, BLOCK = 1 << 20, 1 << 22
#: Counted phrases that a task holds, at most.
HELD = 1 << 21
#: N-grams that a hash partition has on average, at most.
MASS = 1 << 22
#: Bits of the survivors' table for each of them, and at most; beyond that more false hits are counted and dropped.
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Odd multipliers of the hashes.
A, B, C, D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * A
    return (x ^ (x >> np.uint64(29))) * D


class Grams:
    """N-grams of a slice of texts: for each size the numbers of their first words and their hashes."""

    def __init__(self, plain: bytes, langs: np.ndarray, doc_of_cut: np.ndarray, most_words: int):
        """``langs``: a number of each document's language; ``doc_of_cut``: the document of each line feed of ``plain``."""
        codes = np.frombuffer(plain, np.uint8)
        inside = (codes != CUT) & (codes != BLANK)
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        self.codes, self.starts, self.ends = codes, edges[::2], edges[1::2]
        lengths = self.ends - self.starts
        self.sizes: list[tuple[np.ndarray, np.ndarray]] = []
        self.others: np.ndarray | None = None
        if not len(lengths):
            return
        piece = np.searchsorted(np.flatnonzero(codes == CUT), self.starts)
        self.doc = doc_of_cut[piece]
        heads = np.cumsum(lengths) - lengths
        with np.errstate(over="ignore"):
            place = (np.arange(lengths.sum()) - np.repeat(heads, lengths)).astype(np.uint64)
            own = (codes[inside].astype(np.uint64) + np.uint64(1)) * B
            own = (own ^ (own >> np.uint64(31))) * (place * A + C)
            words = _mixed(np.add.reduceat(own, heads) + langs[self.doc])
            first, value = np.arange(len(words)), words
            self.sizes.append((first, value))
            for size in range(1, most_words):
                whole = first + size < len(words)
                first, value = first[whole], value[whole]
                within = piece[first] == piece[first + size]
                first, value = first[within], value[within]
                value = _mixed(value * B + words[first + size] * C + np.uint64(size))
                self.sizes.append((first, value))

    def __len__(self) -> int:
        return len(self.sizes)

    def check(self, first: np.ndarray, size: int) -> np.ndarray:
        """Second hashes of n-grams, made of other hashes of their words."""
        if self.others is None:
            lengths = self.ends - self.starts
            heads = np.cumsum(lengths) - lengths
            inside = self.codes[(self.codes != CUT) & (self.codes != BLANK)].astype(np.uint64)
            place = (np.arange(len(inside)) - np.repeat(heads, lengths)).astype(np.uint64)
            with np.errstate(over="ignore"):
                self.others = np.add.reduceat(_mixed((place + A) * D ^ (inside + B) * C), heads)
        out = np.zeros(len(first), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                out = _mixed(out * C + self.others[first + k])
        return out

    def texts(self, first: np.ndarray, size: int) -> pa.Array:
        """Words of n-grams, joined by single blanks."""
        lengths = self.ends - self.starts + 1
        beyond = np.cumsum(lengths)
        joined = np.full(int(beyond[-1]) if len(beyond) else 0, BLANK, np.uint8)
        inside = np.ones(len(joined), bool)
        inside[beyond - 1] = False
        joined[inside] = self.codes[(self.codes != CUT) & (self.codes != BLANK)]
        begin, end = (beyond - lengths)[first], beyond[first + size - 1] - 1
        offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
        taken = np.repeat(begin - offsets[:-1], end - begin) + np.arange(offsets[-1])
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(joined[taken].tobytes()))


def slices(langs: list[str], texts: list[bytes], most_words: int) -> Iterator[tuple[Grams, list[str]]]:
    """N-grams of a batch of texts, some at a time: slices end where a piece ends."""
    plain = b"\n".join([*texts, b""]).translate(PLAIN)
    known = sorted(set(langs))
    code = {lang: i for i, lang in enumerate(known)}
    salt = np.array([xxh64_intdigest(lang.encode()) for lang in known], np.uint64)
    of_doc = np.array([code[lang] for lang in langs], np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    begin = 0
    while begin < len(plain):
        stop = plain.rfind(b"\n", begin, begin + SLICE) + 1 or plain.find(b"\n", begin + SLICE) + 1 or len(plain)
        part = plain[begin:stop]
        cuts = np.flatnonzero(np.frombuffer(part, np.uint8) == CUT) + begin
        docs = np.searchsorted(ends, cuts, side="right")
        found = Grams(part, salt[of_doc], docs, most_words)
        if len(found):
            yield found, langs
        begin = stop


def added(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes with the sums of their counts."""
    if not len(hashes):
        return hashes, counts
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    return hashes[heads], np.add.reduceat(counts[order], heads)


class Summary:
    """A Misra-Gries summary that is told weighted items and merges them when it holds twice its capacity."""

    def __init__(self, least: int, capacity: int):
        self.least, self.capacity, self.taken_off = least, capacity, 0
        self.items, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, items: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((items, counts))
        self.size += len(items)
        if self.size > self.capacity:
            self.merge()

    def merge(self) -> None:
        self.items, self.counts = added(np.concatenate([self.items, *[i for i, _ in self.waiting]]), np.concatenate([self.counts, *[c for _, c in self.waiting]]))
        self.waiting, self.size = [], 0
        while len(self.items) > self.capacity:
            off = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            if self.taken_off + off >= self.least:
                self.capacity *= 2
                continue
            self.taken_off += off
            left = self.counts > off
            self.items, self.counts = self.items[left], self.counts[left] - off

    def survivors(self) -> np.ndarray:
        """All items whose weight may be ``least``: a counter is too low by what was taken off, at most."""
        self.merge()
        return self.items[self.counts + self.taken_off >= self.least]


def _read(batches: Iterator[pa.RecordBatch], most_words: int) -> Iterator[tuple[Grams, list[str]]]:
    for batch in batches:
        rows = max(1, batch.num_rows * (4 << 20) // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield from slices(part.column(0).to_pylist(), as_bytes(part.column(1)), most_words)


def survivors(texts: DataFrame, least: int, most_words: int, partitions: int) -> DataFrame:
    """Hashes of all n-grams that may stand ``least`` times, by Misra-Gries summaries of hash partitions."""
    top = np.uint64(32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def dealt() -> pa.RecordBatch:
            hashes = np.sort(np.concatenate(held))
            heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            counts = np.diff(np.append(heads, len(hashes)))
            hashes = hashes[heads]
            parts = ((hashes >> top) * np.uint64(partitions)) >> top
            bounds = np.searchsorted(parts, np.arange(partitions + 1, dtype=np.uint64))
            own = [p for p in range(partitions) if bounds[p] < bounds[p + 1]]
            steps = [np.diff(hashes[bounds[p]:bounds[p + 1]], prepend=np.uint64(0)) for p in own]
            return pa.RecordBatch.from_arrays([
                pa.array(own, pa.int32()), pa.array([planes(s, 8) for s in steps], pa.binary()),
                pa.array([planes(counts[bounds[p]:bounds[p + 1]], 4) for p in own], pa.binary())], names=["part", "steps", "counts"])

        for found, _ in _read(batches, most_words):
            held += [value for _, value in found.sizes]
            size += sum(len(value) for _, value in found.sizes)
            if size >= BLOCK:
                yield dealt()
                held, size = [], 0
        if held:
            yield dealt()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(least, 2 * MASS // least + 1)
        for batch in batches:
            for steps, counts in zip(batch.column("steps"), batch.column("counts"), strict=True):
                with np.errstate(over="ignore"):
                    summary.add(np.cumsum(numbers(steps.as_py(), 8)), numbers(counts.as_py(), 4).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(summary.survivors().view(np.int64))], names=["gram"])

    dealt = texts.mapInArrow(deal, "part int, steps binary, counts binary")
    return dealt.groupBy("part").applyInArrow(summed, "gram bigint")


def bit_table(found: DataFrame) -> np.ndarray:
    """Bits of the survivors by the lowest bits of their hashes, as bytes; of a power of two, at most ``MOST_BITS``."""
    bits = min(MOST_BITS, max(1 << 15, 1 << math.ceil(math.log2(BITS_EACH * max(1, found.count())))))
    place = F.col("gram").bitwiseAND(F.lit(bits - 1)).alias("place")
    # Spark numbers buckets of bits from 1, by places from 1
    rows = found.select((place + 1).alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).toArrow()
    table = np.zeros(bits // 8, np.uint8)
    size = (1 << 15) // 8
    for bucket, own in zip(rows["bucket"].to_pylist(), rows["bits"].to_pylist(), strict=True):
        table[(bucket - 1) * size:bucket * size] = np.frombuffer(own, np.uint8)
    return table


def counted(texts: DataFrame, table: np.ndarray, least: int, most_words: int) -> DataFrame:
    """(lang, size, phrase, f): exact counts of all n-grams that stand at least ``least`` times."""
    sent = texts.sparkSession.sparkContext.broadcast(table)

    names = ["value", "other", "lang", "size", "phrase", "f"]

    def heads_of(value: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Where runs of one n-gram begin; two that share a hash may give several runs, which the aggregation adds up."""
        new = (value[1:] != value[:-1]) | (other[1:] != other[:-1])
        return np.flatnonzero(np.concatenate([np.ones(min(1, len(value)), bool), new]))

    def together(held: list[pa.Table]) -> pa.Table:
        """Rows of the same n-gram as one."""
        table = pa.concat_tables(held)
        value, other, counts = (table[name].to_numpy() for name in ("value", "other", "f"))
        order = np.argsort(value, kind="stable")
        value, other = value[order], other[order]
        heads = heads_of(value, other)
        sums = np.add.reduceat(counts[order], heads) if len(heads) else counts
        return table.take(pa.array(order[heads])).set_column(5, "f", pa.array(sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        mask = np.uint64(8 * len(bits) - 1)
        held: list[pa.Table] = []
        rows = 0
        for found, langs in _read(batches, most_words):
            of_doc = pa.array(langs, pa.string())
            for size, (first, value) in enumerate(found.sizes, 1):
                place = (value & mask).astype(np.int64)
                hit = np.flatnonzero((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                hit = hit[np.argsort(value[hit], kind="stable")]
                first, value = first[hit], value[hit]
                other = found.check(first, size)
                heads = heads_of(value, other)
                counts = np.diff(np.append(heads, len(value)))
                first, value, other = first[heads], value[heads], other[heads]
                held.append(pa.table([pa.array(value), pa.array(other), of_doc.take(pa.array(found.doc[first])), pa.array(np.full(len(first), size, np.int32)),
                                      found.texts(first, size), pa.array(counts.astype(np.int64))], names=names))
                rows += len(first)
            if rows >= HELD:
                held = [together(held)]
                rows = held[0].num_rows
                if rows >= HELD // 2:
                    yield from held[0].drop_columns(names[:2]).to_batches()
                    held, rows = [], 0
        if held:
            yield from together(held).drop_columns(names[:2]).to_batches()

    made = texts.mapInArrow(run, "lang string, size int, phrase string, f bigint")
    return made.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def scored(counts: DataFrame, most_words: int, share: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all phrases of two words or more that no longer one takes in."""
    phrases = counts.where("size > 1").withColumn("words", F.split("phrase", " "))

    def words(first, n):
        return F.array_join(F.slice("words", first, n), " ")

    # the part of one word less that a longer phrase begins or ends with
    inner = phrases.where("size > 2").select("lang", "f", F.explode(F.array(words(F.lit(1), F.col("size") - 1), words(F.lit(2), F.col("size") - 1))).alias("inside"))
    around = inner.groupBy("lang", "inside").agg(F.max("f").alias("most")).withColumnRenamed("lang", "of_lang")
    kept = phrases.join(around, (F.col("lang") == F.col("of_lang")) & (F.col("phrase") == F.col("inside")), "left").where(
        F.coalesce(100 * F.col("most") < share * F.col("f"), F.lit(True))).select("lang", "phrase", "words", "size", F.col("f").alias("a"))
    cut = kept.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", words(F.lit(1), F.col("k")).alias("left"), words(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    part = counts.where(F.col("size") < most_words)
    for side, name in (("left", "l"), ("right", "r")):
        own = part.select(F.col("lang").alias("of_lang"), F.col("phrase").alias("of"), F.col("f").alias(name))
        cut = cut.join(own, (F.col("lang") == F.col("of_lang")) & (F.col(side) == F.col("of"))).drop("of_lang", "of")

    def exact(name):
        return F.col(name).cast("decimal(16,0)")

    # of 33 and, with the factor, 38 digits at most
    products = cut.withColumn("above", exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("below", exact("l") * exact("r"))
    score = products.withColumn("score", F.expr("above div below"))
    least = score.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return least.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` phrases of each language with their rank, chosen in parts first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parted = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = parted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranks = few.drop("part", "place").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranks.where(F.col("rank") <= top)


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", most_words: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` phrases of each language."""
    texts = df.select(F.coalesce(col(lang).cast("string"), F.lit("und")).alias("lang"), col(text).alias("text")).where(col("text").isNotNull())
    totals = stored(texts.groupBy("lang").agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(WORDS)).cast("bigint")), F.lit(0)).alias("n")), "words")
    n = totals.agg(F.sum("n")).first()[0] or 0
    partitions = max(1, math.ceil(most_words * n / MASS))
    found = stored(survivors(texts, least, most_words, partitions), "survivors")
    counts = stored(counted(texts, bit_table(found), least, most_words), "phrase-counts")
    best = ranked(scored(counts, most_words, share), top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

