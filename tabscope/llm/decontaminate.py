"""Benchmark decontamination by a broadcast set of the benchmark's word windows.

Words are runs of digits, letters and characters beyond ASCII, A-Z taken as lower case.  A window is ``size``
consecutive words of an item; an item of fewer words, but not none, is one window of its own length.  All windows
are held by a hash of their words; every position of a document is looked up by the same hash, and each hit is
verified word by word.  The words inside any occurrence of a window are hit.

The benchmark goes to every task, after a check of its size: beyond ``max_bytes`` of text it is split by hash into
parts of about that size, each scanned for in a pass of its own that adds to the hits of the passes before.

Defined results: a null or empty text has no words, neither as document nor as item; items of one id count as one
item, a null item id is written as an empty string; documents are scanned one by one, so ties and repeated rows get
the same result; input columns called as a result column are replaced; empty tables give empty or clean results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabscope.functions.columns import col
from tabscope.llm.common import add_columns, as_bytes

SIZE = 10
MAX_BYTES = 32 << 20
#: A-Z to lower case; ASCII that is neither letter nor digit to a blank.
WORDS = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive numbers; windows that hold a 0 (an unknown word) get hash 0."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ ids[k:k + n]) * MULTIPLIER
        out ^= out >> np.uint64(29)
    unknown = np.concatenate([[0], np.cumsum(ids == 0)])
    return np.where(unknown[size:] == unknown[:-size], out | np.uint64(1), np.uint64(0))


@dataclass(frozen=True)
class Windows:
    """The windows of a benchmark: numbers of its words and, by length, sorted hashes with the windows of each."""

    numbers: dict[bytes, int]
    by_length: dict[int, tuple[np.ndarray, list[dict[bytes, list[str]]]]]

    @staticmethod
    def of(items: list[tuple[str, bytes]], size: int) -> Windows:
        numbers: dict[bytes, int] = {}
        windows: dict[int, dict[int, dict[bytes, set[str]]]] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.uint64)
            length = min(size, len(ids))
            held = windows.setdefault(length, {})
            for at, key in enumerate(window_hashes(ids, length).tolist()):
                held.setdefault(key, {}).setdefault(ids[at:at + length].tobytes(), set()).add(item)
        by_length = {}
        for length, held in windows.items():
            keys = sorted(held)
            by_length[length] = (np.array(keys, np.uint64), [{w: sorted(i) for w, i in held[k].items()} for k in keys])
        return Windows(numbers, by_length)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit spans of words (first, beyond; apart and in order), and items found."""
        words = words_of(text)
        number = self.numbers.get
        ids = np.fromiter((number(w, 0) for w in words), np.uint64, len(words))
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        for length, (keys, windows) in self.by_length.items():
            hashes = window_hashes(ids, length)
            at = np.flatnonzero(hashes)
            place = np.searchsorted(keys, hashes[at])
            place[place == len(keys)] = 0
            hit = keys[place] == hashes[at] if len(at) else np.zeros(0, bool)
            for start, k in zip(at[hit].tolist(), place[hit].tolist(), strict=True):
                of = windows[k].get(ids[start:start + length].tobytes())  # the words themselves, whatever the hash says
                if of:
                    found.append((start, start + length))
                    items.update(of)
        return len(words), merged(found), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes from the first to the last word of each span of words."""
    plain = np.frombuffer(text.translate(WORDS), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.r_[False, plain, False].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    out, done = [], 0
    for first, beyond in spans:
        out.append(text[done:starts[first]])
        done = ends[beyond - 1]
    return b"".join([*out, text[done:]])


def _parts(benchmark: DataFrame, item: str, text: str, max_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark's items, in parts of some ``max_bytes`` of text."""
    rows = benchmark.select(F.coalesce(col(item).cast("string"), F.lit("")).alias("item"), col(text).cast("binary").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / max_bytes))
    for part in range(n):
        own = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == part) if n > 1 else rows
        yield [(r["item"], bytes(r["text"])) for r in own.collect()]


def _scanned(df: DataFrame, text: str, windows: Windows, again: bool) -> DataFrame:
    """``df`` with what ``windows`` find in its texts, added to what an earlier part has found."""
    shared = df.sparkSession.sparkContext.broadcast(windows)

    def run(texts, *before):
        known = [x.to_pylist() for x in before] or [[[]] * len(texts)] * 2
        counts, spans, items = [], [], []
        for data, old_spans, old_items in zip(as_bytes(texts), *known, strict=True):
            n, found, own = shared.value.scan(data)
            counts.append(n)
            spans.append([{"first": a, "beyond": b} for a, b in merged([*found, *((x["first"], x["beyond"]) for x in old_spans)])])
            items.append(sorted(own.union(old_items)))
        span = pa.list_(pa.struct([("first", pa.int64()), ("beyond", pa.int64())]))
        return [pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))]

    before = [F.col("hit_spans"), F.col("items")] if again else []
    return add_columns(df, "n_words bigint, hit_spans array<struct<first: bigint, beyond: bigint>>, items array<string>", run, col(text), *before)


def scan(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = SIZE,
         max_bytes: int = MAX_BYTES) -> DataFrame:
    """``df`` with n_words, hit_spans (word numbers: first, beyond; apart and in order) and items (sorted ids found)."""
    out = df
    for part, rows in enumerate(_parts(benchmark, item, item_text, max_bytes)):
        out = _scanned(out, text, Windows.of(rows, size), again=part > 0)
    return out


def without_documents(df: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` in which no window occurs."""
    kept = df.select(F.struct(*[col(c) for c in df.columns]).alias("own"), col(text).alias("text"))
    return scan(kept, benchmark, "text", **options).where(F.size("hit_spans") == 0).select("own.*")


def without_passages(df: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``df`` with the hit spans cut out of its texts, from the first to the last word of each."""
    def cut(texts, spans):
        clean = [without_spans(t, [(x["first"], x["beyond"]) for x in s]) if s else t for t, s in zip(texts.cast(pa.binary()).to_pylist(), spans.to_pylist(), strict=True)]
        return [pa.array(clean, pa.binary()).cast(pa.string())]

    kept = df.select(F.struct(*[col(c) for c in df.columns]).alias("own"), col(text).alias("text"))
    cleaned = add_columns(scan(kept, benchmark, "text", **options), "clean string", cut, col("text"), F.col("hit_spans"))
    return cleaned.select(*[(F.col("clean") if c == text else F.col("own")[c]).alias(c) for c in df.columns])
