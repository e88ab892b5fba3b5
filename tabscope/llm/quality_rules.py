"""Quality rules: base rules, then the distance of a document's distributions from its language's.

Each language has two reference histograms, of character classes and of common words, summed over all its
documents with enough words and at most a tenth of capitals, digits and symbols.  A document goes if the Jensen-Shannon distance (base 2, 0 to 1)
of one of its histograms from the reference exceeds a limit.  Documents too short for a stable histogram are
guarded: below ``min_chars`` characters or ``min_words`` words the comparison in question is not made.

Defined results: a null or empty text has no words, fails the base rules and is not kept; a null language is a
language of its own; rows are judged one by one, so ties and repeated rows get the same verdict; input columns
called as a result column are replaced; an empty table gives an empty result.  A language without such documents has no reference, and its documents are judged by the base rules alone.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabscope.functions.columns import col
from tabscope.llm.common import add_columns, as_bytes, others
from tabscope.plans.stored import stored

#: Frequent function words of the languages the references are made for.
COMMON_WORDS = tuple((
    "the of and to in a is that for it was on with as by at be this from or are not an which have "
    "de la le et les des est un une du que en dans qui pour par au sur pas avec ne se ce "
    "der die und das von mit den zu ist nicht ein eine auf für im dem des sich auch als "
    "el los las y del por con una para no es lo su al se más"
).split())
WORD_OF = {w.encode(): i for i, w in enumerate(dict.fromkeys(COMMON_WORDS))}
OTHER_WORD = len(WORD_OF)

#: Character classes: lower case, upper case, digits, white space, punctuation of sentences, other ASCII, beyond ASCII.
CLASSES, CONTINUATION = 7, 7
ODD = [1, 2, 5]
SENTENCE_MARKS = b".,;:!?'\"()-"


def _byte_classes() -> np.ndarray:
    table = np.full(256, 5, np.uint8)
    table[ord("a"):ord("z") + 1], table[ord("A"):ord("Z") + 1], table[ord("0"):ord("9") + 1] = 0, 1, 2
    table[[32, *range(9, 14)]] = 3
    table[list(SENTENCE_MARKS)] = 4
    table[0x80:0xC0], table[0xC0:] = CONTINUATION, 6
    return table


BYTE_CLASS = _byte_classes()
#: ASCII letters to lower case, other ASCII but digits to a blank: what common words are looked up in.
PLAIN = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
BLANKS = np.isin(np.arange(256), [32, *range(9, 14)])


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules; distances are Jensen-Shannon distances to base 2."""

    least_words: int = 50
    most_repeated: float = 0.5
    class_distance: float = 0.17
    word_distance: float = 0.45
    min_chars: int = 200
    min_words: int = 50
    reference_words: int = 50
    reference_odd: float = 0.1


def histograms(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Counts of characters by class, and of common words with all other words last."""
    classes = np.bincount(BYTE_CLASS[np.frombuffer(text, np.uint8)], minlength=CLASSES + 1)[:CLASSES]
    found = WORD_OF.get
    words = np.bincount(np.fromiter((found(w, OTHER_WORD) for w in text.translate(PLAIN).split()), np.int64), minlength=OTHER_WORD + 1)
    return classes, words


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, lines equal to an earlier one, words in repeated windows of three."""
    words = text.split()
    codes = np.frombuffer(text, np.uint8)
    chars = int(np.count_nonzero((codes & 0xC0) != 0x80)) - int(np.count_nonzero(BLANKS[codes]))
    symbols = int(np.count_nonzero(SYMBOLS[codes]))
    seen, repeated_lines = set(), 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            if line in seen:
                repeated_lines += 1
            seen.add(line)
    return len(words), chars, symbols, repeated_lines, repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of three that occurs twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    hot = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift:shift + len(hot)] |= hot
    return int(covered.sum())


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise Jensen-Shannon distance of counts; 0 where either row is empty."""
    p, q = p.astype(float), q.astype(float)
    ps, qs = p.sum(axis=1, keepdims=True), q.sum(axis=1, keepdims=True)
    usable = (ps[:, 0] > 0) & (qs[:, 0] > 0)
    p, q = p / np.where(ps > 0, ps, 1), q / np.where(qs > 0, qs, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.where(usable, np.sqrt(np.maximum(part.sum(axis=1) / 2, 0)), 0.0)


def references(df: DataFrame, text: str = "text", lang: str = "lang", rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per language: ``class_sum`` and ``word_sum``, over its documents of enough words and few odd characters."""
    least, odd = rules.reference_words, rules.reference_odd

    def sums(batches):
        total: dict[str | None, list[np.ndarray]] = {}
        for batch in batches:
            for language, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                classes, words = histograms(data)
                if words.sum() >= least and classes[ODD].sum() <= odd * classes.sum():
                    own = total.setdefault(language, [np.zeros(CLASSES, np.int64), np.zeros(OTHER_WORD + 1, np.int64)])
                    own[0] += classes
                    own[1] += words
            if len(total) > 1000:  # a table of very many languages is not gathered in memory
                yield _sums_batch(total)
                total = {}
        if total:
            yield _sums_batch(total)

    partial = df.select(col(lang).cast("string").alias("reference_lang"), col(text).alias("text")).mapInArrow(
        sums, "reference_lang string, class_sum array<bigint>, word_sum array<bigint>")

    def summed(name: str, n: int):
        return F.array(*[F.sum(col(name)[i]) for i in range(n)]).alias(name)

    return partial.groupBy("reference_lang").agg(summed("class_sum", CLASSES), summed("word_sum", OTHER_WORD + 1))


def _sums_batch(total: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.string()), pa.array([v[0].tolist() for v in total.values()], pa.list_(pa.int64())),
         pa.array([v[1].tolist() for v in total.values()], pa.list_(pa.int64()))], names=["reference_lang", "class_sum", "word_sum"])


RESULT = {
    "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
    "base_failed": "boolean", "class_distance": "double", "word_distance": "double", "kept": "boolean",
}


def _judged(df: DataFrame, text: str, lang: str, rules: QualityRules, names: dict[str, str]) -> DataFrame:
    """``df`` with results, ``names`` giving each wanted result the name of its column."""
    # stored, so that Spark knows their size: small references are broadcast, others joined by a shuffle
    known = stored(references(df, text, lang, rules), "references")
    own = df.select(*[col(c) for c in df.columns], col(lang).cast("string").alias("__lang"))
    joined = own.join(known, F.col("__lang").eqNullSafe(F.col("reference_lang")), "left").drop("__lang")

    def verdicts(texts, class_sums, word_sums):
        n = len(texts)
        counts = np.zeros((n, 5), np.int64)
        classes, words = np.zeros((n, CLASSES)), np.zeros((n, OTHER_WORD + 1))
        for i, data in enumerate(as_bytes(texts)):
            counts[i] = base_counts(data)
            classes[i], words[i] = histograms(data)
        of_class = np.array([v or [0] * CLASSES for v in class_sums.to_pylist()], float).reshape(n, CLASSES)
        of_word = np.array([v or [0] * (OTHER_WORD + 1) for v in word_sums.to_pylist()], float).reshape(n, OTHER_WORD + 1)
        by_class = np.where(classes.sum(axis=1) >= rules.min_chars, js_distance(classes, of_class), 0.0)
        by_word = np.where(words.sum(axis=1) >= rules.min_words, js_distance(words, of_word), 0.0)
        failed = (counts[:, 0] < rules.least_words) | (counts[:, 4] > rules.most_repeated * counts[:, 0])
        kept = ~failed & (by_class <= rules.class_distance) & (by_word <= rules.word_distance)
        made = dict(zip(RESULT, [*counts.T.copy(), failed, by_class, by_word, kept], strict=True))
        return [made[k] for k in names]

    added = ", ".join(f"{name} {RESULT[k]}" for k, name in names.items())
    inputs = (col(text), F.col("class_sum"), F.col("word_sum"))
    return add_columns(joined, added, verdicts, *inputs).select(*others(df, names.values()), *[F.col(n) for n in names.values()])


def judge(df: DataFrame, text: str = "text", lang: str = "lang", rules: QualityRules = QualityRules()) -> DataFrame:
    """Every row with its counts, distances and verdict ``kept``."""
    return _judged(df, text, lang, rules, {k: k for k in RESULT})


def keep_good(df: DataFrame, text: str = "text", lang: str = "lang", rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows that pass all rules, with their own columns."""
    return _judged(df, text, lang, rules, {"kept": "__kept"}).where("__kept").drop("__kept")
