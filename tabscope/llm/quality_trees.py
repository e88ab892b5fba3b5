"""Quality of documents by histogram gradient-boosted trees over document statistics.

A document becomes ``FEATURES``: lengths, shares of kinds of characters, entropy of its bytes, and how words, pairs of
words and lines repeat.  Trees are fitted to the logistic loss of labelled rows outside of fold 0: features are cut at
quantiles into ``BINS`` bins, each level of a tree is chosen from histograms of first and second derivatives by node,
feature and bin.  All trees have the same depth and are flattened into arrays (feature, threshold, leaf value); a batch
of documents goes down all trees at once, a level at a time, by indexing.

At most ``MOST_FITTED`` labelled rows, chosen by a hash of their ids, are fitted on; only their statistics reach the
driver.  Every row is scored, from its own whole text alone.

Defined results: null and empty texts have statistics of zeros and the score these get; rows of one id with several
labels count as good if all say so, null labels and null ids do not count; with labels of one class alone, scores are
that class's smoothed share, without any they are 0.5; equal texts get equal scores; input columns called as a result
column are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabscope.functions.columns import col
from tabscope.llm.common import add_columns, as_bytes, replaced
from tabscope.llm.toxicity import fold_of

MOST_FITTED = 40_000
BINS = 64

#: Groups of bytes counted for each document.
GROUPS = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digits": bytes(range(48, 58)), "blanks": b" \t\x0b\x0c\r",
    "lines": b"\n", "stops": b".", "commas": b",;:", "shouts": b"!?", "quotes": b"'\"()-", "bars": b"|", "signs": b"#*$%&<>",
    "codes": b"{}[]\\/=+_~^`@", "beyond": bytes(range(0xC0, 256)),
}
FEATURES = (
    "log_chars", "log_words", "word_length", "longest_word", "short_words", "entropy", "distinct_words", "distinct_pairs", "distinct_lines",
    "line_words", "capital_words", *(f"{g}_share" for g in GROUPS), "stops_a_word", "shouts_a_word", "signs_a_word", "upper_of_letters",
)
_GROUP = np.array([[b in own for b in range(256)] for own in GROUPS.values()], float)


def statistics(text: bytes) -> np.ndarray:
    """The features of a text."""
    if not text.strip():
        return np.zeros(len(FEATURES))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = counts.sum() - counts[0x80:0xC0].sum()
    grouped = dict(zip(GROUPS, _GROUP @ counts, strict=True))
    words = text.split()
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [line for line in text.split(b"\n") if line.strip()]
    p = counts[counts > 0] / counts.sum()
    pairs = set(zip(words, words[1:], strict=False))
    capital = sum(1 for w in words if 65 <= w[0] <= 90)
    letters = grouped["upper"] + grouped["lower"]
    return np.array([
        np.log1p(chars), np.log1p(n), lengths.mean(), np.log1p(lengths.max()), (lengths <= 3).mean(), -(p * np.log2(p)).sum(),
        len(set(words)) / n, len(pairs) / max(1, n - 1), len(set(lines)) / len(lines), np.log1p(n / len(lines)), capital / n, *(grouped[g] / chars for g in GROUPS),
        grouped["stops"] / n, grouped["shouts"] / n, grouped["signs"] / n, grouped["upper"] / max(1.0, letters)])


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: node i of a level has the children 2i and 2i + 1 of the next."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # rows above it go right
    leaf: np.ndarray  # trees x leaves

    def value(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of rows of features."""
        n_trees, n_inner = self.feature.shape
        if not n_trees:
            return np.full(len(x), self.base)
        node = np.zeros((len(x), n_trees), np.int64)
        tree, row = np.arange(n_trees), np.arange(len(x))[:, None]
        for _ in range((n_inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return self.base + self.leaf[tree, node - n_inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.value(x), -700, 700)))


def bin_edges(x: np.ndarray) -> list[np.ndarray]:
    """Thresholds of each feature: midpoints between neighbouring distinct values at quantiles, at most ``BINS`` - 1."""
    edges = []
    for own in x.T:
        values = np.unique(own)
        if len(values) > BINS:
            values = np.unique(np.quantile(own, np.linspace(0, 1, BINS), method="nearest"))
        edges.append((values[1:] + values[:-1]) / 2)
    return edges


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 4, rate: float = 0.15, pull: float = 1.0, least: float = 1.0) -> Trees:
    """Trees of the logistic loss of labels ``y`` (0 or 1); ``pull`` shrinks leaves, ``least`` is a child's second derivative at least."""
    n_inner, n_features = (1 << depth) - 1, x.shape[1]
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, n_inner), np.int64), np.zeros((0, n_inner)), np.zeros((0, n_inner + 1)))
    edges = bin_edges(x)
    binned = np.stack([np.searchsorted(e, own, side="left") for e, own in zip(edges, x.T, strict=True)], axis=1)
    cells = binned + np.arange(n_features) * BINS
    value = np.full(len(y), base)
    features, thresholds, leaves = [], [], []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-value))
        slope, curve = p - y, np.maximum(p * (1 - p), 1e-12)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(n_inner, np.int64), np.full(n_inner, np.inf)
        for level in range(depth):
            size = 1 << level
            at = (cells + (node * n_features * BINS)[:, None]).ravel()
            shape = (size, n_features, BINS)
            g, h = (np.bincount(at, np.repeat(w, n_features), int(np.prod(shape))).reshape(shape).cumsum(axis=2) for w in (slope, curve))
            whole_g, whole_h = g[:, :, -1:], h[:, :, -1:]
            gain = g * g / (h + pull) + (whole_g - g) ** 2 / (whole_h - h + pull) - whole_g ** 2 / (whole_h + pull)
            gain[(h < least) | (whole_h - h < least)] = 0
            gain = gain.reshape(size, -1)
            best = gain.argmax(axis=1)
            splits = gain[np.arange(size), best] > 1e-9
            own, cut = best // BINS, best % BINS
            for i in np.flatnonzero(splits):
                feature[size - 1 + i], threshold[size - 1 + i] = own[i], edges[own[i]][cut[i]]
            right = splits[node] & (binned[np.arange(len(y)), own[node]] > cut[node])
            node = 2 * node + right
        sums = [np.bincount(node, w, n_inner + 1) for w in (slope, curve)]
        leaf = -rate * sums[0] / (sums[1] + pull)
        value = value + leaf[node]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(base, np.array(features), np.array(thresholds), np.array(leaves))


def labelled_statistics(df: DataFrame, labels: DataFrame, doc: str, text: str, label: str, folds: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``MOST_FITTED`` labelled rows outside of fold 0."""
    marked = labels.where(col(label).isNotNull() & col(doc).isNotNull()).groupBy(col(doc).alias("label_of")).agg((F.min(label) > 0).cast("int").alias("good"))
    own = marked.where(fold_of(F.col("label_of"), folds) != 0).join(df.select(col(doc).alias("doc")), F.col("doc") == F.col("label_of"), "left_semi")
    few = own.select("label_of", "good", F.xxhash64("label_of").alias("pick")).orderBy("pick", "label_of").limit(MOST_FITTED)
    rows = df.select(col(doc).alias("doc"), col(text).alias("text")).join(F.broadcast(few), F.col("doc") == F.col("label_of")).select("pick", "good", "text")
    made = add_columns(rows, "features array<double>", _features, F.col("text")).drop("text")
    # ids that stand often may bring more rows
    found = made.orderBy("pick", "features").limit(MOST_FITTED).toArrow()
    x = np.array(found["features"].to_pylist(), float).reshape(-1, len(FEATURES))
    return x, found["good"].to_numpy().astype(float)


def _features(texts: pa.Array) -> list[pa.Array]:
    rows = [statistics(t) for t in as_bytes(texts)]
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return [pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(FEATURES), pa.int32()), pa.array(flat))]


def scored(df: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, least_score: float = 0.3) -> DataFrame:
    """``df`` with held_out (the row is in fold 0), score and predicted; labels: ``doc`` and ``label``."""
    sent = df.sparkSession.sparkContext.broadcast(fit(*labelled_statistics(df, labels, doc, text, label, folds)))

    def run(texts: pa.Array) -> list[np.ndarray]:
        rows = [statistics(t) for t in as_bytes(texts)]
        return [sent.value.score(np.array(rows).reshape(-1, len(FEATURES)))]

    held = replaced(df, held_out=fold_of(col(doc), folds) == 0)
    made = add_columns(held, "score double", run, col(text))
    return replaced(made, predicted=(F.col("score") >= least_score).cast("int"))
