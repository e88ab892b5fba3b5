"""Growing and walking isolation trees on NumPy arrays, used inside Spark tasks."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EULER_GAMMA = 0.5772156649015329


def expected_path(n):
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype="float64")
    big = 2.0 * (np.log(np.maximum(n, 3) - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / np.maximum(n, 1)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, big))


def grow_tree(points: np.ndarray, rng: np.random.Generator, depth_limit: int) -> list[tuple]:
    """Nodes (node, feature, threshold, left, path) of one tree.

    The right child is the left one plus one; a leaf points at itself with an endless
    threshold, so that a walk of fixed length stays on it.
    """
    nodes: list[tuple] = []
    waiting = [(0, np.arange(len(points)), 0)]
    issued = 1
    while waiting:
        node, rows, depth = waiting.pop()
        inside = points[rows]
        low, high = inside.min(axis=0), inside.max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth >= depth_limit or len(rows) <= 1 or not len(splittable):
            nodes.append((node, 0, np.inf, node, depth + float(expected_path(len(rows)))))
            continue
        feature = int(splittable[rng.integers(len(splittable))])
        threshold = float(low[feature] + (high[feature] - low[feature]) * rng.random())
        goes_left = inside[:, feature] <= threshold
        left, right = issued, issued + 1
        issued += 2
        nodes.append((node, feature, threshold, left, 0.0))
        waiting.append((right, rows[~goes_left], depth + 1))
        waiting.append((left, rows[goes_left], depth + 1))
    return nodes


#: Levels at the top of a tree whose nodes are compared with all rows (at most 8), and rows that walk together, fewer than twice as many.
DENSE_LEVELS, WALKERS = 4, 1 << 16


@dataclass
class Heaps:
    """Trees as complete binary ones: the children of node i are 2 i and 2 i + 1, a leaf above the last level stands for all below it.

    Values and thresholds are taken by their place among the feature's thresholds of all trees, so that comparisons and
    lookups are of small whole numbers: a value is above a threshold just where its place is.
    """

    depth: int
    thresholds: list[np.ndarray]  # of each feature, sorted
    inner: np.ndarray  # [tree, node]: whether it is split
    feature: np.ndarray  # [tree, node]
    place: np.ndarray  # [tree, node]: of the threshold
    node: np.ndarray  # [tree, node]: both in one number
    path: np.ndarray  # [tree, leaf]


def heaps(trees: dict, depth_limit: int, n_features: int) -> Heaps:
    n_trees, width = len(trees["feature"]), 1 << depth_limit
    split = [left != np.arange(len(left)) for left in trees["left"]]
    thresholds = [np.unique(np.concatenate([t[s & (f == k)] for f, t, s in zip(trees["feature"], trees["threshold"], split)]))
                  for k in range(n_features)]
    inner, feature, place = np.zeros((n_trees, width), bool), np.zeros((n_trees, width), np.int64), np.zeros((n_trees, width), np.int64)
    path = np.empty((n_trees, width))
    for i in range(n_trees):
        at = np.zeros(1, np.int64)
        for level in range(depth_limit):
            here = slice(1 << level, 2 << level)
            inner[i, here], feature[i, here] = split[i][at], trees["feature"][i][at]
            for k in np.unique(feature[i, here]):
                own = np.flatnonzero(inner[i, here] & (feature[i, here] == k))
                place[i, here][own] = np.searchsorted(thresholds[k], trees["threshold"][i][at[own]])
            left = trees["left"][i][at]  # of a leaf itself
            at = np.stack([left, left + split[i][at]], axis=1).ravel()
        path[i] = trees["path"][i][at]
    return Heaps(depth_limit, thresholds, inner, feature, place, (place + 1) << 32 | feature, path)


def walk(columns: list[np.ndarray], trees: Heaps) -> np.ndarray:
    """Mean path length over all trees of the rows given by their feature columns."""
    parts = max(1, len(columns[0]) // WALKERS)
    return np.concatenate([_walk(list(some), trees) for some in zip(*[np.array_split(c, parts) for c in columns])])


def _walk(columns: list[np.ndarray], trees: Heaps) -> np.ndarray:
    n = len(columns[0])
    places = [np.searchsorted(t, c) for t, c in zip(trees.thresholds, columns)]
    kind = np.min_scalar_type(max(len(t) for t in trees.thresholds)).type
    narrow = [p.astype(kind) for p in places]
    # with all low bits set, above a node's number just where the place is above the threshold's
    wide = (np.stack(places, axis=1) << 32 | 0xFFFFFFFF).ravel()
    rows = np.arange(n) * len(columns)
    dense = min(DENSE_LEVELS, trees.depth)
    total = np.zeros(n)
    at, node, step, value = (np.empty(n, np.int64) for _ in range(4))
    for i in range(len(trees.node)):
        at[:] = _end(narrow, trees, i, 1, dense, kind)
        for level in range(dense, trees.depth):
            np.take(trees.node[i, 1 << level:2 << level], at, out=node, mode="clip")
            np.bitwise_and(node, 0xFFFFFFFF, out=step)
            np.add(step, rows, out=step)
            np.take(wide, step, out=value, mode="clip")
            np.subtract(node, value, out=value)
            np.right_shift(value, 63, out=value)  # -1 to the right, 0 to the left
            np.add(at, at, out=at)
            np.subtract(at, value, out=at)
        total += trees.path[i].take(at)
    return total / len(trees.node)


def _end(narrow: list[np.ndarray], trees: Heaps, i: int, node: int, levels: int, kind: type) -> np.ndarray | int:
    """Which of the nodes so many levels below ``node`` each row reaches from it; a number where all reach the same."""
    first = (node << levels) % (1 << min(DENSE_LEVELS, trees.depth))
    if not levels or not trees.inner[i, node]:
        return first
    left, right = (_end(narrow, trees, i, 2 * node + side, levels - 1, kind) for side in (0, 1))
    turn = np.negative((narrow[trees.feature[i, node]] > kind(trees.place[i, node])).view(np.int8)).view(np.uint8)
    np.bitwise_and(turn, left ^ right, out=turn)
    return np.bitwise_xor(turn, left, out=turn)


def mean_path(columns: list[np.ndarray], trees: dict, depth_limit: int) -> np.ndarray:
    """The same for trees as they are grown."""
    return walk(columns, heaps(trees, depth_limit, len(columns)))
