"""SimHash near-dedup by deletion-variant signatures, and connected components of the links.

A fingerprint of 64 bits is cut into ``distance // 2 + 1`` segments, so that of two fingerprints within ``distance``
bits one segment differs by at most one bit.  Each fingerprint is indexed under every segment with each of its bits
wildcarded in turn (64 keys); equality of keys brings such pairs together, and counting the differing bits verifies
them.  A key's members are joined to a forest that has the same components as all their links: a member looks only
for members no other has reached, so a group of n near copies costs n links, not n * n.

Components are found by alternating large-star and small-star rounds over the links between distinct fingerprints,
each written to the shared folder.  A key's fingerprints (8 bytes each) are the only thing one task holds together.

Defined results: null and empty texts have fingerprint zero and link like any other; texts of fewer words than a
shingle are one shingle; repeated rows share a fingerprint; null ids are ignored when the smallest is chosen (a
component of null ids alone has a null id); an empty table gives an empty result; input columns called as a result
column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from tabscope.functions.columns import col
from tabscope.llm.common import add_columns, as_bytes, replaced
from tabscope.plans.stored import stored

BITS, SEED, SHINGLE, DISTANCE = 64, 42, 4, 4
#: Groups up to this size are compared by offsets over whole batches, larger ones one by one.
SMALL_GROUP = 16


def shingles(text: bytes, size: int = SHINGLE) -> list[bytes]:
    words = text.lower().split()  # bytes: A-Z only, and the white space of ASCII
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [joined]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1]
    return [joined[a:b] for a, b in zip(starts.tolist(), ends[size - 1:].tolist(), strict=True)]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    hashes = np.array([xxh64_intdigest(s, SEED) for s in shingles(text, size)], dtype="<u8")
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), 1 << 16):
        own = hashes[part:part + (1 << 16)]
        ones += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", size: int = SHINGLE, name: str = "fingerprint") -> DataFrame:
    """``df`` with the signed 64-bit fingerprint of its texts."""
    def run(texts):
        return [np.array([fingerprint(t, size) for t in as_bytes(texts)], np.uint64).view(np.int64)]
    return add_columns(df, f"{name} bigint", run, col(text))


def segments(distance: int) -> list[tuple[int, int]]:
    """First bit and width of each segment; widths differ by one at most."""
    n = distance // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _variants(values: np.ndarray, distance: int) -> np.ndarray:
    """Keys, one row per bit: the segment that holds the bit, without the bit, and the bit's number."""
    values = values.view(np.uint64)
    out = []
    for first, width in segments(distance):
        own = (values >> np.uint64(first)) & np.uint64((1 << width) - 1)
        out += [((own & ~np.uint64(1 << bit)) << np.uint64(6)) | np.uint64(first + bit) for bit in range(width)]
    return np.stack(out).view(np.int64)


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; unsigned, since of signed numbers NumPy counts the bits of the absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest(values: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect the distinct ``values`` as all links up to ``distance`` do."""
    links, rest = [], values
    while len(rest):
        reached, rest = [rest[:1]], rest[1:]
        while reached and len(rest):
            batch = reached.pop()
            for at in batch:
                near = _differing(rest, at) <= distance
                if near.any():
                    found, rest = rest[near], rest[~near]
                    links.append((np.full(len(found), at), found))
                    reached.append(found)
    return links


def _links(keys: np.ndarray, values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the groups of equal keys; both arrays are sorted by key, values are distinct within a key."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    links = []
    size_of = np.repeat(sizes, sizes)
    small = size_of <= SMALL_GROUP
    for offset in range(1, int(min(sizes.max(), SMALL_GROUP))):
        at = np.flatnonzero(small[:-offset] & (keys[:-offset] == keys[offset:]))
        at = at[_differing(values[at], values[at + offset]) <= distance]
        links.append((values[at], values[at + offset]))
    for group in np.flatnonzero(sizes > SMALL_GROUP):
        links += _forest(values[starts[group]:starts[group] + sizes[group]], distance)
    if not links:
        return values[:0], values[:0]
    one, two = (np.concatenate(x) for x in zip(*links, strict=True))
    return one, two


def links(fingerprints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Distinct pairs (a < b) of distinct fingerprints that connect them as all pairs within ``distance`` do.

    ``fingerprints`` has one column of distinct 64-bit values.
    """
    values = fingerprints.select(col(fingerprints.columns[0]).alias("value"))
    rows = 4096

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_values = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(all_values), rows):
                own = all_values[start:start + rows]
                yield pa.RecordBatch.from_arrays([pa.array(_variants(own, distance).ravel()), pa.array(np.tile(own, BITS))], names=["key", "value"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flushed(parts):
            keys, own = (np.concatenate(x) for x in zip(*parts, strict=True))
            one, two = _links(keys, own, distance)
            pairs = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            last = np.searchsorted(keys, keys[-1])  # the last key may go on in the next batch
            if last:
                yield flushed([*held, (keys[:last], own[:last])])
                held = []
            elif held and held[-1][0][-1] != keys[0]:
                yield flushed(held)
                held = []
            held.append((keys[last:], own[last:]))
        if held:
            yield flushed(held)

    # each fingerprint becomes 64 rows, so a small table of them is spread first, by another hash than it is grouped by
    n = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    indexed = values.repartition(n, F.xxhash64("value")).mapInArrow(index, "key bigint, value bigint")
    # neighbours by key: a count that follows spark.sql.shuffle.partitions, sorted so that keys come one after another
    return indexed.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a bigint, b bigint").distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every neighbour (larger ones in a large star, smaller ones in a small star) to the smallest neighbour."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    sides = edges.unionByName(turned) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("hub"), F.least("a", "least").alias("least"))
    joined = sides.join(least, F.col("a") == F.col("hub"))
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select(F.col("hub").alias("a"), F.col("least").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edges (a, b) with the smallest node of its component."""
    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stored(edges, "links")
    before = state(edges)
    while before[0]:
        edges = stored(_star(stored(_star(edges, True), "large-star"), False), "small-star")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(df: DataFrame, doc: str = "doc_id", text: str = "text", distance: int = DISTANCE, size: int = SHINGLE) -> DataFrame:
    """(doc, fingerprint, text_hash, root, component_id) of every row; component_id is the smallest id reachable."""
    base = df.select(col(doc).alias("doc"), col(text).alias("text"), F.xxhash64(col(text)).alias("text_hash"))
    own = stored(with_fingerprint(base, "text", size).drop("text"), "fingerprints")
    distinct = own.groupBy("fingerprint").agg(F.min("doc").alias("least"))
    found = components(links(distinct.select("fingerprint"), distance))
    rooted = distinct.join(found, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    component = rooted.join(smallest, "root").select(F.col("fingerprint").alias("of"), "root", "component_id")
    return own.join(component, F.col("fingerprint") == F.col("of")).drop("of")


def with_component(df: DataFrame, doc: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """Ids, fingerprints as 16 hex digits, and component ids."""
    found = near_duplicates(df, doc, text, distance)
    return found.select(F.col("doc").alias(doc), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, doc: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The row of smallest id (of equal ids, the smallest text hash) of every component, one of several equal rows."""
    found = near_duplicates(df, doc, text, distance)
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "text_hash")).alias("first")).select(
        F.col("first.doc").alias("kept_doc"), F.col("first.text_hash").alias("kept_hash"))
    keyed = replaced(df, __text_hash=F.xxhash64(col(text)))
    chosen = keyed.join(kept, col(doc).eqNullSafe(F.col("kept_doc")) & (F.col("__text_hash") == F.col("kept_hash")), "left_semi")
    return chosen.dropDuplicates([doc, "__text_hash"]).select(*[col(c) for c in df.columns])
