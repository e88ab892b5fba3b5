"""Collocations, conversation repair and the quality classifier against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from llm_fixtures import documents, nothing, texts  # noqa: F401
from pyspark.sql import functions as F

from tabscope.llm import phrases, quality_trees, queries, repair


def listed(df):
    return [r.asDict() for r in df.collect()]


# ---- collocations -----------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_collocations(rows, most_words, least, share, top):
    """(lang, rank, phrase, a, l, r, n, score) by counting everything."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, most_words + 1):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i:i + size])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = set()
    for (lang, words), a in candidates.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                if 100 * a >= share * f[lang, words[i:i + size]]:
                    covered.add((lang, words[i:i + size]))
    found = {}
    for (lang, words), a in candidates.items():
        if (lang, words) in covered:
            continue
        score, k = min((1_000_000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, own in found.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1)}


NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def as_set(df):
    rows = listed(df)
    found = {tuple(r[k] for k in NAMES) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("most_words, least, share, top, small", [(3, 10, 50, 2000, False), (3, 3, 50, 40, True), (4, 2, 80, 500, True)])
def test_collocations(documents, texts, monkeypatch, most_words, least, share, top, small):
    if small:  # many hash partitions, merges and blocks
        for name, value in (("MASS", 512), ("BLOCK", 1000), ("HELD", 300), ("BITS_EACH", 1)):
            monkeypatch.setattr(phrases, name, value)
    short = documents.where(F.coalesce(F.length("text"), F.lit(0)) < 5000)
    rows = [(r["lang"], r["text"]) for r in listed(short)]
    assert as_set(phrases.collocations(short, most_words=most_words, least=least, share=share, top=top)) == plain_collocations(rows, most_words, least, share, top)


def test_collocations_of_hard_texts(spark):
    rows = [("x", "A  b\tc. a b; A B\nc"), ("x", "É a b" * 40), (None, "a b"), ("und", "a b"), ("x", None), ("", "a b a b"), ("y", " .,\t"),
            ("y", ""), ("x", " a b\x00c a b\x00c")] * 2 + [("hot", "one two three " * 30_000)]
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("Phrase", F.lit(1)).withColumn("n", F.lit(2)).repartition(7)
    assert as_set(phrases.collocations(df, least=2)) == plain_collocations(rows, 3, 2, 50, 2000)


def test_collocations_of_nothing(nothing, spark):
    assert phrases.collocations(nothing).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, None, None)], nothing.schema)).count() == 0


def test_counts_beyond_64_bits(spark):
    rows = [("x", 1, "a", 9 * 10**12), ("x", 1, "b", 8 * 10**12), ("x", 2, "a b", 7 * 10**12)]
    found = listed(phrases.scored(spark.createDataFrame(rows, "lang string, size int, phrase string, f bigint"), 3, 50))
    assert found[0]["score"] == 1_000_000 * (7 * 10**12) ** 2 // (72 * 10**24)


def test_slices_do_not_change_grams(monkeypatch, texts):
    data = [t.encode() for t in texts]

    def every():
        found = Counter()
        for own, langs in phrases.slices(["x"] * len(data), data, 3):
            for size, (first, _) in enumerate(own.sizes, 1):
                found.update(own.texts(first, size).to_pylist())
        return found

    whole = every()
    monkeypatch.setattr(phrases, "SLICE", 100)
    assert every() == whole


@pytest.mark.parametrize("seed", range(6))
def test_summaries_keep_every_frequent_item(seed):
    rng = np.random.default_rng(seed)
    least = int(rng.integers(2, 12))
    items = np.concatenate([rng.integers(0, 5000, 20_000), np.repeat(np.arange(10_000, 10_030), least)]).astype(np.uint64)
    if seed % 2:
        items = np.concatenate([items, np.full(100_000, 7, np.uint64)])
    rng.shuffle(items)
    summary = phrases.Summary(least, 50 if seed > 3 else 2 * 20_000 // least)
    for part in np.array_split(items, 40):
        summary.add(*phrases.added(part, np.ones(len(part), np.int64)))
    every, counts = np.unique(items, return_counts=True)
    assert set(every[counts >= least].tolist()) <= set(summary.survivors().tolist())
    assert summary.taken_off < least


# ---- conversation repair ----------------------------------------------------------

def plain_repair(turns):
    """What op12 returns for one conversation, by trying all edits; turns: (turn, role, text) in order."""
    rows, seen = [], set()
    blank = duplicate = truncated = illegal = 0
    for k, (_, role, text) in enumerate(turns):
        full = re.sub(r"[\x20\x09-\x0D]", "", text)
        gone = not full or (role, text) in seen
        cut_off = bool(full) and full[-1] not in ".!?"
        blank += not full
        duplicate += bool(full) and (role, text) in seen
        truncated += not gone and cut_off
        illegal += k > 0 and turns[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        seen.add((role, text))
        rows.append((role, text, gone, 5 if cut_off else 0))

    def allowed(so_far):
        return re.fullmatch(r"s?(ua)*u?", so_far) is not None

    @lru_cache(maxsize=None)
    def best(i, tail, any_yet):
        """Least (cost, letters) from row i on; ``tail`` is the last initial given, of all that matters."""
        def may(c):
            return allowed({"": "", "s": "s", "u": "u", "a": "ua"}[tail] + c)

        ways = []
        if i == len(rows):
            if tail in ("", "a"):
                ways.append((0, ""))
        else:
            role, _, gone, extra = rows[i]
            cost, letters = best(i + 1, tail, 0)
            ways.append((cost + 2, "D" + letters))
            if not gone:
                if role[:1] in ("s", "u", "a") and may(role[:1]):
                    cost, letters = best(i + 1, role[:1], 0)
                    ways.append((cost + extra, "K" + letters))
                for c in "ua":
                    if may(c):
                        cost, letters = best(i + 1, c, 0)
                        ways.append((cost + 1 + extra, "R" + letters))
        if any_yet < 2:
            for c in "ua":
                if may(c):
                    cost, letters = best(i, c, any_yet + 1)
                    ways.append((cost + 5, "I" + letters))
        return min(ways, default=(10**9, ""))

    cost, audit = best(0, "", 0)
    out, i = [], 0
    for letter in audit:
        given = "".join(r[:1] for r, _ in out)
        wanted = "user" if given.lstrip("s")[-1:] in ("", "a") else "assistant"
        if letter in "KR":
            out.append((rows[i][0] if letter == "K" else wanted, rows[i][1]))
        elif letter == "I":
            out.append((wanted, ""))
        i += letter != "I"
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return {"gaps": gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "cost": cost, "audit": audit,
            "repaired_sha256": digest}


def in_order(turns):
    return sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in turns), key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))


def conversations(seed, n, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No?", "cut", "a.b", "", " \n", "Good! ", "é.", "é", None, "Yes."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "us", None]
    return {c: [(rng.choice([None, *range(2 * most)]), rng.choice(roles[:rng.choice([2, 3, 9])]), rng.choice([*texts, f"t{rng.random()}."]))
                for _ in range(rng.randint(1, most))] for c in range(n)}


def repaired(df):
    found = repair.Repair(df)
    return found, found.counts().join(found.audits(), "conv")


@pytest.mark.parametrize("seed, segment", [(1, 1024), (2, 3), (3, 1)])
def test_repairs(spark, monkeypatch, seed, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    every = conversations(seed, 150, 9) | {None: [(1, "user", "Hi."), (1, "user", "Hi."), (2, "assistant", "Yes.")]}
    rows = [(c, *t) for c, own in every.items() for t in own]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("Segment", F.lit("x")).repartition(6)
    found, made = repaired(df)
    results = {r["conv"]: r for r in listed(made)}
    assert len(results) == len(every)
    edits = {}
    for r in listed(found.edits()):
        edits.setdefault(r["conv"], []).append(r)
    for c, own in every.items():
        key = "{}" if c is None else f'{{"id":{c}}}'
        want = plain_repair(in_order(own))
        assert {k: results[key][k] for k in want} == want, (c, in_order(own))
        script = sorted(edits[key], key=lambda r: r["number"])
        assert "".join(r["edit"] for r in script) == want["audit"] and sum(r["cost"] for r in script) == want["cost"]
        turns = "\n".join(f"{r['role']}:{r['text']}" for r in script if r["edit"] != "D")
        assert hashlib.sha256(turns.encode()).hexdigest() == want["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in script if r["edit"] != "D"))


def test_one_long_conversation(spark):
    rng = random.Random(5)
    turns = [(i, ["user", "assistant"][i % 2] if rng.random() < 0.9 else "user", f"turn {i % 4000}{rng.choice(['.', '.', '.', ''])}") for i in range(6000)]
    df = spark.createDataFrame([(1, *t) for t in turns], "conv_id bigint, turn bigint, role string, text string").repartition(8)
    [row] = listed(repaired(df)[1])
    import sys
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(100_000)
    try:
        symbols = np.array([repair.symbol_of({"role": r, "blank": False, "repeat": False, "truncated": not t.endswith(".")}) for _, r, t in turns[:50]])
        state, off = repair.read_backward(symbols, 0)
        assert repair.tables().costs[state][0] + off == plain_repair(turns[:50])["cost"]
    finally:
        sys.setrecursionlimit(limit)
    letters = Counter(row["audit"])
    assert letters["D"] + letters["K"] + letters["R"] == 6000 and row["duplicate"] + row["blank"] <= letters["D"]


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    found, made = repaired(empty)
    assert made.count() == 0 and found.edits().count() == 0


def test_damage_and_repair(spark, tmp_path):
    every = conversations(9, 60, 8)
    rows = [(c, *t) for c, own in every.items() for t in own] + [(777, None, None, None)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["conv_id"]: r for r in listed(queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path)))}
    assert set(found) == {r[0] for r in rows}
    for c in found:
        left = []
        for _, turn, role, text in (r for r in rows if r[0] == c):
            damage = zlib.crc32(f"{c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if damage == 1 else re.sub("[.!?]", "", text) if damage == 2 else text
            left += [(turn, "user" if damage == 4 else role, text)] * (0 if damage == 0 else 2 if damage == 3 else 1)
        want = plain_repair(in_order(left))
        assert {k: found[c][k] for k in want} == want


# ---- quality classifier -----------------------------------------------------------

def test_statistics_of_plain_texts():
    at = {name: i for i, name in enumerate(quality_trees.FEATURES)}
    found = quality_trees.statistics("The Cat sat. the cat\nsat! É | #".encode())
    assert found[at["distinct_words"]] == 9 / 9 and found[at["capital_words"]] == 2 / 9 and found[at["distinct_lines"]] == 1.0
    assert found[at["shouts_a_word"]] == 1 / 9 and found[at["signs_a_word"]] == 1 / 9 and found[at["beyond_share"]] == 1 / 31
    for empty in (b"", b" \n\t"):
        assert not quality_trees.statistics(empty).any()


def test_trees_go_down_as_written():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5)).round(1)
    y = ((x[:, 0] + x[:, 1] * x[:, 2] > 0) ^ (rng.random(400) < 0.05)).astype(float)
    trees = quality_trees.fit(x, y, n_trees=80, depth=4)

    def plain(row):
        total = trees.base
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        return total

    assert np.allclose(trees.value(x), [plain(row) for row in x])
    assert ((trees.score(x) > 0.5) == y).mean() > 0.9


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (300, 4)).astype(float)
    y = (x[:, 2] + rng.normal(size=300) > 6).astype(float)
    tree = quality_trees.fit(x, y, n_trees=1, depth=1)
    p = y.sum() + 0.5
    p = p / (p + len(y) - y.sum() + 0.5)

    def gain(f, t):
        total = 0
        for side in (x[:, f] <= t, x[:, f] > t):
            total += (p - y[side]).sum() ** 2 / (side.sum() * p * (1 - p) + 1)
        return total

    best = max(((gain(f, t), f, t) for f in range(4) for t in np.arange(0.5, 11)), key=lambda g: g[0])
    assert (tree.feature[0, 0], tree.threshold[0, 0]) == best[1:]


def test_quality_scores_of_hard_tables(spark, documents, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (None, 1), (5, None), (3, 1)], "doc_id bigint, quality int")
    found = listed(quality_trees.scored(documents.withColumn("Score", F.lit("x")), labels))
    assert len(found) == documents.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0) for r in found)
    by_text = {}
    for r in found:
        by_text.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(v) == 1 for v in by_text.values())
    assert quality_trees.scored(nothing, labels).count() == 0
    assert {r["score"] for r in listed(quality_trees.scored(documents, labels.limit(0)))} == {0.5}
    ones = labels.where("doc_id IS NOT NULL").withColumn("quality", F.lit(1))
    assert len({r["score"] for r in listed(quality_trees.scored(documents, ones))}) == 1


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in listed(spark.read.parquet(f"{folder}/labels.parquet"))}
    rows = [r for r in listed(queries.QUERIES["op13_quality_classifier"](spark, folder)) if r["held_out"] and r["doc_id"] in labels]
    right = [r["predicted"] == labels[r["doc_id"]] for r in rows]
    good = [r["predicted"] for r in rows if labels[r["doc_id"]]]
    bad = [r["predicted"] for r in rows if not labels[r["doc_id"]]]
    assert len(rows) > 700 and np.mean(right) > 0.98 and np.mean(good) > 0.99 and np.mean(bad) < 0.1
