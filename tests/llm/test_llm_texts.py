"""Operators on texts against plain versions."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from llm_fixtures import documents, nothing, texts  # noqa: F401
from pyspark.sql import functions as F

from tabscope.llm import decontaminate, line_dedup, pieces, quality_rules, sharding, simhash, toxicity


def listed(df):
    return [r.asDict() for r in df.collect()]


def by_text(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


# ---- quality rules ----------------------------------------------------------------

def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(hit)


def test_base_counts(texts):
    for text in texts[:-1]:
        assert quality_rules.base_counts(text.encode()) == plain_counts(text)


def test_quality_verdicts(documents, nothing):
    for r in listed(quality_rules.judge(documents)):
        n, chars, symbols, lines, repeated = plain_counts(r["text"] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeated)
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.judge(nothing).count() == 0 and quality_rules.keep_good(nothing).columns == nothing.columns


def test_distances_agree_with_a_plain_sum(documents):
    rules = quality_rules.QualityRules()
    rows = listed(documents)
    sums = {}
    for r in rows:
        classes, words = quality_rules.histograms((r["text"] or "").encode())
        if words.sum() >= rules.reference_words and classes[[1, 2, 5]].sum() <= 0.1 * classes.sum():
            own = sums.setdefault(r["lang"], [np.zeros(7), np.zeros(len(words))])
            own[0] += classes
            own[1] += words

    def distance(p, q):
        p, q = p / p.sum(), q / q.sum()
        m = (p + q) / 2
        return np.sqrt(sum(x * np.log2(x / y) / 2 for d in (p, q) for x, y in zip(d, m) if x > 0))

    for r in listed(quality_rules.judge(documents)):
        classes, words = quality_rules.histograms((r["text"] or "").encode())
        if r["lang"] in sums and classes.sum() >= rules.min_chars:
            assert r["class_distance"] == pytest.approx(distance(classes, sums[r["lang"]][0]), abs=1e-9)
        if r["lang"] in sums and words.sum() >= rules.min_words:
            assert r["word_distance"] == pytest.approx(distance(words, sums[r["lang"]][1]), abs=1e-9)
        if classes.sum() < rules.min_chars:
            assert r["class_distance"] == 0


def test_junk_goes_and_clashing_columns_are_replaced(spark, texts):
    rows = [(i, t, "en", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, Kept bigint")
    verdict = {r["doc_id"]: r["kept"] for r in listed(quality_rules.judge(df))}
    assert not any(verdict[i] for i, t in enumerate(texts) if t.startswith(("***", "SHOUT", "same words")))
    assert sum(verdict.values()) >= 0.8 * sum(1 for t in texts if len(t.split()) >= 60)
    assert quality_rules.keep_good(df).columns == df.columns


# ---- line dedup -------------------------------------------------------------------

def plain_line_dedup(rows, min_sites):
    blanks = " \t\x0b\f\r"
    sites, first = {}, {}
    for r in rows:
        for i, line in enumerate((r["text"] if r["text"] is not None else "").split("\n")):
            key = line.strip(blanks)
            if key:
                sites.setdefault(key, set()).add(r["source"])
                place = (r["doc_id"] is not None, r["doc_id"] or 0, i)
                first[key] = min(first.get(key, place), place)
    out = Counter()
    for r in rows:
        kept = None
        if r["text"] is not None:
            kept = "\n".join(line for i, line in enumerate(r["text"].split("\n")) if not (
                line.strip(blanks) and len(sites[line.strip(blanks)]) >= min_sites
                and first[line.strip(blanks)] != (r["doc_id"] is not None, r["doc_id"] or 0, i)))
        out[r["doc_id"], kept] += 1
    return out


@pytest.mark.parametrize("min_sites", [2, 10])
def test_line_dedup(documents, nothing, min_sites):
    got = line_dedup.remove_boilerplate(documents, min_sites)
    assert by_text(got, "doc_id", "text") == plain_line_dedup(listed(documents), min_sites)
    assert got.where("n_removed > 0").count() > 0
    assert line_dedup.remove_boilerplate(nothing, min_sites).count() == 0


def test_line_dedup_keeps_other_columns(documents):
    clashing = documents.withColumn("n_lines", F.lit("x")).withColumn("line_hash", F.lit(1)).withColumn("doc", F.lit(2))
    got = line_dedup.remove_boilerplate(clashing, 10)
    assert got.count() == documents.count() and dict(got.dtypes)["n_lines"] == "bigint" and got.where("doc = 2 and line_hash = 1").count() == got.count()


# ---- SimHash ----------------------------------------------------------------------

def plain_fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
    if not words:
        return 0
    own = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance):
    values, label = sorted(set(prints)), {}
    label = {v: v for v in values}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                one, two = sorted((root(a), root(b)))
                label[two] = one
    return {v: root(v) for v in values}


def test_near_copies(documents, nothing):
    rows = listed(documents)
    prints = {id(r): plain_fingerprint(r["text"] or "") for r in rows}
    roots = plain_components(prints.values(), 4)
    least = {}
    for r in rows:
        if r["doc_id"] is not None:
            k = roots[prints[id(r)]]
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    want = Counter((r["doc_id"], f"{prints[id(r)]:016x}", least.get(roots[prints[id(r)]])) for r in rows)
    assert by_text(simhash.with_component(documents), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.one_of_each(documents)
    assert kept.count() == len(set(roots.values())) and kept.columns == documents.columns
    assert simhash.with_component(nothing).count() == simhash.one_of_each(nothing).count() == 0


@pytest.mark.parametrize("distance", [2, 3, 4, 5])
def test_links_lose_no_component(spark, distance):
    """Tight groups, chains and loners; groups larger than those compared by offsets."""
    rng = np.random.default_rng(distance)
    values = set(rng.integers(0, 1 << 63, 300, dtype=np.int64).tolist())
    for centre in list(values)[:4]:
        values |= {centre ^ int(sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 4), replace=False))) for _ in range(150)}
    chain = 0
    for b in range(0, 60, distance):
        chain |= sum(1 << k for k in range(b, min(60, b + distance)))
        values.add(chain)
    df = spark.createDataFrame([(v,) for v in values], "value bigint").repartition(6)
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, distance)).collect()}
    want = plain_components(values, distance)
    assert {v: got.get(v, v) for v in values} == want


def test_segments_cover_all_bits():
    for distance in range(1, 9):
        cuts = simhash.segments(distance)
        assert sum(w for _, w in cuts) == 64 and distance // len(cuts) <= 1


# ---- decontamination --------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_scan(text, items):
    words, hit, found = plain_words(text), set(), set()
    for item, own in items:
        w = plain_words(own)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            for j in range(len(words) - size + 1):
                if words[j:j + size] == w[i:i + size]:
                    hit |= set(range(j, j + size))
                    found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.fixture(scope="module")
def benchmark(spark, texts):
    middle = " ".join(texts[8].split()[5:30])
    return spark.createDataFrame([(1, middle), (2, texts[9]), (11, "River, GARDEN! stone"), (3, None), (4, ""), (None, "winter winter"),
                                  (2, "house of light")], "item_id bigint, text string")


@pytest.mark.parametrize("max_bytes", [1 << 20, 100])
def test_benchmark_windows(documents, nothing, benchmark, texts, max_bytes):
    items = [("" if r["item_id"] is None else str(r["item_id"]), r["text"]) for r in listed(benchmark)]
    small = documents.where("coalesce(length(text), 0) < 20000")
    got = listed(decontaminate.scan(small, benchmark, max_bytes=max_bytes))
    for r in got:
        n, hit, found = plain_scan(r["text"], items)
        assert (r["n_words"], sum(s["beyond"] - s["first"] for s in r["hit_spans"]), r["items"]) == (n, hit, found)
    assert any(r["items"] for r in got) and decontaminate.scan(nothing, benchmark).count() == 0
    assert decontaminate.scan(documents, benchmark.limit(0)).where("size(items) > 0").count() == 0


def test_hits_are_removed(documents, benchmark):
    items = [("" if r["item_id"] is None else str(r["item_id"]), r["text"]) for r in listed(benchmark)]
    small = documents.where("coalesce(length(text), 0) < 20000").withColumn("items", F.lit("mine"))
    clean = Counter((r["doc_id"], r["text"]) for r in listed(small) if not plain_scan(r["text"], items)[1])
    kept = decontaminate.without_documents(small, benchmark)
    assert by_text(kept, "doc_id", "text") == clean and kept.columns == small.columns
    cut = decontaminate.without_passages(small, benchmark)
    assert cut.columns == small.columns and cut.count() == small.count()
    got = {r["doc_id"]: r["text"] for r in listed(cut)}
    for r in listed(small):
        n, hit, _ = plain_scan(r["text"], items)
        if r["doc_id"] is not None:
            assert len(plain_words(got[r["doc_id"]])) == n - hit and (hit or got[r["doc_id"]] == r["text"])


# ---- pieces -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def model():
    with open(pieces.MODEL, "rb") as file:
        return file.read()


def test_without_dropout_pieces_are_the_librarys(model, texts):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    codec = pieces.Codec(model, dropout=0.0)
    some = [t for t in texts if "▁" not in t] + ["  a  b\n c ", " a", "\n\n", "é\t\r\x00x", "a" * 300 + " " * 70 + "b", "日本語" * 40]
    for text, ids in zip(some, codec.encode(some, [""] * len(some)), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == library.encode(text)


def plain_agenda(codec, word, number):
    """The agenda as a list that is searched anew for each merge; a pair that was skipped does not come up again."""
    codes = np.array([ord(c) for c in word])
    key = codec.word_keys(codes, np.arange(len(codes)), np.zeros(1, int), np.array([number]))[0]
    bounds, skipped = list(range(len(word) + 1)), set()
    while True:
        open_ = [(codec.rank[word[a:c]], a, b, c) for a, b, c in zip(bounds, bounds[1:], bounds[2:])
                 if word[a:c] in codec.rank and (a, b, c) not in skipped]
        if not open_:
            return bounds
        _, a, b, c = min(open_)
        if codec.skipped(key, np.uint64(a), np.uint64(b), np.uint64(c)):
            skipped.add((a, b, c))
        else:
            bounds.remove(b)


@pytest.mark.parametrize("dropout", [0.1, 0.5])
def test_merge_dropout_follows_the_agenda(model, texts, dropout):
    codec = pieces.Codec(model, dropout=dropout, seed=7)
    encoded = codec.encode(texts[:20], [str(i) for i in range(20)])
    assert encoded == pieces.Codec(model, dropout=dropout, seed=7).encode(texts[:20], [str(i) for i in range(20)])
    assert encoded != pieces.Codec(model, dropout=dropout, seed=8).encode(texts[:20], [str(i) for i in range(20)])
    for text, doc, ids in zip(texts[:20], map(str, range(20)), encoded, strict=True):
        want = []
        for word, number in zip(*codec._words(text, doc), strict=True):
            bounds = plain_agenda(codec, word, number)
            assert bounds == codec.segment(word, number)
            want += [i for a, b in zip(bounds, bounds[1:]) for i in ([codec.ids[word[a:b]]] if word[a:b] in codec.ids else [codec.byte_ids[x] for x in word[a:b].encode()])]
        assert np.frombuffer(ids, np.int32).tolist() == want


def test_parts_of_a_text_do_not_change_its_pieces(model, texts, monkeypatch):
    codec = pieces.Codec(model, dropout=0.2, seed=1)
    docs = [str(i) for i in range(len(texts))]
    whole = codec.encode(texts, docs)
    monkeypatch.setattr(pieces, "TOGETHER", 777)
    assert codec.encode(texts, docs) == whole == [codec.encode([t], [d])[0] for t, d in zip(texts, docs)]
    assert not codec.tree.ids  # a process keeps no segmentations


def test_pairs_are_found_by_hash(model):
    codec = pieces.Codec(model)
    pairs = {(codec.ids[p[:k]], codec.ids[p[k:]]): i for p, i in codec.ids.items() for k in range(1, len(p)) if p[:k] in codec.ids and p[k:] in codec.ids}
    left, right = np.array(list(pairs)).T
    assert (codec._pieces(left, right) == list(pairs.values())).all()
    rng = np.random.default_rng(0)
    left, right = rng.integers(0, len(codec.bytes_of), (2, 100_000))
    assert codec._pieces(left, right).tolist() == [pairs.get(x, len(codec.bytes_of)) for x in zip(left.tolist(), right.tolist())]


def test_decoding_goes_by_its_own_model(model, spark, tmp_path):
    import glob
    other = sorted(set(glob.glob("/opt/tokenizers/*bpe*.model")) - {pieces.MODEL})
    with open(f"{tmp_path}/same.model", "wb") as file:
        file.write(model)
    df = spark.createDataFrame([(str(i), "garden stone é " * 9) for i in range(40)], "doc_id string, text string").repartition(2)
    for path in [pieces.MODEL, f"{tmp_path}/same.model", *other]:
        back = pieces.decode(pieces.encode(df, model=path).withColumnRenamed("text", "original"), model=path)
        assert back.where("text <=> original").count() == 40
    codec = pieces._codec(model, 0.1, 3)
    assert pieces._codec(model) is not codec and pieces._codec(model, 0.1, 3).limit


def test_each_occurrence_is_segmented_by_its_own_hashes(model, spark):
    words = ["garden", "stone", "winter", "überall", "x☃y", "ab" * 40]
    text = " ".join(words * 300)
    for times in (1, 2):  # of a new codec, and of one that knows the words
        codec = pieces.Codec(model, dropout=0.1, seed=7) if times == 1 else codec
        ids, split = codec.encode([text, text], ["a", "b"]), []
        for doc in ("a", "b"):
            own = []
            for word, number in zip(*codec._words(text, doc), strict=True):
                bounds = plain_agenda(codec, word, number)
                own.append(tuple(i for x, y in zip(bounds, bounds[1:]) for i in ([codec.ids[word[x:y]]] if word[x:y] in codec.ids else [codec.byte_ids[b] for b in word[x:y].encode()])))
            split.append(own)
        assert [np.frombuffer(x, np.int32).tolist() for x in ids] == [[i for w in own for i in w] for own in split]
        assert len(set(split[0][3::6])) > 8 and split[0] != split[1]
    got = pieces.encode(spark.createDataFrame([("a", text)], "doc_id string, text string"), seed=7).first()["ids"]
    assert got == np.frombuffer(ids[0], np.int32).tolist()


def test_pieces_round_trip(documents, nothing):
    clashing = documents.withColumn("ids", F.lit("mine"))
    got = pieces.encode(clashing, dropout=0.3, seed=2)
    back = pieces.decode(got.withColumnRenamed("text", "original"))
    assert back.where("not (text <=> original)").count() == 0 and back.count() == documents.count()
    both = pieces.round_trip(clashing, dropout=0.3, seed=2)
    assert both.where("not (text <=> decoded)").count() == 0
    assert both.select("doc_id", "ids").exceptAll(got.select("doc_id", "ids")).isEmpty()
    assert got.where("text is null").where("ids is not null").count() == 0 and got.where("text = '' and size(ids) = 0").count() == 1
    assert pieces.decode(pieces.encode(nothing)).count() == 0


# ---- sharding ---------------------------------------------------------------------

def plain_shard(key, shards, seed=0):
    """Spark's xxhash64 of (seed, shard, key) chains the hash of each value as the seed of the next."""
    def score(s):
        h = 42
        for value, width in ((seed, 4), (s, 4), (key, 8)):
            if value is not None:
                h = xxhash.xxh64_intdigest(int(value).to_bytes(width, "little", signed=True), h)
        return h - (1 << 64) if h >> 63 else h
    return max(range(shards), key=score)


@pytest.mark.parametrize("bucket_bytes", [16 << 20, 3000])
def test_shards(documents, nothing, bucket_bytes):
    clashing = documents.withColumn("slot", F.lit("mine")).withColumn("own", F.lit(1))
    got = listed(sharding.shuffled(clashing, shards=5, bucket_bytes=bucket_bytes))
    assert Counter((r["doc_id"], r["text"]) for r in got) == by_text(documents, "doc_id", "text")
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append((r["slot"], r["bucket"]))
        assert r["shard"] == plain_shard(r["doc_id"], 5) and r["grown_shard"] in (r["shard"], 5) and r["grown_shard"] == plain_shard(r["doc_id"], 6)
    for own in slots.values():
        assert sorted(s for s, _ in own) == list(range(len(own))) and [b for _, b in sorted(own)] == sorted(b for _, b in own)
    assert len({r["bucket"] for r in got}) > 5 if bucket_bytes == 3000 else len({r["bucket"] for r in got}) <= 5
    again = sharding.shuffled(clashing.repartition(9), shards=5, bucket_bytes=bucket_bytes)
    assert by_text(again, "doc_id", "shard", "slot") == Counter((r["doc_id"], r["shard"], r["slot"]) for r in got)
    assert sharding.shuffled(nothing).count() == 0


def test_copies_of_one_row_fill_several_buckets(spark):
    df = spark.createDataFrame([(1, "a" * 100)] * 500, "doc_id bigint, text string").repartition(4)
    got = listed(sharding.shuffled(df, shards=3, bucket_bytes=5000))
    assert len({r["shard"] for r in got}) == 1 and len({r["bucket"] for r in got}) > 5 and sorted(r["slot"] for r in got) == list(range(500))


def test_rows_are_shuffled_and_written(spark, tmp_path):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    own = sorted((r["slot"], r["doc_id"]) for r in listed(sharding.shuffled(df, shards=1)))
    ids = [i for _, i in own]
    assert sorted(ids) == list(range(2000)) and abs(np.corrcoef(ids, range(2000))[0, 1]) < 0.1
    sharding.write_shards(df, str(tmp_path / "shards"), shards=4, bucket_bytes=4000)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 2000 and back.select("shard").distinct().count() == 4


# ---- toxicity ---------------------------------------------------------------------

@pytest.fixture(scope="module")
def abuse(spark):
    import random

    rng = random.Random(5)
    words = [a + b + c for a in ("re", "in", "ha", "the", "on") for b in ("ti", "ed", "or", "an") for c in ("st", "re", "ly", "en")]
    bad = ["grobnak" + e for e in ("", "s", "ed", "ing")] + ["zzvile", "zzviler"]
    out = []
    for i in range(1500):
        toxic = i % 6 == 0
        own = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if toxic:
            for _ in range(max(2, len(own) // 20)):
                own.insert(rng.randrange(len(own)), rng.choice(bad))
        out.append((i, " ".join(own), int(toxic)))
    return out


def test_toxicity_on_held_out_rows(spark, abuse):
    docs = spark.createDataFrame([(i, t) for i, t, _ in abuse] + [(None, None), (9001, ""), (9002, "x")], "doc_id bigint, text string")
    # labels of held-out rows are wrong on purpose: they must not be read
    labels = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in abuse] + [(None, 1), (5, None)],
                                   "doc_id bigint, toxic int")
    got = listed(toxicity.scored(docs.withColumn("score", F.lit("mine")), labels))
    assert len(got) == len(abuse) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    truth = {i: y for i, _, y in abuse}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert right / len(held) > 0.97


def test_expressions(texts):
    for text in texts[:40]:
        words = plain_words(text)
        want = Counter(w.encode()[:k].ljust(8, b"\0") for w in words for k in toxicity.SIZES if len(w.encode()) >= k)
        got, n = toxicity.expressions(text.encode())
        assert n == len(words) and Counter(int(x).to_bytes(8, "big") for x in got.view(np.uint64)) == want


def test_expressions_hold_short_words_pairs_and_characters():
    def of(text):
        own, shorter, n = toxicity.grams(text.encode())
        return Counter(own.tolist()), dict(zip(own.tolist(), shorter.tolist(), strict=True)), n

    assert (of("go on, go")[0] & of("GO")[0]).total() == 1 and of("")[0].total() == 0
    for a, b in (("to go", "go to"), ("kill yourself now", "now kill yourself please"), ("aaaaaaaab", "aaaaaaaac"), ("原来如此他是坏人", "原来如此他是好人"), ("собаками", "собаковый")):
        assert of(a)[0] != of(b)[0], (a, b)
    pairs = {g for g in of("kill yourself now")[0] if g & 15 == toxicity.PAIR}
    assert len(pairs) == 2 and len(pairs & set(of("now kill yourself please")[0])) == 1 and {of("kill yourself now")[1][g] for g in pairs} < set(of("yourself now")[0])
    three = Counter(g for g in of("他是坏人。")[0].elements() if g & 15 == toxicity.THREE)
    assert three.total() == 3 and len(three - of("x他是坏y")[0]) == 2 and of("aé bé")[0].total() == 2 + 1
    rng = np.random.default_rng(0)
    for _ in range(50):
        text = "".join(rng.choice(list("ab é坏人  .Z9😀"), 30))
        words = plain_words(text)
        runs = re.findall(r"[^\x00-\x7f]+", text)
        want = Counter({toxicity.WORD: len(words), toxicity.PAIR: max(0, len(words) - 1), toxicity.TWO: sum(len(r) - 1 for r in runs), toxicity.THREE: sum(max(0, len(r) - 2) for r in runs)})
        got = Counter(g & 15 for g in of(text)[0].elements() if g & 15 not in toxicity.SIZES)
        assert got == +want and of(text)[2] == len(words)


@pytest.mark.parametrize("bad,harmless", [("oaf", "elm"), ("go away", "away go"), ("他是坏人", "人坏是他")])
def test_toxicity_of_short_words_pairs_and_texts_without_blanks(spark, bad, harmless):
    rng = np.random.default_rng(1)
    blank = "" if bad > "z" else " "
    fill = list("天地玄黄宇宙洪荒日月盈昃辰宿列张") if not blank else ["river", "stone", "house", "light", "on", "by"]
    rows = []
    for i in range(800):
        own = [str(x) for x in rng.choice(fill, 30)]
        for _ in range(3):
            own.insert(int(rng.integers(len(own))), bad if i % 4 == 0 else harmless)
        rows.append((i, blank.join(own), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    got = [r for r in listed(toxicity.scored(df.select("doc_id", "text"), df.select("doc_id", "toxic"))) if r["held_out"]]
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in got) / len(got) > 0.95


def test_toxicity_without_labels(spark, documents, nothing):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {r["score"] for r in listed(toxicity.scored(documents.select("doc_id", "text"), none))} == {0.0}
    assert toxicity.scored(nothing, none).count() == 0




def plain_weights(rows, least_z):
    """Log-ratios of both Kneser-Ney models by their definition, from (text, toxic)."""
    import math
    counts, of = {}, {}
    for text, toxic in rows:
        own, shorter, _ = toxicity.grams((text or "").encode())
        for g, s in zip(own.tolist(), shorter.tolist()):
            counts.setdefault(g, [0, 0])[0 if toxic else 1] += 1
            of[g] = s
    more = Counter(s for s in of.values() if s)
    out = {}
    for kind in toxicity.KINDS:
        grams = [g for g in counts if g & 15 == kind]
        totals = [sum(counts[g][c] for g in grams) for c in (0, 1)]
        if not all(totals):
            continue
        mass = [sum(min(counts[g][c], toxicity.DISCOUNT) for g in grams) for c in (0, 1)]
        goes_on = {g: n for g, n in more.items() if g & 15 == (toxicity.WORD if kind == toxicity.PAIR else kind)}
        every = sum(n * (n + 1) for n in goes_on.values()) if kind == toxicity.PAIR else len(grams) + sum(goes_on.values())
        for g in grams:
            shared = (more.get(of[g] if kind == toxicity.PAIR else g, 0) + 1) / every
            expected = sum(counts[g]) * totals[0] / sum(totals)
            if abs(counts[g][0] - expected) >= least_z * math.sqrt(max(expected, 0.5)):
                chance = [(max(counts[g][c] - toxicity.DISCOUNT, 0) + mass[c] * shared) / totals[c] for c in (0, 1)]
                out[g] = math.log(chance[0] / chance[1])
    return out


@pytest.mark.parametrize("partitions, least_z", [(1, 0.0), (9, 1.0)])
def test_counts_and_weights_of_two_models(spark, texts, partitions, least_z):
    rows = [(t, i % 3 == 0) for i, t in enumerate(texts[:50])] + [(None, True), ("", False), ("böse Wörter 他是坏人。 böse", True), ("他是好人。", False)]
    df = spark.createDataFrame(rows, "text string, toxic boolean").repartition(5)
    got = {r["gram"]: r["weight"] for r in toxicity.weights(toxicity.counted(df, partitions), least_z).collect()}
    want = plain_weights(rows, least_z)
    assert got.keys() == want.keys() and len(got) > 4
    assert all(got[g] == pytest.approx(want[g], rel=1e-9) for g in got)
