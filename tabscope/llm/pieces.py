"""SentencePiece encoding with seeded merge-dropout, and decoding.

Text is segmented by merges from single characters upward, the best-scored adjacent pair first, the left one of
equals.  Each candidate merge that comes up is skipped for good with probability ``dropout``, decided by a keyed hash
of the seed, the word, the document id, the word's number in the document and the place of the pair in the word; so a
seed gives the same segmentation on every run and every executor, and dropout 0 gives the library's own.  Each occurrence
of a word is segmented by hashes of its own.

Words (a run of blanks with what follows) are segmented one by one, which is exact since no piece of the model
continues from a character into a blank or across a line feed; models with such pieces are refused.  The words of a few
megabytes of text are numbered, and their segmentations are grown as trees, level by level: a node holds what comes out if
exactly its candidates are skipped, and the merges after the last of these; an occurrence goes on to the child of the first
of them that its hashes skip.  The trees end with these megabytes, so that a process holds no more than they need.

Any segmentation decodes to its text: characters without a piece, and a literal block character that the model
would read as a blank, are written as bytes.  The model file is read by the driver and sent to the tasks.

Defined results: a null text has null ids and decodes to null, an empty text has no ids; a null document id counts as
an empty one; rows are encoded one by one, so repeated rows get equal ids; very long texts and very long words are
encoded whole; input columns called as a result column are replaced; empty tables give empty results.
"""

from __future__ import annotations

import gc
import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from xxhash import xxh64_intdigest

from tabscope.functions.columns import col
from tabscope.llm.common import add_columns, as_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK = "▁"
WORD = re.compile(f"\n|{BLOCK}+[^{BLOCK}\n]*|[^{BLOCK}\n]+")
#: Stands for a block character that a text itself holds; no other word is empty.
LITERAL = ""
MASK = (1 << 64) - 1
#: Odd multipliers of the keyed hash.
A, B, C, D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
#: Words longer than this are segmented one by one; words segmented, occurrences of words, and bytes of text, at a time.
LONG_WORD, ROUND, TOGETHER, SLICE = 48, 1 << 13, 1 << 19, 4 << 20


class Tree:
    """Segmentations by what is skipped: a word's first node skips nothing, a child one of the merges of its parent too."""

    def __init__(self):
        self.ids: list[bytes] = []
        self.words: list[str] = []
        self.skips: list[tuple[int, ...]] = []
        self.own = np.zeros(1 << 12, np.uint64)  # hash of the word
        self.at = np.zeros(1 << 12, np.int64)  # its merges, from here in ``merges``
        self.count = np.zeros(1 << 12, np.int64)
        self.merges = np.zeros(1 << 14, np.int32)  # start, middle and end, 6 bits each
        self.used = 0

    def add(self, words: list[str], skips: list[tuple[int, ...]], own: np.ndarray, ids: list[bytes], counts: np.ndarray, merges: np.ndarray) -> None:
        n = len(self.ids)
        while len(self.own) < n + len(words):
            self.own, self.at, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.own, self.at, self.count))
        while len(self.merges) < self.used + len(merges):
            self.merges = np.concatenate([self.merges, np.zeros_like(self.merges)])
        new = slice(n, n + len(words))
        self.own[new], self.count[new], self.at[new] = own, counts, self.used + np.cumsum(counts) - counts
        self.merges[self.used:self.used + len(merges)] = merges
        self.used += len(merges)
        self.ids += ids
        self.words += words
        self.skips += skips


@dataclass
class Codec:
    """A byte-pair model with byte fallback, and one setting of dropout."""

    model: bytes
    dropout: float = 0.1
    seed: int = 0

    def __post_init__(self):
        processor = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        n = processor.get_piece_size()
        normal = {processor.id_to_piece(i): i for i in range(n)
                  if not (processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or processor.is_unused(i))}
        if any("\n" in p or re.search(f"[^{BLOCK}]{BLOCK}", p) for p in normal):
            raise ValueError("the model has pieces that cross words")
        byte_ids = [processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(processor.is_byte, byte_ids)):
            raise ValueError("the model has no byte fallback")
        self.ids = normal
        # merges in the order of score; equal scores share a rank, and of equal ranks the left pair comes first
        scores = sorted({processor.get_score(i) for i in normal.values()}, reverse=True)
        place = {s: r for r, s in enumerate(scores)}
        self.rank = {p: place[processor.get_score(i)] for p, i in normal.items()}
        self.byte_ids = byte_ids
        self.bytes_of = [b""] * n
        for p, i in normal.items():
            self.bytes_of[i] = p.replace(BLOCK, " ").encode()
        for b, i in enumerate(byte_ids):
            self.bytes_of[i] = bytes([b])
        self.limit = int(self.dropout * (1 << 53))
        self.tree = Tree()
        # the same merges as arrays: ids of characters, and of each pair of ids that makes a piece, that piece
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.rank_of = np.full(n + 1, len(normal), np.int32)
        for p, i in normal.items():
            self.rank_of[i] = self.rank[p]
        pairs = sorted((normal[p[:k]] * n + normal[p[k:]], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal)
        self._hash_pairs(np.array([k for k, _ in pairs], np.int64), np.array([i for _, i in pairs], np.int32))

    def _hash_pairs(self, keys: np.ndarray, pieces: np.ndarray) -> None:
        """A table of pairs by hash, at most a quarter full; a pair stands in the first free slot from its own on."""
        bits = max(4, int(4 * len(keys)).bit_length())
        self.pair_shift = np.uint64(64 - bits)
        self.pair_key, self.pair_piece = np.full(1 << bits, -1, np.int64), np.full(1 << bits, len(self.bytes_of), np.int32)
        slot = self._slots(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.pair_key[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.pair_key[slot[placed]], self.pair_piece[slot[placed]] = keys[placed], pieces[placed]
            left = np.setdiff1d(left, placed)
            slot[left] = (slot[left] + 1) & (len(self.pair_key) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * A) >> self.pair_shift).astype(np.int64)

    def word_keys(self, codes: np.ndarray, places: np.ndarray, heads: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """A hash of each word's characters and their places, keyed by the seed and the occurrence's number."""
        return self.keyed(self.char_keys(codes, places, heads), numbers)

    def char_keys(self, codes: np.ndarray, places: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """A hash of each word's characters and their places."""
        with np.errstate(over="ignore"):
            own = (codes.astype(np.uint64) + np.uint64(1)) * B
            own = (own ^ (own >> np.uint64(31))) * (places.astype(np.uint64) * A + C)
            return np.add.reduceat(own, heads)

    def keyed(self, own: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Hashes of words keyed by the seed and a number of each occurrence."""
        with np.errstate(over="ignore"):
            return own ^ ((numbers.astype(np.uint64) + np.uint64(self.seed & MASK) * B) * D)

    def skipped(self, key, start, middle, end):
        """Whether the candidate of two symbols, [start, middle) and [middle, end), is skipped; of numbers or arrays."""
        with np.errstate(over="ignore"):
            x = key + start * A + middle * B + end * C
            x = (x ^ (x >> np.uint64(32))) * D
            return ((x ^ (x >> np.uint64(29))) * A) >> np.uint64(11) < self.limit

    def _pieces(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece each pair of ids makes, or one beyond the last."""
        keys = left.astype(np.int64) * len(self.bytes_of) + right
        slot = self._slots(keys)
        found = self.pair_key[slot]
        out = self.pair_piece[slot]
        other = np.flatnonzero((found != keys) & (found >= 0))
        while len(other):  # another pair's slot
            slot[other] = (slot[other] + 1) & (len(self.pair_key) - 1)
            found = self.pair_key[slot[other]]
            out[other] = self.pair_piece[slot[other]]
            other = other[(found != keys[other]) & (found >= 0)]
        return out

    def _grow(self, words: list[str], skips: list[tuple[int, ...]]) -> range:
        """Add nodes to the tree: each word segmented with exactly the given merges skipped."""
        for at in range(0, len(words), ROUND):
            some, own = words[at:at + ROUND], skips[at:at + ROUND]
            size = np.fromiter(map(len, own), np.int64, len(own))
            table = np.full((len(own), max(1, size.max())), -1, np.int32)
            table[np.repeat(np.arange(len(own)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = [x for y in own for x in y]
            self._segmented(some, own, size, lambda of, merge, table=table: (table[of] == merge[:, None]).any(axis=1))
        return range(len(self.tree.ids) - len(words), len(self.tree.ids))

    def _try(self, words: list[str], skips: list[tuple[int, ...]], numbers: np.ndarray) -> tuple[list[bytes], dict[int, int]]:
        """Ids of occurrences that skip the given merges and maybe more, and new nodes, of those that skip no more."""
        ids, nodes = [], {}
        for at in range(0, len(words), ROUND):
            some, own = words[at:at + ROUND], skips[at:at + ROUND]
            keys = self.word_keys(*self._characters(some), numbers[at:at + ROUND])
            six, low = np.uint64(6), np.uint64(63)

            def skip(of, merge, keys=keys):
                x = merge.astype(np.uint64)
                return self.skipped(keys[of], x >> (six + six), (x >> six) & low, x & low)

            first = len(self.tree.ids)
            part, full = self._segmented(some, own, np.fromiter(map(len, own), np.int64, len(own)), skip)
            ids += part
            nodes.update(zip((at + np.flatnonzero(full)).tolist(), range(first, len(self.tree.ids)), strict=True))
        return ids, nodes

    def _segmented(self, words: list[str], skips: list[tuple[int, ...]], size: np.ndarray, out_of) -> tuple[list[bytes], np.ndarray]:
        """Ids of words, and which of them skipped no more than ``size`` merges; these become nodes of the tree."""
        codes, places, heads = self._characters(words)
        met = np.zeros(len(words), np.int64)
        taken_of, taken = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]

        def skip(of, start, middle, stop):  # a word has one candidate at a time
            merge = (start << 12) | (middle << 6) | stop
            out = out_of(of, merge)
            after = ~out & (met[of] == size[of])
            taken_of.append(of[after])
            taken.append(merge[after])
            met[of[out]] += 1
            return out

        ids = self._merged(words, codes, places, skip)
        full = met == size
        owners, merges = np.concatenate(taken_of), np.concatenate(taken)
        order = np.argsort(owners, kind="stable")
        order = order[full[owners[order]]]
        which = np.flatnonzero(full)
        counts = np.bincount(owners, minlength=len(words))[which]
        some = which.tolist()
        self.tree.add([words[i] for i in some], [skips[i] for i in some], self.char_keys(codes, places, heads)[which], [ids[i] for i in some], counts, merges[order])
        return ids, full

    def _characters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters of the words, their places in the words, and where each word begins."""
        lengths = np.fromiter(map(len, words), np.int32, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        first = np.cumsum(lengths) - lengths
        return codes, np.arange(len(codes), dtype=np.int32) - np.repeat(first, lengths).astype(np.int32), first

    def _merged(self, words: list[str], codes: np.ndarray, start: np.ndarray, skip) -> list[bytes]:
        """Ids of many words: a round takes each word's best candidate, unless ``skip`` says otherwise."""
        of = (np.cumsum(start == 0) - 1).astype(np.int32)
        symbol = self.char_id[codes]
        strange = frozenset(np.unique(of[symbol < 0]).tolist())  # words with characters that have no piece
        stop = start + 1
        none = len(self.ids)
        made = np.full(len(symbol), len(self.bytes_of), np.int32)  # the piece a symbol makes with the next one of its word
        inside = np.flatnonzero((of[:-1] == of[1:]) & (symbol[:-1] >= 0) & (symbol[1:] >= 0))
        made[inside] = self._pieces(symbol[inside], symbol[inside + 1])
        rank = self.rank_of[made]
        out = [b""] * len(words)
        while True:
            ends = np.flatnonzero(of[1:] != of[:-1])
            heads = np.concatenate([[0], ends + 1])
            best = np.minimum.reduceat(rank, heads)
            counts = np.diff(heads, append=len(of))
            done = best == none
            if done.any():
                ended = np.repeat(done, counts)
                ids = symbol[ended].tobytes()
                at = 0
                for word, beyond in zip(of[heads[done]].tolist(), np.cumsum(4 * counts[done]).tolist(), strict=True):
                    out[word] = self._with_bytes(words[word], ids[at:beyond]) if word in strange else ids[at:beyond]
                    at = beyond
                if len(ids) == 4 * len(of):
                    return out
                symbol, of, start, stop, made, rank = (x[~ended] for x in (symbol, of, start, stop, made, rank))
                best, counts = best[~done], counts[~done]
            at = np.flatnonzero(rank == np.repeat(best, counts))
            own = of[at]
            at = at[np.concatenate([[True], own[1:] != own[:-1]])]
            skips = skip(of[at], start[at], start[at + 1], stop[at + 1])
            rank[at[skips]] = none
            at = at[~skips]
            if not len(at):
                continue
            symbol[at], stop[at] = made[at], stop[at + 1]
            left = np.ones(len(of), bool)
            left[at + 1] = False
            symbol, of, start, stop, made, rank = (x[left] for x in (symbol, of, start, stop, made, rank))
            at = at - np.arange(len(at))  # where the merged symbols stand now
            pair = np.concatenate([at, at[at > 0] - 1])
            last = pair + 1 == len(of)
            after = np.where(last, pair, pair + 1)
            alone = last | (of[after] != of[pair]) | (symbol[pair] < 0) | (symbol[after] < 0)
            rank[pair[alone]] = none
            pair = pair[~alone]
            made[pair] = self._pieces(symbol[pair], symbol[pair + 1])
            rank[pair] = self.rank_of[made[pair]]

    def _with_bytes(self, word: str, ids: bytes) -> bytes:
        """Ids with the bytes of each character that has no piece, -1 so far."""
        known, strange = np.frombuffer(ids, np.int32).tolist(), (c for c in word if self.char_id[ord(c)] < 0)
        return np.array([x for i in known for x in ([i] if i >= 0 else [self.byte_ids[b] for b in next(strange).encode()])], np.int32).tobytes()

    def _nodes(self, of: np.ndarray, times: np.ndarray, words, skips, numbers: np.ndarray, places: np.ndarray, ids: dict[int, bytes]) -> np.ndarray:
        """Nodes of occurrences, ``of`` saying which of the wanted nodes each needs and ``times`` how often that is.

        A node needed once is tried with the occurrence itself, whose ids go to ``ids`` (and -1 to the result) if it skips more.
        """
        made = np.full(len(times), -1, np.int64)
        often, once = np.flatnonzero(times > 1), np.flatnonzero(times == 1)
        if len(often):
            made[often] = self._grow(words(often), skips(often))
        if len(once):
            at = np.zeros(len(times), np.int64)
            at[of] = np.arange(len(of))
            at = at[once]
            tried, nodes = self._try(words(once), skips(once), numbers[at])
            made[once[list(nodes)]] = list(nodes.values())
            where = places[at].tolist()
            ids.update((where[i], tried[i]) for i in np.flatnonzero(made[once] < 0).tolist())
        return made[of]

    def _each(self, words: list[str], numbers: np.ndarray) -> list[bytes]:
        """Ids of occurrences of words, none of them long, each segmented by the hashes of its own number."""
        tree = self.tree = Tree()
        ids: dict[int, bytes] = {}
        open_ = np.arange(len(words))
        number_of: dict[str, int] = {}
        of = np.array([number_of.setdefault(w, len(number_of)) for w in words], np.int64)
        distinct = list(number_of)
        node = self._nodes(of, np.bincount(of, minlength=len(distinct)), lambda own: [distinct[i] for i in own.tolist()], lambda own: [()] * len(own),
                           numbers, open_, ids)
        keys = self.keyed(tree.own[node], numbers)
        open_ = open_[node >= 0] if self.limit else open_[:0]
        six, low = np.uint64(6), np.uint64(63)
        while len(open_):
            own = node[open_]
            counts = tree.count[own]
            heads = np.cumsum(counts) - counts
            owner = np.repeat(np.arange(len(open_)), counts)
            number = np.arange(len(owner)) - heads[owner]
            merge = tree.merges[tree.at[own][owner] + number].astype(np.uint64)
            at = np.flatnonzero(self.skipped(keys[open_][owner], merge >> (six + six), (merge >> six) & low, merge & low))
            if not len(at):
                break
            at = at[np.concatenate([[True], owner[at][1:] != owner[at][:-1]])]
            open_ = open_[owner[at]]
            children, of, times = np.unique(own[owner[at]] * 64 + number[at], return_inverse=True, return_counts=True)
            parents = (children >> 6).tolist()
            last = tree.merges[tree.at[children >> 6] + (children & 63)].tolist()
            node[open_] = self._nodes(of, times, lambda own, parents=parents: [tree.words[parents[i]] for i in own.tolist()],
                                      lambda own, parents=parents, last=last: [(*tree.skips[parents[i]], last[i]) for i in own.tolist()],
                                      numbers[open_], open_, ids)
            open_ = open_[node[open_] >= 0]
        out = [tree.ids[i] for i in node.tolist()] if tree.ids else [b""] * len(words)
        for i, own in ids.items():
            out[i] = own
        self.tree = Tree()
        return out

    def segment(self, word: str, number: int) -> list[int]:
        """Bounds of the symbols of ``word`` (blocks for blanks) when no candidate is left, by an agenda."""
        codes = np.frombuffer(word.encode("utf-32-le"), np.uint32)
        return self._by_agenda(word, self.word_keys(codes, np.arange(len(codes)), np.zeros(1, int), np.array([number]))[0])

    def _by_agenda(self, word: str, key: np.uint64) -> list[int]:
        rank, n = self.rank.get, len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the symbol that starts here
        agenda: list[tuple[int, int, int, int]] = []

        def push(start: int) -> None:
            middle = end[start]
            if middle < n and (r := rank(word[start:end[middle]])) is not None:
                heapq.heappush(agenda, (r, start, middle, end[middle]))

        for i in range(n - 1):
            push(i)
        while agenda:
            _, start, middle, stop = heapq.heappop(agenda)
            if end[start] != middle or end[middle] != stop or (self.limit and self.skipped(key, *np.array([start, middle, stop], np.uint64))):
                continue
            end[start], end[middle] = stop, 0
            if stop < n:
                before[stop] = start
                push(start)
            if before[start] >= 0:
                push(before[start])
        bounds, at = [0], 0
        while at < n:
            at = end[at]
            bounds.append(at)
        return bounds

    def word_ids(self, word: str, number: int) -> bytes:
        """Ids of a word, blocks for blanks, as 32-bit numbers."""
        if word == LITERAL:
            return np.array([self.byte_ids[x] for x in BLOCK.encode()], np.int32).tobytes()
        bounds = self.segment(word, number)
        out: list[int] = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            found = self.ids.get(word[a:b])
            out += [found] if found is not None else [self.byte_ids[x] for x in word[a:b].encode()]
        return np.array(out, np.int32).tobytes()

    def _words(self, text: str, doc: str) -> tuple[list[str], np.ndarray]:
        """The words of a text, blocks for blanks and a literal block as a word of its own, and their numbers."""
        if not text:
            return [], np.zeros(0, np.uint64)
        if BLOCK not in text and "  " not in text and text[0] != " ":  # single blanks: a word each
            words = list(filter(None, (BLOCK + text.replace(" ", " " + BLOCK).replace("\n", " \n ")).split(" ")))
        else:
            words = []
            for i, part in enumerate((" " + text).split(BLOCK)):
                words += ([LITERAL] if i else []) + WORD.findall(part.replace(" ", BLOCK))
        which = np.arange(len(words), dtype=np.uint64) * A + np.uint64(xxh64_intdigest(doc.encode(), self.seed & MASK))
        which = (which ^ (which >> np.uint64(31))) * D
        return words, which ^ (which >> np.uint64(33))

    def encode(self, texts: list[str], docs: list[str]) -> list[bytes]:
        """Ids of the texts as 32-bit numbers, one after another."""
        split = [self._words(text, doc) for text, doc in zip(texts, docs, strict=True)]
        words = [w for own, _ in split for w in own]
        numbers = np.concatenate([np.zeros(0, np.uint64), *[own for _, own in split]])
        ids: list[bytes] = []
        collecting = gc.isenabled()
        gc.disable()  # nothing here refers back to itself, and searching so many small objects for that takes long
        try:
            for at in range(0, len(words), TOGETHER):
                ids += self._occurrences(words[at:at + TOGETHER], numbers[at:at + TOGETHER])
        finally:
            if collecting:
                gc.enable()
        out, at = [], 0
        for own, _ in split:
            out.append(b"".join(ids[at:at + len(own)]))
            at += len(own)
        return out

    def _occurrences(self, words: list[str], numbers: np.ndarray) -> list[bytes]:
        odd = [i for i, w in enumerate(words) if not 0 < len(w) <= LONG_WORD]
        if not odd:
            return self._each(words, numbers)
        ids: list[bytes] = [b""] * len(words)
        for i in odd:
            ids[i] = self.word_ids(words[i], numbers[i])
        plain = np.delete(np.arange(len(words)), odd).tolist()
        for i, own in zip(plain, self._each([words[i] for i in plain], numbers[plain]) if plain else [], strict=True):
            ids[i] = own
        return ids

    def decode(self, ids: list[int]) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


_codecs: dict[tuple, Codec] = {}


def _codec(model: bytes, dropout: float = 0.0, seed: int = 0) -> Codec:
    """The codec of a model and setting; a Python process holds one, without segmentations."""
    key = (xxh64_intdigest(model), dropout, seed)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model, dropout, seed)
    return _codecs[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _encoded(codec: Codec, texts: pa.Array, docs: pa.Array) -> list[bytes]:
    """Ids of texts, some at a time."""
    made, part, size = [], ([], []), 0
    for text, name in zip(as_bytes(texts), docs.to_pylist(), strict=True):
        part[0].append(text.decode("utf-8", "replace"))
        part[1].append(name or "")
        size += len(text)
        if size >= SLICE:
            made += codec.encode(*part)
            part, size = ([], []), 0
    return made + codec.encode(*part)


def _lists(made: list[bytes], texts: pa.Array) -> pa.Array:
    """Ids as an array of lists, null for null texts."""
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in made])])
    values = pa.array(np.frombuffer(b"".join(made), np.int32))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(~np.array(texts.is_valid())))


def encode(df: DataFrame, doc: str = "doc_id", text: str = "text", ids: str = "ids", model: str = MODEL, dropout: float = 0.1,
           seed: int = 0) -> DataFrame:
    """``df`` with the ids of its texts."""
    shared = df.sparkSession.sparkContext.broadcast(_read(model))

    def run(texts, docs):
        return [_lists(_encoded(_codec(shared.value, dropout, seed), texts, docs), texts)]

    return add_columns(df, f"`{ids}` array<int>", run, col(text), col(doc).cast("string"))


def round_trip(df: DataFrame, doc: str = "doc_id", text: str = "text", ids: str = "ids", decoded: str = "decoded", model: str = MODEL,
               dropout: float = 0.1, seed: int = 0) -> DataFrame:
    """``df`` with the ids of its texts and the texts these ids decode to, in one pass."""
    shared = df.sparkSession.sparkContext.broadcast(_read(model))

    def run(texts, docs):
        codec = _codec(shared.value, dropout, seed)
        made = _encoded(codec, texts, docs)
        back = [codec.decode(np.frombuffer(x, np.int32).tolist()) if known else None
                for x, known in zip(made, texts.is_valid().to_pylist(), strict=True)]
        return [_lists(made, texts), pa.array(back, pa.string())]

    return add_columns(df, f"`{ids}` array<int>, `{decoded}` string", run, col(text), col(doc).cast("string"))


def decode(df: DataFrame, ids: str = "ids", text: str = "text", model: str = MODEL) -> DataFrame:
    """``df`` with the texts of its ids."""
    shared = df.sparkSession.sparkContext.broadcast(_read(model))

    def run(lists):
        codec = _codec(shared.value)
        values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
        return [pa.array([codec.decode(values[a:b].tolist()) if known else None
                          for a, b, known in zip(offsets, offsets[1:], lists.is_valid().to_pylist(), strict=False)], pa.string())]

    return add_columns(df, f"`{text}` string", run, col(ids))

