"""Structure repair of conversations by Four-Russians block tables.

A conversation's rows, in the order of turn, role and text, are edited at the least cost into turns whose role initials
are ``(s?(ua)+)?``: a row is kept (K, 0), given the role user or assistant (R, 1) or deleted (D, 2), an empty turn is
inserted (I, 5).  Blank rows and repeats must go; a truncated row that stays costs 5 more.  Of equally cheap
scripts the one of the ASCII-least letters is taken.

What the rows from some place on still cost depends on what stands before: nothing, s, u or a.  These four costs, less
their least, are a state; there are few states, as one of the four can be reached from any other by a bounded cost.  A row
is one of nine symbols, and tables made once give, for each state and each block of ``BLOCK`` symbols, the state before
the block, the costs that were taken off, and where each of the four goes on after the block.  Rows are read backward by block look-ups;
then a block at a time is expanded by the tables of single symbols and traced from its front, where the least letter
on a cheapest way is always known, so that ties are broken as defined.

The rows are sorted by range over all conversations, so a conversation of any size is spread over tasks, and cut into
segments of at most ``SEGMENT`` rows.  A segment is read for all states at once; the segments of a conversation then
pass on one state each, as a stream of small rows.  Editing streams each conversation's rows in order, one segment at a
time, since a digest and an edit script are sequences; a task holds a segment's texts, not a conversation's.

Defined results: null roles and texts are one space; a null conversation id is an id of its own; rows of equal turn
stand in the order of role, then text, null turns first; equal rows are one row and its repeats; roles of other
initials than s, u and a are never kept; an empty conversation table gives an empty result; columns other than the four named
are not read; very long texts are carried, not searched, by Python.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabscope.functions.columns import col
from tabscope.plans.stored import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows of a block that is looked up at once, and of a segment.
BLOCK, SEGMENT = 4, 1024
#: Symbols of rows: one that must go, then the role's initial (s, u, a, another), then the same truncated.
GONE, PLAIN, CUT_OFF = 0, 1, 5
INITIALS = "sua"
SYMBOLS = 9
#: What stands before: nothing, s, u, a; where an initial leads from there, and the turn that can be inserted.
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
COST = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}


def step(costs: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """Costs of a row and what follows it, by what stands before, and the least letters of a cheapest way past the row."""
    initial = None if symbol == GONE else INITIALS[(symbol - 1) % 4] if (symbol - 1) % 4 < 3 else ""
    extra = TRUNCATED if symbol >= CUT_OFF else 0

    def past(before: int) -> list[tuple[int, str]]:
        """Ways past the row that insert nothing."""
        ways = [(DELETE + costs[before], "D")]
        if initial is not None:
            if initial in AFTER[before]:
                ways.append((KEEP + extra + costs[AFTER[before][initial]], "K"))
            ways.append((REROLE + extra + costs[AFTER[before][NEXT[before]]], "R"))
        return ways

    least = [min(past(before))[0] for before in range(4)]
    for _ in range(3):
        least = [min(own, INSERT + least[AFTER[before][NEXT[before]]]) for before, own in enumerate(least)]
    letters = []
    for before in range(4):
        script = ""
        while True:
            ways = [letter for cost, letter in past(before) if cost == least[before]]
            onward = AFTER[before][NEXT[before]]
            if INSERT + least[onward] == least[before]:
                ways.append("I")
            script += min(ways)
            if script[-1] != "I":
                break
            before = onward
        letters.append(script)
    return tuple(least), tuple(letters)


def beyond(before: int, letters: str, symbol: int) -> int:
    """What stands before the next row, after the letters of one row."""
    for letter in letters:
        if letter in "IR":
            before = AFTER[before][NEXT[before]]
        elif letter == "K":
            before = AFTER[before][INITIALS[(symbol - 1) % 4]]
    return before


@dataclass(frozen=True)
class Tables:
    """States by number, 0 after the last row; transitions of single symbols and of blocks."""

    costs: list[tuple[int, ...]]
    state: np.ndarray  # states x symbols: the state before a symbol
    off: np.ndarray  # what was taken off the costs there
    letters: list[list[tuple[str, ...]]]  # by the state after a symbol, the symbol and what stands before it
    block_state: np.ndarray  # states x blocks
    block_off: np.ndarray


@lru_cache(maxsize=1)
def tables() -> Tables:
    # after the last row: nothing or a whole exchange ends the conversation, an u lacks its answer, an s both
    known = {(0, 2 * INSERT, INSERT, 0): 0}
    state, off, letters = [], [], []
    at = 0
    while at < len(known):
        costs = list(known)[at]
        made = [step(costs, symbol) for symbol in range(SYMBOLS)]
        off.append([min(c) for c, _ in made])
        state.append([known.setdefault(tuple(x - min(c) for x in c), len(known)) for c, _ in made])
        letters.append([own for _, own in made])
        at += 1
    one, less = np.array(state), np.array(off)
    block_state, block_off = one, less
    for _ in range(BLOCK - 1):  # a symbol more in front
        n = block_state.shape[1]
        block_off = (block_off[:, None, :] + less[block_state].transpose(0, 2, 1)).reshape(len(one), -1)
        block_state = one[block_state].transpose(0, 2, 1).reshape(len(one), SYMBOLS * n)
    return Tables(list(known), one, less, letters, block_state, block_off)


def blocks(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols before the first whole block, and the numbers of the blocks after them."""
    head = len(symbols) % BLOCK
    digits = symbols[head:].reshape(-1, BLOCK)
    return symbols[:head], digits @ (SYMBOLS ** np.arange(BLOCK)[::-1])


def read_backward(symbols: np.ndarray, state):
    """The states before the symbols, and what was taken off, from states after them; of a number or an array."""
    own = tables()
    head, numbers = blocks(symbols)
    off = 0
    for number in numbers[::-1]:
        off = off + own.block_off[state, number]
        state = own.block_state[state, number]
    for symbol in head[::-1]:
        off = off + own.off[state, symbol]
        state = own.state[state, symbol]
    return state, off


def traced(symbols: np.ndarray, state: int, before: int) -> tuple[list[str], int]:
    """The letters of each row, and what stands before the rows after them."""
    own = tables()
    head, numbers = blocks(symbols)
    # states after each block, and after the symbols before the first block
    after = [state]
    for number in numbers[::-1]:
        after.append(int(own.block_state[after[-1], number]))
    script = []
    parts = [head, *symbols[len(head):].reshape(-1, BLOCK)]
    for part, end in zip(parts, after[::-1], strict=True):
        inner = [end]
        for symbol in part[:0:-1]:
            inner.append(int(own.state[inner[-1], symbol]))
        for symbol, at in zip(part.tolist(), inner[::-1], strict=False):
            letters = own.letters[at][symbol][before]
            script.append(letters)
            before = beyond(before, letters, symbol)
    return script, before


def last_letters(before: int) -> str:
    """What is inserted after the last row."""
    return {0: "", 1: "II", 2: "I", 3: ""}[before]


def fault_of(role: Column, text: Column) -> tuple[Column, Column]:
    """Whether a row is blank, and whether its last character that is not white space ends no sentence."""
    blank = ~F.regexp(text, F.lit(r"[^\x20\x09-\x0D]"))
    # the last characters alone, as a pattern over the whole text would try every place
    last = F.right(F.rtrim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), F.lit(1))
    return blank, ~last.isin(".", "!", "?")


def faults(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text, n, blank, repeat, truncated): distinct rows, how often each stands, and its faults.

    ``repeat`` says whether the row stands at an earlier turn, too; of ``n`` equal rows all but the first are repeats anyway.
    """
    def text_of(name: str) -> Column:
        return F.coalesce(col(name).cast("string"), F.lit(" ")).alias(name)

    rows = turns.select(F.to_json(F.struct(col("conv_id").alias("id"))).alias("conv"), "turn", text_of("role"), text_of("text"))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    rows = rows.withColumn("digest", digest)
    # stored, so that Spark knows the size: few are broadcast, many are joined by a shuffle
    again = stored(rows.groupBy("conv", "digest").agg(F.count("*").alias("times"), F.min(F.struct("turn")).alias("first")).where("times > 1").select(
        F.col("conv").alias("of_conv"), F.col("digest").alias("of_digest"), F.col("first.turn").alias("first_turn")), "repeated-turns")
    joined = rows.join(again, (F.col("conv") == F.col("of_conv")) & (F.col("digest") == F.col("of_digest")), "left")
    names = ("conv", "turn", "role", "text")
    single = joined.where("of_conv IS NULL").select(*names, F.lit(1).cast("bigint").alias("n"), F.lit(False).alias("repeat"))
    several = joined.where("of_conv IS NOT NULL").groupBy(*names, "first_turn").agg(F.count("*").alias("n")).select(
        *names, "n", (~F.col("turn").eqNullSafe(F.col("first_turn"))).alias("repeat"))
    blank, cut_off = fault_of(F.col("role"), F.col("text"))
    return single.unionByName(several).withColumn("blank", blank).withColumn("truncated", cut_off)


SEGMENTS = pa.schema([
    ("conv", pa.string()), ("segment", pa.int64()), ("place", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("symbol", pa.int32()),
    ("n", pa.int64()), ("states", pa.list_(pa.int32()))])
ROWS = "conv string, segment bigint, place int, role string, text string, symbol int, n bigint, states array<int>"


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row.get("text") or "")
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    return (row for batch in batches for row in batch.to_pylist())


def symbol_of(row: dict) -> int:
    if row["blank"] or row["repeat"]:
        return GONE
    initial = INITIALS.find(row["role"][:1]) if row["role"] else -1
    return (CUT_OFF if row["truncated"] else PLAIN) + (initial if initial >= 0 else 3)


def segments(rows: DataFrame) -> DataFrame:
    """Rows of ``faults`` in order, cut into segments; a segment's first row has, for each state after it, the one before."""
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for _, own in itertools.groupby(_rows(batches), key=lambda r: r["conv"]):
            while held := list(itertools.islice(own, SEGMENT)):
                symbols = np.array([symbol_of(r) for r in held])
                states = read_backward(symbols, np.arange(len(tables().costs)))[0]
                for place, (row, symbol) in enumerate(zip(held, symbols.tolist(), strict=True)):
                    yield {"conv": row["conv"], "segment": number, "place": place, "role": row["role"], "text": row["text"], "symbol": symbol,
                           "n": row["n"], "states": None if place else states.tolist()}
                number += 1

    ordered = rows.repartitionByRange("conv", "turn", "role", "text").sortWithinPartitions("conv", "turn", "role", "text")
    return ordered.mapInArrow(lambda batches: _batches(numbered(batches), SEGMENTS), ROWS)


def end_states(parts: DataFrame) -> DataFrame:
    """(conv, segment, end): the state after each segment, passed on from the last one."""
    schema = pa.schema([("conv", pa.string()), ("segment", pa.int64()), ("end", pa.int32())])

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for _, own in itertools.groupby(_rows(batches), key=lambda r: r["conv"]):
            state = 0
            for row in own:
                yield {"conv": row["conv"], "segment": row["segment"], "end": state}
                state = row["states"][state]

    ordered = parts.where("place = 0").select("conv", "segment", "states").repartition("conv").sortWithinPartitions("conv", F.desc("segment"))
    return ordered.mapInArrow(lambda batches: _batches(passed(batches), schema), "conv string, segment bigint, `end` int")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[dict]]]:
    """Conversations with their edits in order: letter, role, text and whether a row stands illegally after the one before."""
    def edits(own: Iterator[dict]) -> Iterator[dict]:
        before, last = 0, None
        for _, rows in itertools.groupby(own, key=lambda r: r["segment"]):
            end = next(rows)["end"]
            held = list(rows)
            script, onward = traced(np.array([r["symbol"] for r in held]), end, before)
            for row, letters in zip(held, script, strict=True):
                initial = row["role"][:1]
                for letter in letters:
                    after = before if letter == "D" else AFTER[before][initial if letter == "K" else NEXT[before]]
                    role = None if letter == "D" else row["role"] if letter == "K" else ROLES[NEXT[before]]
                    yield {"edit": letter, "role": role, "text": "" if letter == "I" else row["text"] if letter != "D" else None,
                           "cost": COST[letter] + (TRUNCATED if letter in "KR" and row["symbol"] >= CUT_OFF else 0),
                           "illegal": letter != "I" and last is not None and last + initial not in ("su", "ua", "au")}
                    last = last if letter == "I" else initial
                    before = after
                for _ in range(row["n"] - 1):  # equal rows after the first
                    yield {"edit": "D", "role": None, "text": None, "cost": DELETE, "illegal": True}
            assert before == onward
        for letter in last_letters(before):
            yield {"edit": letter, "role": ROLES[NEXT[before]], "text": "", "cost": INSERT, "illegal": False}
            before = AFTER[before][NEXT[before]]

    for conv, own in itertools.groupby(_rows(batches), key=lambda r: r["conv"]):
        yield conv, edits(own)


class Repair:
    """The faults and the cheapest repair of a table of conversations (conv_id, turn, role, text)."""

    def __init__(self, turns: DataFrame):
        self.turns = turns
        self.rows = stored(faults(turns), "turn-faults")
        parts = stored(segments(self.rows), "turn-segments")
        ends = end_states(parts)
        # each segment's end state stands before its rows
        marks = ends.select("conv", "segment", F.lit(-1).alias("place"), *[F.lit(None).cast(t).alias(c) for c, t in (
            ("role", "string"), ("text", "string"), ("symbol", "int"), ("n", "bigint"))], "end")
        both = marks.unionByName(parts.drop("states").withColumn("end", F.lit(None).cast("int")))
        self._ordered = both.repartition("conv").sortWithinPartitions("conv", "segment", "place")

    def edits(self) -> DataFrame:
        """(conv, number, edit, role, text, cost, illegal): all edits in order; the repaired turns are those but D."""
        schema = pa.schema([("conv", pa.string()), ("number", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()),
                            ("cost", pa.int64()), ("illegal", pa.bool_())])
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _batches(({"conv": conv, "number": i, **edit} for conv, own in _edited(batches) for i, edit in enumerate(own)), schema)

        return self._ordered.mapInArrow(run, "conv string, number bigint, edit string, role string, text string, cost bigint, illegal boolean")

    def audits(self) -> DataFrame:
        """(conv, audit, cost, illegal, repaired_sha256) of each conversation, from the same edits as a stream."""
        schema = pa.schema([("conv", pa.string()), ("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()), ("repaired_sha256", pa.string())])

        def summary(conv: str, own: Iterator[dict]) -> dict:
            digest, audit, cost, illegal, mark = hashlib.sha256(), bytearray(), 0, 0, ""
            for edit in own:
                audit += edit["edit"].encode()
                cost += edit["cost"]
                illegal += edit["illegal"]
                if edit["edit"] != "D":
                    digest.update(f"{mark}{edit['role']}:{edit['text']}".encode())
                    mark = "\n"
            return {"conv": conv, "audit": audit.decode(), "cost": cost, "illegal": illegal, "repaired_sha256": digest.hexdigest()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _batches((summary(conv, own) for conv, own in _edited(batches)), schema)

        return self._ordered.mapInArrow(run, "conv string, audit string, cost bigint, illegal bigint, repaired_sha256 string")

    def counts(self) -> DataFrame:
        """(conv, gaps, blank, duplicate, truncated) of each conversation; a row's first fault counts."""
        first = ~F.col("blank") & ~F.col("repeat")
        duplicates = F.when(F.col("blank"), 0).when(F.col("repeat"), F.col("n")).otherwise(F.col("n") - 1)
        turns = self.rows.groupBy("conv", "turn").agg(
            F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"), F.sum(duplicates).alias("duplicate"),
            F.sum((first & F.col("truncated")).cast("bigint")).alias("truncated"))
        return turns.groupBy("conv").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"),
            *[F.sum(c).cast("bigint").alias(c) for c in ("blank", "duplicate", "truncated")])
