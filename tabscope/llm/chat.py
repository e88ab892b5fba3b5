"""Chat formatting in windows of a token budget.

Prefix sums of the turns' tokens choose spans of whole turns.  Every turn is fresh in exactly one window, the loss covers
the fresh assistant texts alone; a later window starts with the conversation's system turn (its first turn, if of that
role) and with the last turns before its span that fit ``history`` tokens, all of them masked.  A turn is never cut:
one of more tokens than fit stands alone in a window beyond the budget.

A turn is written as ``<s>[INST] role [/INST]text</s>``.  Where a role or a text holds one of these control strings, a
backslash after its first character sets it apart (one more than stands there already), which is taken out on reading.

Long conversations are cut at multiples of ``SEGMENT`` budgets of the prefix sum, and the turns of a segment, with the
few before it that can be its history, are formatted as a stream of sorted rows: a task holds one window, not a conversation.

Defined results: null texts and roles are empty ones; a null conversation id is an id of its own; turns stand in the
order of their number (null first), then role, then text, so ties and repeated rows are kept in a fixed order; an empty
conversation table gives an empty result; columns other than the four named are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window, functions as F

from tabscope.functions.columns import col

#: The template's control strings.
BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Tokens that the template adds to a turn, at most.
MARKS = 16
SEGMENT = 64

CONTROL = re.compile(r"([<\[])(\\*)(s>|/s>|INST\]|/INST\])")
ESCAPED = re.compile(r"([<\[])\\(\\*)(s>|/s>|INST\]|/INST\])")
TURN = re.compile(re.escape(BEGIN + OPEN) + " (.*?) " + re.escape(CLOSE) + "(.*?)" + re.escape(END), re.DOTALL)

TURNS = "conv string, place bigint, role string, text string, tokens bigint, segment bigint, fresh boolean, system struct<role: string, text: string, tokens: bigint>"
WINDOWS = ("conv string, segment bigint, number bigint, first_place bigint, formatted string, n_tokens bigint, n_context int, "
           "loss array<struct<first: bigint, beyond: bigint>>")


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def formatted_turn(role: str, text: str) -> tuple[str, int]:
    """A turn as written, and where its text starts."""
    head = f"{BEGIN}{OPEN} {escape(role)} {CLOSE}"
    return head + escape(text) + END, len(head)


def window_of(context: list[dict], fresh: list[dict]) -> dict:
    """A window's text, tokens and loss: spans of the fresh assistant texts."""
    out, loss, at = [], [], 0
    for i, turn in enumerate([*context, *fresh]):
        written, start = formatted_turn(turn["role"], turn["text"])
        if i >= len(context) and turn["role"] == "assistant":
            loss.append({"first": at + start, "beyond": at + len(written) - len(END)})
        out.append(written)
        at += len(written)
    return {"formatted": "".join(out), "n_tokens": sum(t["tokens"] for t in (*context, *fresh)), "n_context": len(context), "loss": loss}


def windows_of(turns: Iterator[dict], budget: int, history: int) -> Iterator[dict]:
    """Windows of the sorted turns of one segment; those not fresh come first and are history only."""
    before: list[dict] = []  # the latest turns, as many as can be history
    span: list[dict] = []
    context: list[dict] = []
    room = number = 0

    def closed():
        return window_of(context, span) | {"number": number, "first_place": span[0]["place"]}

    for turn in turns:
        if turn["fresh"]:
            if span and turn["tokens"] > room:
                yield closed()
                span, number = [], number + 1
            if not span:
                system = turn["system"]
                context = [system | {"place": 0}] if system and turn["place"] > 0 else []
                left = min(history, budget - turn["tokens"] - sum(t["tokens"] for t in context))
                tail: list[dict] = []
                for old in reversed(before):
                    if old["tokens"] > left or (system and old["place"] == 0):
                        break
                    tail.append(old)
                    left -= old["tokens"]
                context += tail[::-1]
                room = budget - sum(t["tokens"] for t in context)
            span.append(turn)
            room -= turn["tokens"]
        before.append(turn)
        held = sum(t["tokens"] for t in before)
        while held > history and before:
            held -= before.pop(0)["tokens"]
    if span:
        yield closed()


def _tokens(model: bytes):
    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = sentencepiece.SentencePieceProcessor(model_proto=model)
        for texts in batches:
            yield pd.Series([len(ids) for ids in codec.encode(texts.tolist(), num_threads=1)], dtype="int64")
    return count


def turns_of(df: DataFrame, budget: int, history: int, conv: str, turn: str, role: str, text: str, model: str) -> DataFrame:
    """Turns with their place, tokens, segment and system turn, and copies of those that can be the next segment's history."""
    with open(model, "rb") as file:
        count = _tokens(file.read())
    rows = df.select(F.to_json(F.struct(col(conv).alias("id"))).alias("conv"), col(turn).alias("turn"),
                     F.coalesce(col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", count("text") + MARKS)
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.select(
        "conv", "role", "text", "tokens", (F.row_number().over(order) - 1).cast("bigint").alias("place"), F.sum("tokens").over(running).alias("sum"),
        F.first(F.when(F.col("role") == "system", F.struct("role", "text", "tokens"))).over(running).alias("system"))
    stride = SEGMENT * budget
    placed = placed.withColumn("segment", F.expr(f"(sum - tokens) div {stride}"))
    # a turn that ends within ``history`` tokens of the next segment's first turn, or beyond, may be its history
    late = F.col("sum") > (F.col("segment") + 1) * stride - history
    own = F.struct(F.col("segment").alias("segment"), F.lit(True).alias("fresh"))
    copy = F.struct((F.col("segment") + 1).alias("segment"), F.lit(False).alias("fresh"))
    both = F.when(late, F.array(own, copy)).otherwise(F.array(own))
    return placed.select("conv", "place", "role", "text", "tokens", F.explode(both).alias("of"), "system").select(
        "conv", "place", "role", "text", "tokens", F.col("of.segment").alias("segment"), F.col("of.fresh").alias("fresh"), "system")


def formatted(df: DataFrame, budget: int = 2048, history: int = 512, conv: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text", model: str = MODEL) -> DataFrame:
    """One row per window: the conversation (its id as JSON), segment, number in it, place of its first fresh turn, the
    text, its tokens, how many of its turns are context, and the spans (characters) under the loss."""
    turns = turns_of(df, budget, history, conv, turn, role, text, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for made in _batched(({"conv": key[0], "segment": key[1]} | w
                              for key, own in itertools.groupby(rows, key=lambda r: (r["conv"], r["segment"]))
                              for w in windows_of(own, budget, history))):
            yield made

    ordered = turns.repartition("conv", "segment").sortWithinPartitions("conv", "segment", "place")
    return ordered.mapInArrow(run, WINDOWS)


WINDOW_TYPE = pa.schema([("conv", pa.string()), ("segment", pa.int64()), ("number", pa.int64()), ("first_place", pa.int64()),
                         ("formatted", pa.string()), ("n_tokens", pa.int64()), ("n_context", pa.int32()),
                         ("loss", pa.list_(pa.struct([("first", pa.int64()), ("beyond", pa.int64())])))])


def _batched(rows: Iterator[dict], schema: pa.Schema = WINDOW_TYPE, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Batches of rows, of about ``size`` characters of text each."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += 200 + len(row.get("formatted", ""))
        if chars >= size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def read_turns(formatted_text: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in TURN.findall(formatted_text)]


SUMMARY = pa.schema([("conv", pa.string()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from its windows alone: turns, a digest of them, the text under the loss and a digest of it."""
    def summary(conv: str, rows: Iterator[dict]) -> dict:
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = loss_chars = chars = count = 0
        for row in rows:
            text = row["formatted"]
            for role, body in read_turns(text)[row["n_context"]:]:
                turns.update(f"{role}\n{body}\n".encode())
                n += 1
            for span in row["loss"]:
                target = unescape(text[span["first"]:span["beyond"]])
                loss.update(target.encode())
                loss_chars += len(target)
            chars += len(text)
            count += 1
        return {"conv": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars,
                "loss_sha256": loss.hexdigest(), "formatted_chars": chars, "n_windows": count}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        yield from _batched((summary(conv, own) for conv, own in itertools.groupby(rows, key=lambda r: r["conv"])), SUMMARY)

    # a digest takes its conversation's windows one after another: they are streamed, not gathered
    ordered = windows.repartition("conv").sortWithinPartitions("conv", "first_place")
    return ordered.mapInArrow(run, "conv string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint")
