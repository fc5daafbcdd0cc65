"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of its turns are intersected with the
token spans by binary search: a token is under the mask if it shares a character with an assistant's text.

A turn is `<turn>role`, a line end, the text, a line end, `</turn>` and a line end. In roles and texts a backslash is
doubled and the two control strings get a backslash before them, so no text can forge a mark and everything reads back.

Rows are dealt by conversation and sorted by turn, so a task streams over them, however long a conversation is: beyond
SEGMENT characters it is given out in several rows, each of whole turns, so that no row outgrows memory. The vocabulary's pre-tokenizer always breaks there (a line end
before `<`), so the segments' ids are the ids of the whole.

Defined results: null role or text is empty; rows of one turn number go by role, then text; a null turn comes first;
rows without a conv_id are one conversation; a repeated row is a turn of its own; a very long text is one turn; an empty table gives no conversation; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import vocabulary

OPEN, CLOSE = "<turn>", "</turn>"
SEGMENT = 4_000_000
FORMATTED = "conv_id long, segment int, formatted string, ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>, turn_starts array<int>, turn_ends array<int>"
CONTROL = re.compile(r"\\|</?turn>")
ESCAPED = re.compile(r"\\(\\|</?turn>)")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


def escape_role(role: str) -> str:
    """As escape; line ends become a backslash and `n`, since a role ends at one."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|</?turn>|n)", lambda m: "\n" if m[1] == "n" else m[1], role)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of turns (role, text), and the span that each escaped text has there."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"\n{CLOSE}\n"]
        at = spans[-1][1] + len(CLOSE) + 2
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text: the inverse of render."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(f"\n{CLOSE}\n", line)
        turns.append((unescape_role(formatted[at + len(OPEN) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(CLOSE) + 2
    return turns


def masked(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens (with ascending offsets) share a character with one of the sorted spans."""
    mask = np.zeros(len(starts), dtype=bool)
    for a, b in spans:
        if a < b:
            # the first token that ends after a, to the last that starts before b
            mask[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = True
    return mask


def encode(path: str, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and the characters where each begins and ends, in one encoding; added tokens' names are ordinary text.

    A token's bytes are known, so spans of bytes follow from a running sum; a token that has part of a character's bytes
    has that character.
    """
    own, sizes = vocabulary(path)
    ids = own.encode_to_numpy(text, disallowed_special=())
    if not len(ids):
        return ids, np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(sizes[ids])
    return ids, character[ends - sizes[ids]], character[ends - 1] + 1


def format_conversations(rows: DataFrame, tokenizer_path: str, loss_role: str = "assistant") -> DataFrame:
    """rows (conv_id, turn, role, text) rendered and encoded, a row per conversation and segment, in order."""

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        size = 0

        def finish(conv_id, segment: int, turns: list[tuple[str, str]]) -> None:
            nonlocal size
            text, spans = render(turns)
            ids, starts, ends = encode(tokenizer_path, text)
            mask = masked(starts, ends, [s for s, (role, _) in zip(spans, turns, strict=True) if role == loss_role])
            waiting.append((conv_id, segment, text, ids.astype("int32"), starts.astype("int32"), ends.astype("int32"), mask, [s[0] for s in spans], [s[1] for s in spans]))
            size += len(text)

        def flush() -> pa.RecordBatch:
            nonlocal size
            ints = pa.list_(pa.int32())
            kinds = [pa.int64(), pa.int32(), pa.string(), ints, ints, ints, pa.list_(pa.bool_()), ints, ints]
            columns = [pa.array(c, k) for c, k in zip(zip(*waiting, strict=True), kinds, strict=True)]
            waiting.clear()
            size = 0
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in FORMATTED.split(", ")])

        turns: list[tuple[str, str]] = []
        now, segment, chars = None, 0, 0
        for batch in batches:
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if turns and (conv_id != now or chars > SEGMENT):
                    finish(now, segment, turns)
                    segment, turns, chars = segment + 1, [], 0
                if conv_id != now:
                    segment = 0
                now = conv_id
                turns.append((role, text))
                chars += len(text) + len(role)
                if size > 2_000_000:
                    yield flush()
        if turns:
            finish(now, segment, turns)
        if waiting:
            yield flush()

    clean = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    dealt = clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(formatted, FORMATTED)


def loss_text(formatted: str, starts: list[int], ends: list[int], mask: list[bool], spans: list[tuple[int, int]]) -> str:
    """The characters under the loss mask: those of masked tokens that are inside a turn's text, unescaped by turn.

    A token may reach over the edge of a text; what it has beyond belongs to a mark. Spans of turns without a masked
    token have no text here.
    """
    starts_, ends_, on = np.asarray(starts), np.asarray(ends), np.asarray(mask, dtype=bool)
    starts_, ends_ = starts_[on], ends_[on]
    parts = []
    for a, b in spans:
        i, j = np.searchsorted(ends_, a, "right"), np.searchsorted(starts_, b, "left")
        if i < j:
            parts.append(unescape(formatted[max(a, int(starts_[i])) : min(b, int(ends_[j - 1]))]))
    return "".join(parts)


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame, in_order: bool = True) -> DataFrame:
    """What the formatted conversations hold, parsed from the output: a row per conversation. in_order: each conversation's
    segments follow one another, as format_conversations gives them; a table read from storage may have lost that order."""
    if not in_order:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None
        done: list[list] = []

        def emit() -> pa.RecordBatch:
            out = [(c, n, t.hexdigest(), k, x.hexdigest(), f) for c, n, t, k, x, f in done]
            done.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in READ_BACK.split(", ")])

        for batch in batches:
            for row in batch.to_pylist():
                if row["segment"] == 0:
                    if now:
                        done.append(now)
                    now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                elif not now or now[0] != row["conv_id"]:
                    raise ValueError("segments are out of order: pass in_order=False")
                for role, text in parse(row["formatted"]):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                text = loss_text(row["formatted"], row["token_starts"], row["token_ends"], row["loss_mask"], list(zip(row["turn_starts"], row["turn_ends"], strict=True)))
                now[3] += len(text)
                now[4].update(text.encode())
                now[5] += len(row["formatted"])
            if len(done) > 1000:
                yield emit()
        if now:
            done.append(now)
        if done:
            yield emit()

    return formatted.mapInArrow(read, READ_BACK)
