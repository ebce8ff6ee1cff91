"""Chat formatting into budgeted windows.

The turns of a conversation stream through one task in order. Prefix sums of their tokens choose
turn-aligned spans: a window holds the system turn, a limited repeated history and as many new turns as
the budget allows. Only new assistant turns lie under the loss mask, so each target counts once.
Memory per task is bounded by one window, whatever the length of a conversation.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: This template's marks.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Control strings of this and other public templates, after their first character: each gets one more
#: backslash there inside a text, so no text can contain one, and taking one away gives the text back.
_CONTROL = r"(?:\||/?INST\]|/?s>|</?SYS>>)"
_ESCAPE, _UNESCAPE = re.compile(rf"([<\[]\\*)({_CONTROL})"), re.compile(rf"([<\[]\\*)\\({_CONTROL})")
_TURN = re.compile(r"<\|turn\|>(.*?)<\|body\|>(.*?)<\|end\|>", re.S)
_TOKENS = re.compile(r"\w+|[^\w\s]")

WINDOWS = "window int, first_turn long, n_context int, n_new int, text string, loss_starts array<int>, loss_ends array<int>, n_tokens long, over_budget boolean"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def count_tokens(text: str) -> int:
    """Words and punctuation marks, and three for the template's marks."""
    return len(_TOKENS.findall(text)) + 3


class _Conversation:
    """Windows of one conversation, turn by turn."""

    def __init__(self, budget: int, history_turns: int, history_tokens: int):
        self.budget, self.turns_kept, self.tokens_kept = budget, history_turns, history_tokens
        self.system: tuple[str, str, int] | None = None
        self.context: list[tuple[str, str, int]] = []  # repeated turns of the open window, masked
        self.new: list[tuple[str, str, int]] = []
        self.used = self.seen = self.window = 0

    def add(self, role: str, text: str, tokens: int) -> dict | None:
        done = None
        if self.new and self.used + tokens > self.budget:
            done = self.close()
            self._open(tokens)
        self.new.append((role, text, tokens))
        if not self.seen and role == "system":
            self.system = self.new[0]
        self.used, self.seen = self.used + tokens, self.seen + 1
        return done

    def _open(self, need: int) -> None:
        """Starts the next window with the system turn and the longest tail of turns that leaves room for `need` tokens."""
        tail = [t for t in [*self.context, *self.new] if t is not self.system][-self.turns_kept :] if self.turns_kept else []
        fixed = [self.system] if self.system else []
        room = min(self.tokens_kept, self.budget - need - sum(t[2] for t in fixed))
        sums = [0]
        for t in tail:
            sums.append(sums[-1] + t[2])
        tail = tail[bisect_left(sums, sums[-1] - room) :] if room > 0 else []
        self.context, self.new = fixed + tail, []
        self.used = sum(t[2] for t in self.context)

    def close(self) -> dict:
        parts, starts, ends, at = [], [], [], 0
        for k, (role, text, _) in enumerate([*self.context, *self.new]):
            head, body = f"{TURN}{escape(role)}{BODY}", escape(text)
            if k >= len(self.context) and role == "assistant":
                starts.append(at + len(head))
                ends.append(at + len(head) + len(body))
            parts += head, body, END
            at += len(head) + len(body) + len(END)
        row = {
            "window": self.window, "first_turn": self.seen - len(self.new), "n_context": len(self.context), "n_new": len(self.new), "text": "".join(parts),
            "loss_starts": starts, "loss_ends": ends, "n_tokens": self.used, "over_budget": self.used > self.budget,
        }
        self.window += 1
        return row


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def format_chats(conversations: DataFrame, budget: int = 1024, history_turns: int = 2, history_tokens: int = 256, counter: Callable[[str], int] = count_tokens) -> DataFrame:
    """(conv_id, window, first_turn, n_context, n_new, text, loss_starts, loss_ends, n_tokens, over_budget), a row per window.

    Turns go by `turn` (nulls first), ties by role, then text. Null roles and texts are empty. A null
    conv_id is a conversation of its own. Repeated rows are turns of their own. A turn over the budget
    gets a window alone but for the system turn, marked over_budget; nothing is cut. Loss spans count
    code points of `text`. The windows of a conversation stand in order in one partition. Extra columns don't go on.
    An empty table gives no rows.
    """
    kind = dict(conversations.dtypes)["conv_id"]
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.DataType] = []

        def windows() -> Iterator[dict]:
            open_id, open_chat = None, None
            for batch in batches:
                ids[:] = [batch.schema.field("conv_id").type]
                columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]
                for conv_id, role, text in zip(*columns, strict=True):
                    if open_chat is None or conv_id != open_id:
                        if open_chat is not None:
                            yield {"conv_id": open_id, **open_chat.close()}
                        open_id, open_chat = conv_id, _Conversation(budget, history_turns, history_tokens)
                    if done := open_chat.add(role, text, counter(text)):
                        yield {"conv_id": conv_id, **done}
            if open_chat is not None:
                yield {"conv_id": open_id, **open_chat.close()}

        stream = windows()
        first = next(stream, None)
        if first is None:
            return
        ints = pa.list_(pa.int32())
        schema = pa.schema([("conv_id", ids[0]), ("window", pa.int32()), ("first_turn", pa.int64()), ("n_context", pa.int32()), ("n_new", pa.int32()), ("text", pa.string()), ("loss_starts", ints), ("loss_ends", ints), ("n_tokens", pa.int64()), ("over_budget", pa.bool_())])

        def again() -> Iterator[dict]:
            yield first
            yield from stream

        yield from _batches(again(), schema)

    return rows.mapInArrow(run, f"conv_id {kind}, {WINDOWS}")


def read_turns(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    return [(unescape(role), unescape(body)) for role, body in _TURN.findall(text)]


def digest_chats(windows: DataFrame) -> DataFrame:
    """A row per conversation, all read back from the windows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows.

    Expects the windows of a conversation in order in one partition, as `format_chats` leaves them.
    """
    kind = dict(windows.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.DataType] = []

        def rows() -> Iterator[dict]:
            row, turns, loss = None, None, None
            for batch in batches:
                ids[:] = [batch.schema.field("conv_id").type]
                for conv_id, window, skip, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "window", "n_context", "text", "loss_starts", "loss_ends")), strict=True):
                    if window == 0:
                        if row:
                            yield row | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}
                        row, turns, loss = {"conv_id": conv_id, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0, "n_windows": 0}, hashlib.sha256(), hashlib.sha256()
                    new = read_turns(text)[skip:]
                    for role, said in new:
                        turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    for a, b in zip(starts, ends, strict=True):
                        under = unescape(text[a:b])
                        loss.update(under.encode("utf-8", "surrogatepass"))
                        row["loss_chars"] += len(under)
                    row["n_turns"] += len(new)
                    row["formatted_chars"] += len(text)
                    row["n_windows"] += 1
            if row:
                yield row | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}

        stream = rows()
        first = next(stream, None)
        if first is None:
            return
        schema = pa.schema([("conv_id", ids[0]), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])

        def again() -> Iterator[dict]:
            yield first
            yield from stream

        yield from _batches(again(), schema, 4096)

    return windows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
