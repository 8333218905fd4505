"""Chat formatting in budgeted windows.

A conversation's turns are cut into windows of whole turns. Prefix sums of the turns' token counts choose them: a
window takes new turns while system turn, repeated history and new turns together stay within the budget. Every
window after the first begins with the conversation's system turn, if it has one, and as many of the turns before it
as `history` tokens hold. Assistant turns that are new in a window are its targets; repeated ones are masked, so each
assistant text is a target exactly once. A turn longer than the budget is a window of its own, marked over_budget.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` per turn. In texts and roles, each `<|` with any backslashes between its
two characters gets one backslash more there, so no text can hold a control string, and taking it away again restores
the text. A role's line breaks and backslashes are escaped too.

Turns are sorted within partitions by conversation and turn (then role and text, for ties) and streamed: a task keeps
one window's turns at a time, however long a conversation is. The read-back, too, is a stream over the windows.

Null texts and roles are empty. Null conversations and turns are values like others (first in order). Equal rows are
turns each. A conversation without assistant turns has windows without targets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

BUDGET = 1024
HISTORY = 256
START, END = "<|im_start|>", "<|im_end|>"
WINDOWS = "conv_id long, window int, text string, spans array<int>, n_repeated int, n_tokens long, over_budget boolean"
RESULT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
_TOKEN = re.compile(r"\w{1,6}|[^\w\s]")
_OPEN, _SHUT = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def count_tokens(text: str) -> int:
    """About as many tokens as a subword vocabulary gives: pieces of words of six characters, and single marks."""
    return sum(1 for _ in _TOKEN.finditer(text))


class Conversation:
    """Windows of one conversation, turn by turn."""

    def __init__(self, conv_id: int | None, budget: int, history: int) -> None:
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: tuple[str, str, int] | None = None
        self.turns: list[tuple[str, str, int]] = []
        self.repeated = self.number = self.total = self.seen = 0
        self.lead = 0  # turns at the window's head that are the repeated system turn

    def add(self, role: str, text: str) -> Iterator[dict]:
        turn = (role, text, count_tokens(text) + 4)
        if len(self.turns) > self.repeated and self.total + turn[2] > self.budget:
            yield self.close()
            # repeat the system turn, then the latest turns that the history's budget holds
            lead = [self.system] if self.system and self.seen else []
            room = min(self.history, self.budget - turn[2] - sum(t[2] for t in lead))
            past: list[tuple[str, str, int]] = []
            for t in reversed(self.turns[self.lead :]):
                if t[2] > room or t is self.system:
                    break
                past.insert(0, t)
                room -= t[2]
            self.turns = lead + past
            self.lead = len(lead)
            self.repeated, self.total = len(self.turns), sum(t[2] for t in self.turns)
        if not self.seen and role == "system":
            self.system = turn
        self.seen += 1
        self.turns.append(turn)
        self.total += turn[2]

    def close(self) -> dict:
        text, spans, at = [], [], 0
        for k, (role, said, _) in enumerate(self.turns):
            head, body = f"{START}{escape_role(role)}\n", escape(said)
            if role == "assistant" and k >= self.repeated:
                spans += [at + len(head), at + len(head) + len(body)]
            text.append(f"{head}{body}{END}\n")
            at += len(text[-1])
        self.number += 1
        return {"conv_id": self.conv_id, "window": self.number - 1, "text": "".join(text), "spans": spans, "n_repeated": self.repeated, "n_tokens": self.total, "over_budget": self.total > self.budget}


_WINDOW_TYPES = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("spans", pa.list_(pa.int32())), ("n_repeated", pa.int32()), ("n_tokens", pa.int64()), ("over_budget", pa.bool_())])


def _format(budget: int, history: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: Conversation | None = None
        for batch in batches:
            out: list[dict] = []
            size = 0
            for conv, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                if open_ is None or open_.conv_id != conv:
                    if open_ is not None:
                        out.append(open_.close())
                    open_ = Conversation(conv, budget, history)
                out += open_.add(role, text)
                size += len(text)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_pylist(out, _WINDOW_TYPES)
                    out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, _WINDOW_TYPES)
        if open_ is not None:
            yield pa.RecordBatch.from_pylist([open_.close()], _WINDOW_TYPES)

    return run


def format_chats(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Training windows of conversations (conv_id, turn, role, text): conv_id, window, text, spans (code point ranges of the
    targets: start, end, start, end, ...), n_repeated (turns repeated at the window's head), n_tokens, over_budget. Windows of a conversation are
    adjacent and in order within a partition."""
    rows = pick(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format(budget, history), WINDOWS)


def parse(text: str) -> list[tuple[str, str]]:
    """Turns of a formatted window."""
    turns = []
    for part in text.split(f"{END}\n")[:-1]:
        role, _, said = part.removeprefix(START).partition("\n")
        turns.append((unescape_role(role), unescape(said)))
    return turns


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in RESULT.split(", ")]
    key: tuple | None = None
    state: list = []

    def row() -> dict:
        return dict(zip(names, (key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])))

    types = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])
    for batch in batches:
        out: list[dict] = []
        for conv, text, spans, repeated in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "text", "spans", "n_repeated"))):
            if key != (conv,):
                if key is not None:
                    out.append(row())
                key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, said in parse(text)[repeated:]:
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for a, b in zip(spans[::2], spans[1::2]):
                target = unescape(text[a:b])
                state[2] += len(target)
                state[3].update(target.encode())
            state[4] += len(text)
            state[5] += 1
        yield pa.RecordBatch.from_pylist(out, types)
    if key is not None:
        yield pa.RecordBatch.from_pylist([row()], types)


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, from the output of format_chats alone: turns, targets and lengths, with digests."""
    return windows.select("conv_id", "text", "spans", "n_repeated").mapInArrow(_digest, RESULT)
