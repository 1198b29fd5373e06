"""Chat formatting in budgeted windows of turns (operator 9).

A turn is written as ``### Label: text</turn>`` and a line feed; control strings inside texts are escaped with a
backslash, reversibly.  Prefix sums of the turns' tokens choose which turns share a window: a window takes new
turns while they fit the budget, at least one.  Every window begins with the conversation's system turn, if it
has one, and repeats the last turns before its first new one, as far as they fit their own share and leave room
for that turn.  Repeated turns are masked; the loss mask covers the texts of new assistant turns, so each counts
once.

Rows of a conversation meet in one sorted stream and only its last turns are held, so a conversation of any
length takes bounded memory.  Turn order is (turn, role, text), nulls first.  Null texts and roles count as
empty; a null conversation id is one conversation; repeated rows are turns of their own; an empty table gives an
empty table; other columns of the input are ignored.  A turn larger than the budget has a window of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.token_counts import prefixes
from tidegauge.session import prepare

BUDGET, HISTORY = 1024, 256
LABELS = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {v: k for k, v in LABELS.items()}
END = "</turn>\n"
_control = re.compile(r"\\|###|</turn>")
_escaped = re.compile(r"\\(\\|###|</turn>)")
_mark = re.compile(r"\\(?:\\|###|</turn>)|</turn>\n")
_head = re.compile(r"### ([A-Za-z]+|@[^:]*): ")


def escape(text: str) -> str:
    return _control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def head(role: str) -> str:
    """Marks the start of a turn; roles other than the three known ones are written out, quoted."""
    return f"### {LABELS.get(role) or '@' + quote(role, safe='')}: "


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn in a formatted window."""
    at = 0
    while at < len(text):
        start = _head.match(text, at)
        mark = next(m for m in _mark.finditer(text, start.end()) if m[0] == END)
        label = start[1]
        yield unquote(label[1:]) if label[0] == "@" else ROLES[label], unescape(text[start.end() : mark.start()])
        at = mark.end()


Turn = tuple[str, str, int]  # role, formatted turn, tokens


class Windows:
    """Windows of one conversation, turn by turn."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: list[Turn] = []
        self.recent: list[Turn] = []
        self.repeated: list[Turn] = []
        self.new: list[Turn] = []
        self.used = 0  # the prefix sum within the window
        self.any = False

    def add(self, turn: Turn) -> Iterator[tuple[str, int, int, list[dict[str, int]]]]:
        """Takes the next turn; gives the window that it closes, if any."""
        if not self.any and turn[0] == "system":
            self.system, self.used, self.any = [turn], turn[2], True
            return
        self.any = True
        if self.new and self.used + turn[2] > self.budget:
            yield self.close()
            base = sum(t[2] for t in self.system)
            room = min(self.history, self.budget - base - turn[2])
            self.repeated = []
            for old in reversed(self.recent):
                if old[2] > room:
                    break
                room -= old[2]
                self.repeated.insert(0, old)
            self.used = base + sum(t[2] for t in self.repeated)
        self.new.append(turn)
        self.used += turn[2]
        self.recent.append(turn)
        held = sum(t[2] for t in self.recent)
        while len(self.recent) > 1 and held - self.recent[0][2] >= self.history:
            held -= self.recent.pop(0)[2]

    def close(self) -> tuple[str, int, int, list[dict[str, int]]]:
        """Text, number of repeated turns, tokens, and spans of the loss mask of the window so far."""
        first = self.system if self.started else []
        shown = [*self.system, *self.repeated]
        text, spans = "".join(t[1] for t in shown), []
        at = len(text)
        parts = [text]
        for role, formatted, _ in self.new:
            if role == "assistant":
                spans.append({"start": at + len(head(role)), "end": at + len(formatted) - len(END)})
            parts.append(formatted)
            at += len(formatted)
        out = "".join(parts), len(first) + len(self.repeated), self.used, spans
        self.new, self.repeated, self.started = [], [], True
        return out

    started = False


_rows = "conv_id long, window int, text string, repeated int, tokens long, loss array<struct<start:int,end:int>>"
_type = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def format_windows(chats: DataFrame, budget: int = BUDGET, history: int = HISTORY, model: str | None = None) -> DataFrame:
    """Windows of each conversation in order: conv_id, window (from 0), text, repeated (leading turns that repeat others), tokens, loss (spans of code points)."""
    prepare(chats.sparkSession)
    rows = chats.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        for held in _held(_turns(batches, prefixes(model)), budget, history):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*held), (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.list_(_type)))],
                names=["conv_id", "window", "text", "repeated", "tokens", "loss"],
            )

    return rows.mapInArrow(run, _rows)


def _turns(batches, counter) -> Iterator[tuple[int | None, Turn]]:
    for batch in batches:
        for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
            roles = part.column(2).to_pylist()
            formatted = [head(r) + escape(t) + END for r, t in zip(roles, part.column(3).to_pylist())]
            yield from zip(part.column(0).to_pylist(), zip(roles, formatted, counter.totals(formatted, 0)[0]))


def _held(turns, budget: int, history: int) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    size = 0
    for conv, own in groupby(turns, key=lambda x: x[0]):
        windows, at = Windows(budget, history), 0
        closed = (w for _, turn in own for w in windows.add(turn))
        for w in closed:
            held.append((conv, at, *w))
            at, size = at + 1, size + len(w[0])
            if size > 4 << 20:
                yield held
                held, size = [], 0
        if windows.new or windows.any and not at:
            held.append((conv, at, *windows.close()))
            size += len(held[-1][2])
    if held:
        yield held


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of what the windows hold, read from their texts and masks: see the contract of the query.

    Windows must come as ``format_windows`` gives them, whole conversations in order within partitions.
    """

    def run(batches):
        rows = (r for b in batches for k in range(0, b.num_rows, 256) for r in zip(*(c.to_pylist() for c in b.slice(k, 256).columns)))
        out = []
        for conv, own in groupby(rows, key=lambda r: r[0]):
            turns, loss, n, chars, total = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, _, text, repeated, _, spans in own:
                for k, (role, said) in enumerate(turns_of(text)):
                    if k >= repeated:
                        turns.update(f"{role}\n{said}\n".encode())
                        n += 1
                for s in spans:
                    said = unescape(text[s["start"] : s["end"]])
                    loss.update(said.encode())
                    chars += len(said)
                total += len(text)
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), total))
            if len(out) == 4096:
                yield _digests(out)
                out = []
        if out:
            yield _digests(out)

    return windows.select("conv_id", "window", "text", "repeated", "tokens", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(out: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def planted(spark) -> DataFrame:
    """Conversation -7 of the query: both turns say what looks like the template's own marks."""
    said = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256
FROM c GROUP BY conv_id
"""
