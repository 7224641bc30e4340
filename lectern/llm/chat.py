"""Chat formatting with a grammar round trip.

A conversation is rendered turn by turn as ``### role: text </turn>`` and a line feed. The rendered text is read back by a
deterministic parser and compared with its source; what conflicts is escaped, one step at a time, until both are identical.
The parser knows one rule: backslashes that stand directly before a control string (``### `` or ``</turn>``) are halved, and an
odd number of them makes the control string ordinary text. Backslashes elsewhere are ordinary. In a role, a backslash makes
the next character ordinary; a colon ends it.

Rows are sorted into ranges of (conversation, turn, role, text), so that a conversation of any length is spread over as many tasks as its
rows take; each task renders parts of at most ``part_chars`` characters (one turn at least). A part is text of its own that
parses by itself, and a conversation is its parts in order.

Defined cases: null roles and texts count as empty; a null conversation id is a conversation of its own and comes first, as do
null turns; rows of the same conversation and turn follow each other by role and text, so repeated rows are repeated turns;
turns may be missing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import col

OPEN, CLOSE = "### ", "</turn>"
CONTROL = re.compile(r"(\\*)(### |</turn>)")
LAST = re.compile(r"\\+\Z")
#: What is escaped at each step: nothing; control strings; control strings and the text's last backslashes.
STEPS = 3

PARTS = "conv_id long, part long, first boolean, last boolean, n_turns long, text string, loss array<struct<start: long, end: long>>, steps long"


class Malformed(ValueError):
    pass


def _role(role: str) -> str:
    return re.sub(r"[\\:]", r"\\\g<0>", role)


def _escaped(text: str, step: int) -> str:
    if step >= 1:
        text = CONTROL.sub(lambda m: m[1] * 2 + "\\" + m[2], text)
    if step >= 2:
        text = LAST.sub(lambda m: m[0] * 2, text)
    return text


def render_turn(role: str, text: str, step: int) -> tuple[str, int, int]:
    """The turn, and where in it the (escaped) text starts and ends."""
    head, body = f"{OPEN}{_role(role)}: ", _escaped(text, step)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """The turns of a rendered text: role, text, and where the escaped text starts and ends."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(OPEN, at):
            raise Malformed(f"no turn begins at {at}")
        at += len(OPEN)
        role = []
        while True:
            if at >= len(rendered):
                raise Malformed("a role does not end")
            if rendered[at] == "\\" and at + 1 < len(rendered):
                role.append(rendered[at + 1])
                at += 2
            elif rendered[at] == ":":
                break
            else:
                role.append(rendered[at])
                at += 1
        if not rendered.startswith(": ", at):
            raise Malformed("no space after a role")
        at += 2
        start, text, done = at, [], False
        for m in CONTROL.finditer(rendered, at):
            text.append(rendered[at : m.start()])
            text.append("\\" * (len(m[1]) // 2))
            at = m.end()
            if len(m[1]) % 2:
                text.append(m[2])
            elif m[2] == CLOSE:
                end, done = m.start(2), True
                break
            else:
                raise Malformed("a turn begins inside a turn")
        if not done or not rendered.startswith("\n", at):
            raise Malformed("a turn does not end")
        at += 1
        turns.append(("".join(role), "".join(text), start, end))
    return turns


def round_trip(role: str, text: str) -> tuple[str, int, int, int]:
    """A turn rendered with the least escaping that reads back identically: text, start, end, steps taken."""
    for step in range(STEPS):
        rendered, start, end = render_turn(role, text, step)
        try:
            if parse(rendered) == [(role, text, start, end)]:
                return rendered, start, end, step
        except Malformed:
            pass
    raise Malformed("a turn cannot be rendered")


def render(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_chars: int = 1 << 20) -> DataFrame:
    """One row per part of a conversation: conv_id, part (its order), first and last (whether its task knows that the
    conversation begins or ends there), n_turns, text, loss (the spans of assistant texts, as escaped), steps (of escaping)."""
    empty = F.lit("")
    rows = df.select(col(conv_id).cast("long").alias("conv_id"), col(turn).cast("long").alias("turn"), F.coalesce(col(role), empty).alias("role"), F.coalesce(col(text), empty).alias("text"))
    # The ranges' bounds hold the beginnings of texts, which have the texts' order; equal beginnings are in one range, so the sort
    # within ranges completes the order.
    rows = rows.withColumn("begin", F.substring("text", 1, 64))
    rows = rows.repartitionByRange("conv_id", "turn", "role", "begin").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_()), ("n_turns", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("steps", pa.int64())])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32  # ranges are in order, and so are the parts in each
        made: list[dict] = []
        current: dict | None = None
        seen: object = parts  # of no conversation yet
        held = 0  # characters in made

        def closed(last: bool) -> None:
            nonlocal held
            held += current["size"]
            current["text"] = "".join(current["text"])
            if [t[:2] for t in parse(current["text"])] != current.pop("source"):
                raise Malformed("a part does not read back")
            current["last"] = last
            made.append(current)

        for batch in batches:
            for conv, who, what in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if current is None or conv != seen or current["size"] >= part_chars:
                    if current is not None:
                        closed(conv != seen)
                    begins = current is not None and conv != seen
                    current = {"conv_id": conv, "part": number, "first": begins, "n_turns": 0, "text": [], "loss": [], "steps": 0, "size": 0, "source": []}
                    number, seen = number + 1, conv
                rendered, start, end, step = round_trip(who, what)
                if who == "assistant":
                    current["loss"].append({"start": current["size"] + start, "end": current["size"] + end})
                current["text"].append(rendered)
                current["source"].append((who, what))
                current["size"] += len(rendered)
                current["n_turns"] += 1
                current["steps"] = max(current["steps"], step)
                if held >= part_chars:
                    yield pa.RecordBatch.from_pylist([{k: x[k] for k in schema.names} for x in made], schema=schema)
                    made.clear()
                    held = 0
        if current is not None:
            closed(False)
        if made:
            yield pa.RecordBatch.from_pylist([{k: x[k] for k in schema.names} for x in made], schema=schema)

    return rows.mapInArrow(parts, PARTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, steps long"


class _Reader:
    """Digests of one conversation's parts as they pass by."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss = conv_id, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.steps = 0

    def add(self, text: str, loss: list[dict], steps: int) -> None:
        spans = {(x["start"], x["end"]) for x in loss}
        for role, said, start, end in parse(text):
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1
            if (start, end) in spans:
                self.loss.update(said.encode())
                self.loss_chars += len(said)
        self.chars += len(text)
        self.steps = max(self.steps, steps)

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars, "steps": self.steps}


def read_back(parts: DataFrame) -> DataFrame:
    """One row per conversation of ``render``: what is read back from its parts, as digests.

    A conversation that lies in one part is read where it is. The few that reach over parts or tasks meet, part by part in
    order, in a second step, where each is read as a stream: memory holds one part at a time, however long the conversation
    is. A digest of a whole conversation is a fold in order, so that a single task has to see all of it."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    digests = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("steps", pa.int64())]
    names = [k for k, _ in digests]
    mixed = pa.schema([*digests, ("part", pa.int64()), ("text", pa.string()), ("loss", span)])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for k, x in enumerate(rows):
                if x["first"] and x["last"]:
                    (reader := _Reader(x["conv_id"])).add(x["text"], x["loss"], x["steps"])
                    rows[k] = reader.row()
            yield pa.RecordBatch.from_pylist([{k: x.get(k) for k in mixed.names} for x in rows], schema=mixed)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            done = []
            for x in batch.to_pylist():
                if reader and (x["text"] is None or x["conv_id"] != reader.conv_id):
                    done.append(reader.row())
                    reader = None
                if x["text"] is None:
                    done.append({k: x[k] for k in names})
                else:
                    reader = reader or _Reader(x["conv_id"])
                    reader.add(x["text"], x["loss"], x["steps"])
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=pa.schema(digests))
        if reader:
            yield pa.RecordBatch.from_pylist([reader.row()], schema=pa.schema(digests))

    read = parts.mapInArrow(whole, f"{DIGESTS}, part long, text string, loss array<struct<start: long, end: long>>")
    return read.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(fold, DIGESTS)
