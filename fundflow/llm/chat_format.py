"""Chat formatting by replaying a log of events.

A log has one row per event: conv_id, message (which one of the conversation
it is about), seq, kind, role, text. Kinds:

- ``message``: a message of this role and text begins
- ``start``: an empty message of this role begins
- ``delta``: text is added to its end
- ``edit``: text replaces it
- ``regenerate``: it is emptied, to be streamed anew
- ``delete``: it goes

:func:`streamed_log` makes such a log of finished conversations. The log is
partitioned by conversation and sorted by message and sequence, so a worker
folds the events of one message at a time and never holds a conversation; the
messages of one conversation are replayed by one task, as their order asks. Messages are rendered as ``### role: text</turn>`` and a line
end. In roles and texts a backslash comes before every backslash and ``#`` and
inside ``</``, and before colons of roles, so neither mark can occur in them.
A conversation is returned in parts of about :data:`PART_CHARS` code points,
each with the spans of its assistant texts (the loss mask).

Defined results: null texts and roles are empty; events of equal message and
seq are ordered by kind, role and text; a second ``message`` or ``start``
begins another message; a delta, edit or regenerate without one begins one; a
null conv_id is a conversation of its own; a message of any length is folded as
a whole; an empty log gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundflow.llm.common import only, partitions

PART_CHARS = 1 << 20
LOSS_ROLE = "assistant"
FORMATTED = "conv_id long, part int, n_turns long, formatted string, loss array<struct<start: long, stop: long>>"
_KIND = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</", "<\\/")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted part."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def log_of(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` as a log of messages."""
    rows = only(conversations, "conv_id", "turn", "role", "text")
    return rows.select("conv_id", F.col("turn").alias("message"), F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def streamed_log(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` as the events of a live
    session that ends with them, dealt by conversation.

    Assistants begin, are regenerated after a quarter of their text, then
    stream two deltas; others send half of their text and edit it. Rows of one
    turn are messages in order of role and text.
    """
    rows = only(conversations, "conv_id", "turn", "role", "text")
    by = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    dealt = rows.repartition(partitions(conversations.sparkSession), "conv_id").withColumn("n", F.row_number().over(by).cast("long"))
    half = F.floor(F.length("text") / 2).cast("int")
    part = lambda start, n: F.substring(F.coalesce("text", F.lit("")), start, F.coalesce(n, F.lit(0)))
    event = lambda k, kind, text: F.struct(F.lit(k).cast("long").alias("k"), F.lit(kind).alias("kind"), text.cast("string").alias("text"))
    none, first, rest = F.lit(None), part(F.lit(1), half), part(half + 1, F.length("text"))
    streamed = [event(0, "start", none), event(1, "delta", part(F.lit(1), F.floor(half / 2).cast("int"))), event(2, "regenerate", none), event(3, "delta", first), event(4, "delta", rest)]
    written = [event(0, "message", first), event(1, "edit", F.col("text"))]
    events = F.when(F.col("role") == LOSS_ROLE, F.array(*streamed)).otherwise(F.array(*written))
    each = dealt.select("conv_id", F.col("turn").alias("message"), "n", "role", F.explode(events).alias("e"))
    return each.select("conv_id", "message", (F.col("n") * len(streamed) + F.col("e.k")).alias("seq"), "e.kind", "role", "e.text")


def fold(events: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, role, text) of final messages, from events in order."""
    current, role, pieces, alive = None, "", [], False
    for conv_id, message, kind, who, text in events:
        begins = kind in ("message", "start") or current != (conv_id, message)
        if begins:
            if alive:
                yield current[0], role, "".join(pieces)
            current, role, pieces, alive = (conv_id, message), who or "", [], True
        if kind in ("message", "delta"):
            pieces.append(text or "")
        elif kind == "edit":
            pieces = [text or ""]
        elif kind == "regenerate":
            pieces = []
        elif kind == "delete":
            alive = False
        elif kind != "start":
            raise ValueError(f"unknown kind of event: {kind!r}")
        if kind != "delete":
            alive = True
    if alive:
        yield current[0], role, "".join(pieces)


def render(messages: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of :data:`FORMATTED`."""
    held: list[str] = []
    loss: list[dict] = []
    of, part, n, size, open_ = None, 0, 0, 0, False
    for conv_id, role, text in messages:
        if open_ and (conv_id != of or size >= PART_CHARS):
            yield of, part, n, "".join(held), list(loss)
            part = part + 1 if conv_id == of else 0
            held, loss, n, size = [], [], 0, 0
        of, open_ = conv_id, True
        head, body = f"### {escape(role).replace(':', '\\:')}: ", escape(text)
        if role == LOSS_ROLE:
            loss.append({"start": size + len(head), "stop": size + len(head) + len(body)})
        held += head, body, "</turn>\n"
        size, n = size + len(head) + len(body) + 8, n + 1
    if open_:
        yield of, part, n, "".join(held), list(loss)


def _batched(rows: Iterator[tuple], kinds: list, names: list[str], most: int = 64) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def format_log(log: DataFrame, dealt: bool = False) -> DataFrame:
    """Formatted conversations: rows of :data:`FORMATTED`, the parts of a
    conversation in order within a partition. ``dealt``: the log's partitions
    hold whole conversations already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
        yield from _batched(render(fold(events)), [pa.int64(), pa.int32(), pa.int64(), pa.string(), _KIND], ["conv_id", "part", "n_turns", "formatted", "loss"])

    rows = only(log, "conv_id", "message", "seq", "kind", "role", "text")
    if not dealt:
        rows = rows.repartition(partitions(log.sparkSession), "conv_id")
    ordered = rows.sortWithinPartitions("conv_id", "message", "seq", "kind", "role", "text")
    return ordered.select("conv_id", "message", "kind", "role", "text").mapInArrow(run, FORMATTED)


def digests(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """Per conversation, read back from its parts: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars. ``in_order``: rows
    come straight from :func:`format_log`; others are put in order first."""

    def per_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        of, open_ = None, False
        for b in batches:
            for conv_id, text, loss in zip(*[b.column(i).to_pylist() for i in range(3)]):
                if not open_ or conv_id != of:
                    if open_:
                        yield of, n, turns.hexdigest(), loss_chars, masked.hexdigest(), chars
                    of, open_, n, loss_chars, chars = conv_id, True, 0, 0, 0
                    turns, masked = hashlib.sha256(), hashlib.sha256()
                for role, said in parse(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["stop"]])
                    loss_chars += len(said)
                    masked.update(said.encode())
                chars += len(text)
        if open_:
            yield of, n, turns.hexdigest(), loss_chars, masked.hexdigest(), chars

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(per_conversation(batches), kinds, names, 1024)

    if not in_order:
        formatted = formatted.repartition(partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
