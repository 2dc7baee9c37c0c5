"""Chat formatting: conversations rebuilt from event logs, rendered with a reversible template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

#: The template: `<s>[INST] role [/INST]text</s>` for each turn.
HEAD, MID, TAIL = "<s>[INST] ", " [/INST]", "</s>"
#: A control string whose first mark is followed by n backslashes is written with n + 1 of them.
_CONTROL = re.compile(r"(<|\[)(\\*)(/?s>|/?INST\]|</?SYS>>)")
_ESCAPED = re.compile(r"(<|\[)\\(\\*)(/?s>|/?INST\]|</?SYS>>)")
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.S)
#: A rendered part ends with the turn that takes it beyond so many characters.
PART_CHARS = 1 << 18

EVENTS = ("conv_id", "turn", "message_id", "seq", "kind", "role", "text")
PARTS = "conv_id long, part int, text string, loss_starts array<int>, loss_ends array<int>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def turn_events(turns: DataFrame) -> DataFrame:
    """A plain table of turns (conv_id, turn, role, text) as a log: one message event for each row.

    Rows that share a conversation and a turn stay separate messages, in the order of role and text.
    """
    rows = pick(turns, conv_id="conv_id", turn="turn", role="role", text="text")
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.concat_ws("\n", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("message_id"),
        F.lit(0).cast("long").alias("seq"),
        F.lit("message").alias("kind"),
        "role",
        "text",
    )


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
    """conv_id, role and final text of each message, from sorted events; one message is held at a time."""
    key, role, pieces = None, "", []
    for batch in batches:
        for conv, turn, message, seq, kind, who, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at = (conv, turn, message, seq if kind == "message" else None)
            if key is None or at[:3] != key[:3] or (kind == "message" and key[3] is not None):
                if key is not None:
                    yield key[0], role, "".join(pieces)
                key, role, pieces = at, who or "", []
            if kind in ("message", "edit"):
                pieces = [text or ""]
            elif kind == "delta":
                pieces.append(text or "")
            elif kind == "regenerate":
                pieces = [text or ""]
            else:
                raise ValueError(f"unknown event kind: {kind!r}")
            role = who or role
    if key is not None:
        yield key[0], role, "".join(pieces)


def render(events: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Conversations as training text: conv_id, part, text, loss_starts, loss_ends.

    Events are conv_id, turn, message_id, seq, kind, role, text. They are partitioned by conversation,
    sorted by turn, message and sequence, and folded message by message: `message` sets the text (twice
    the same message id: two messages), `delta` appends to it, `edit` replaces it, `regenerate` drops what
    was said and starts anew. The first role given holds until another comes. A conversation is returned
    in parts that end with a turn; in order they are its whole text, so no conversation is ever held at
    once. The loss spans (code points in the part) cover the assistant's texts.

    Null text and role are empty strings. A null conv_id is a conversation like any other. Ties in turn
    are broken by message_id, ties in seq by kind and text. An empty log gives an empty result. Other
    columns are ignored; an unknown kind is an error.
    """
    rows = pick(events, **{c: c for c in EVENTS})
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "message_id", "seq", "kind", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, part, buffer, held, spans = object(), 0, [], 0, []

        def close() -> None:
            if buffer:
                out.append((conv, part, "".join(buffer), [a for a, _ in spans], [b for _, b in spans]))

        size = 0
        for key, role, text in _folded(batches):
            if key != conv or held >= part_chars:
                close()
                size += held
                part = part + 1 if key == conv else 0
                conv, buffer, held, spans = key, [], 0, []
                if size >= 1 << 22:
                    yield _batch(out)
                    out, size = [], 0
            body = escape(text)
            head = f"{HEAD}{escape(role)}{MID}"
            buffer += [head, body, TAIL]
            if role == "assistant":
                spans.append((held + len(head), held + len(head) + len(body)))
            held += len(head) + len(body) + len(TAIL)
        close()
        if out:
            yield _batch(out)

    return ordered.mapInArrow(write, PARTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ints = pa.list_(pa.int32())
    kinds = (pa.int64(), pa.int32(), pa.string(), ints, ints)
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in PARTS.split(", ")])


def parse(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a rendered text, unescaped."""
    return [(unescape(role), unescape(body)) for role, body in _TURN.findall(text)]


def digests(parts: DataFrame) -> DataFrame:
    """What the rendered text says when read back, a row per conversation: n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars. A null conv_id is a conversation like any other; no parts give no rows; a conversation of
    any length is read part by part. parts is render()'s result as it comes: a conversation's parts follow each
    other within a partition, so nothing is moved again and hashes advance part by part."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        conv, turns, loss, n, n_loss, chars, last = None, None, None, 0, 0, 0, -1
        for batch in batches:
            for key, part, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part and (key != conv or part != last + 1):
                    raise ValueError("a conversation's parts are out of order: read render()'s result as it comes, or sort by conv_id and part")
                last = part
                if part == 0:
                    if turns is not None:
                        rows.append((conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), chars))
                    conv, turns, loss, n, n_loss, chars = key, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, body in parse(text):
                    turns.update(f"{role}\n{body}\n".encode())
                    n += 1
                for a, b in zip(starts, ends, strict=True):
                    body = unescape(text[a:b])
                    loss.update(body.encode())
                    n_loss += len(body)
                chars += len(text)
        if turns is not None:
            rows.append((conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), chars))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in DIGESTS.split(", ")])

    return parts.mapInArrow(read, DIGESTS)
