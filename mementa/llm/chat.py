"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations.  ``messages`` partitions it by conversation and message, sorts by sequence number
and folds: a ``start`` opens a message, a ``delta`` appends, an ``edit`` replaces the text, a ``regenerate`` discards
what was streamed so far, a ``delete`` removes the message.  ``render`` streams the messages of each conversation in
order into the template, with escaped texts and a loss mask over the assistant's words.

A conversation leaves ``render`` in segments of bounded size, so a huge one is never held as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, functions as F

from mementa.llm.common import text_of

#: The marks of the template.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]")  # a role without marks of its own: its name, a line feed, its text
CONTROL = [m for pair in [*MARKS.values(), OTHER] for m in pair]
SEGMENT_CHARS = 4 << 20
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPE = re.compile(r"\\|" + _CONTROL.pattern)
_UNESCAPE = re.compile(r"\\([\\lbn])")
_LETTERS = {"<": "l", "[": "b"}


def escape(text: str) -> str:
    """No mark survives: its first character becomes a backslash and a letter; backslashes are doubled."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else "\\" + _LETTERS[m[0][0]] + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: {"\\": "\\", "l": "<", "b": "[", "n": "\n"}[m[1]], text)


def _name(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and where its text lies in it."""
    opening, closing = MARKS.get(role, OTHER)
    lead = f"{opening} " if role in MARKS else f"{opening} {_name(role)}\n"
    body = escape(text)
    return f"{lead}{body} {closing}", len(lead), len(lead) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    roles = {opening: role for role, (opening, _) in MARKS.items()}
    marks = _CONTROL.finditer(formatted)
    for opening in marks:
        closing = next(marks)
        body = formatted[opening.end() + 1 : closing.start() - 1]
        if opening[0] in roles:
            yield roles[opening[0]], unescape(body)
        else:
            name, _, text = body.partition("\n")
            yield unescape(name), unescape(text)


def messages(log: DataFrame) -> DataFrame:
    """(conv_id, position, message_id, role, text): final messages of ``log(conv_id, message_id, seq, kind, role, text)``.

    The fold needs only the events from the last edit or regeneration on.  Keys are conversation and message, so a
    long conversation is spread.  ``position`` is the message's first sequence number and ``role`` the first one
    given.  Events with equal seq are ordered by kind and text; null text is empty, null role too, null seq comes
    first; messages with a delete are gone.
    """
    event = F.struct("seq", "kind", "text", "role")
    folded = log.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list(event)).alias("events"))
    places = F.sequence(F.lit(1), F.size("events"))
    restart = F.array_max(
        F.filter(places, lambda i: F.element_at("events", i)["kind"].isin("edit", "regenerate"))
    )
    live = F.slice("events", F.coalesce(restart, F.lit(1)), F.size("events"))
    spoken = F.filter(live, lambda e: e["kind"].isin("edit", "delta"))
    deleted = F.exists("events", lambda e: F.coalesce(e["kind"] == "delete", F.lit(False)))
    roles = F.filter("events", lambda e: e["role"].isNotNull())
    return folded.filter(~deleted).select(
        "conv_id",
        F.element_at("events", 1)["seq"].alias("position"),
        "message_id",
        F.coalesce(F.get(roles, F.lit(0))["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(spoken, lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("text"),
    )


def _runs(batches) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """Consecutive rows with the same first column; the runs must be read in order."""
    from itertools import groupby

    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    return groupby(rows, key=lambda r: r[0])


def render(final: DataFrame, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """(conv_id, segment, formatted, loss array<struct<start,end>>) of ``messages``'s result.

    The segments of a conversation follow each other; loss spans are code points within a segment.
    """

    def run(batches):
        import pyarrow as pa

        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

        def out(conv_id, segment, parts, loss):
            columns = [pa.array([conv_id], pa.int64()), pa.array([segment], pa.int32()), pa.array(["".join(parts)], pa.string())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([loss], pa.list_(span))], ["conv_id", "segment", "formatted", "loss"])

        for conv_id, rows in _runs(batches):
            segment, size, parts, loss = 0, 0, [], []
            for _, role, text in rows:
                if size and size + len(text) > segment_chars:
                    yield out(conv_id, segment, parts, loss)
                    segment, size, parts, loss = segment + 1, 0, [], []
                piece, start, end = turn(role, text)
                if role == "assistant":
                    loss.append({"start": size + start, "end": size + end})
                parts.append(piece)
                size += len(piece)
            yield out(conv_id, segment, parts, loss)

    ordered = final.repartition("conv_id").sortWithinPartitions("conv_id", "position", "message_id")
    schema = "conv_id long, segment int, formatted string, loss array<struct<start:int,end:int>>"
    return ordered.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text").mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) per conversation, from ``render``'s result."""

    def run(batches):
        import pyarrow as pa

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        some = []
        for conv_id, rows in _runs(batches):
            some.append((conv_id, *_digest(rows)))
            if len(some) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names)
                some = []
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), kinds)], names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment").select("conv_id", "formatted", "loss")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInArrow(run, schema)


def _digest(segments: Iterable[tuple]) -> tuple:
    turns, masked = hashlib.sha256(), hashlib.sha256()
    count = loss_chars = size = 0
    for _, formatted, loss in segments:
        size += len(formatted)
        for role, text in parse(formatted):
            turns.update(f"{role}\n{text}\n".encode())
            count += 1
        for span in loss:
            text = unescape(formatted[span["start"] : span["end"]])
            masked.update(text.encode())
            loss_chars += len(text)
    return count, turns.hexdigest(), loss_chars, masked.hexdigest(), size


def as_log(conversations: DataFrame, delta_chars: int = 256) -> DataFrame:
    """The event log of ``conversations(conv_id, turn, role, text)``: every row starts a message and streams its text
    in deltas.

    Rows with the same conv_id, turn, role and text are turns of their own: they are counted, and each gets its own
    message.  Rows of a turn that differ follow each other by role and a hash of the text.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text_of().alias("text"))
    times = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    each = times.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / delta_chars) - 1, F.lit(0)).cast("int"))
    deltas = F.transform(
        pieces, lambda i: F.struct((i + 1).alias("step"), F.lit("delta").alias("kind"), F.substring(F.col("text"), i * delta_chars + 1, F.lit(delta_chars)).alias("piece"))
    )
    start = F.array(F.struct(F.lit(0).alias("step"), F.lit("start").alias("kind"), F.lit("").alias("piece")))
    events = each.select("conv_id", "turn", "role", "text", "copy", F.explode(F.concat(start, deltas)).alias("e"))
    return events.select(
        "conv_id",
        F.struct("turn", "role", F.sha2("text", 256).alias("text_sha256"), "copy").alias("message_id"),
        F.struct(F.col("turn").alias("turn"), F.col("e.step").alias("step")).alias("seq"),
        F.col("e.kind").alias("kind"),
        F.when(F.col("e.kind") == "start", F.col("role")).alias("role"),
        F.col("e.piece").alias("text"),
    )
