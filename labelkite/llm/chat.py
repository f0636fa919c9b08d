"""Conversations as training text: rendered, parsed back, and escaped until both are the same.

Grammar of a formatted text::

    conversation = { "<|im_start|>" role NEWLINE text "<|im_end|>" NEWLINE }

Role and text have no control string, and a role has no newline. A turn is rendered as it is and
parsed by this grammar; if the parser does not give the source turn back, its conflicting content is
escaped: a backslash goes behind the ``<`` of a control string, one more if there are some already, and
a newline in a role becomes an escaped name. The parser takes one off again.

A conversation is stored in order as one text or more (chunks), each with the places of the
assistant's texts, which are the loss mask. Turns are ordered by turn, then role, then text. Spark's
range shuffle by conversation and turn cuts a conversation that is larger than a partition.

Nulls: a null text or role is an empty one; null conversations are one conversation; a null turn comes
first. Repeated rows are repeated turns. An empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
CHUNK_CHARS = 1 << 20

CHUNKS = "conv_id long, part long, n_turns long, formatted string, loss array<struct<begin:int,end:int>>"
SPAN = pa.struct([("begin", pa.int32()), ("end", pa.int32())])

_bare = re.compile(r"<(\\*)\|(im_start|im_end|newline)\|>")
_escaped = re.compile(r"<\\(\\*)\|(im_start|im_end|newline)\|>")
_turn = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(content: str, line: bool = False) -> str:
    """Without control strings, and on one line if asked; ``unescape`` gives the content back."""
    out = _bare.sub(r"<\\\1|\2|>", content)
    return out.replace("\n", "<|newline|>") if line else out


def unescape(content: str, line: bool = False) -> str:
    out = content.replace("<|newline|>", "\n") if line else content
    return _escaped.sub(r"<\1|\2|>", out)


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """Turns ``(role, text, begin and end of the text as written)``; None if it is not in the grammar."""
    turns, at = [], 0
    while at < len(formatted):
        m = _turn.match(formatted, at)
        if m is None or any(c in g for g in m.groups() for c in (START, END)):
            return None
        turns.append((unescape(m[1], line=True), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return turns


def render(role: str, text: str) -> str:
    """A turn that the parser turns back into itself: as it is, or escaped where it must be."""
    for r, t in ((role, text), (escape(role, line=True), text), (role, escape(text)), (escape(role, line=True), escape(text))):
        out = f"{START}{r}\n{t}{END}\n"
        got = parse(out)
        if got is not None and len(got) == 1 and got[0][:2] == (role, text):
            return out
    raise ValueError(f"a turn that cannot be written: {role!r} {text!r}")


def _chunk(conv, part: int, turns: list[str], loss: list[dict]) -> pa.RecordBatch:
    row = [conv, part, len(turns), "".join(turns), loss]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.large_string(), pa.list_(SPAN)]
    names = ["conv_id", "part", "n_turns", "formatted", "loss"]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)


def format_conversations(
    rows: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """Chunks ``(conv_id, part, n_turns, formatted, loss)``; ``part`` puts a conversation's in order."""

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        conv, turns, loss, size = None, [], [], 0
        done: list[pa.RecordBatch] = []
        for batch in batches:
            for c, r, t in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if turns and (c != conv or size >= chunk_chars):
                    done.append(_chunk(conv, part, turns, loss))
                    part, turns, loss, size = part + 1, [], [], 0
                    if len(done) >= 1000:
                        yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                        done = []
                conv = c
                out = render(r, t)
                if r == LEARNED:
                    _, _, a, b = parse(out)[0]
                    loss.append({"begin": size + a, "end": size + b})
                turns.append(out)
                size += len(out)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done = []
        if turns:
            yield _chunk(conv, part, turns, loss)

    empty = F.lit("")
    ordered = rows.select(
        F.col(conversation).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), empty).alias("role"),
        F.coalesce(F.col(text), empty).alias("text"),
    )
    ordered = ordered.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(rendered, CHUNKS)


def _recovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk: the source of its turns, and the text under its mask."""
    for batch in batches:
        rows = []
        for conv, part, _, formatted, loss in zip(*[c.to_pylist() for c in batch.columns]):
            turns = parse(formatted)
            if turns is None:
                raise ValueError(f"conversation {conv} is not in the grammar")
            source = "".join([f"{r}\n{t}\n" for r, t, _, _ in turns])
            learned = "".join([unescape(formatted[s["begin"] : s["end"]]) for s in loss])
            rows.append((conv, part, len(turns), source, learned, len(learned), len(formatted)))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.large_string(), pa.large_string(), pa.int64(), pa.int64()]
        names = ["conv_id", "part", "n_turns", "source", "learned", "loss_chars", "formatted_chars"]
        columns = zip(*rows) if rows else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of each conversation; its chunks come one after the other, and none is kept."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now = None
    rows: list[tuple] = []

    def closed() -> tuple:
        conv, n, turns, chars, loss, size = now
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

    for batch in batches:
        for conv, n, source, learned, chars, size in zip(*[c.to_pylist() for c in batch.columns]):
            if now is None or now[0] != conv:
                if now is not None:
                    rows.append(closed())
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            now[1] += n
            now[2].update(source.encode())
            now[3] += chars
            now[4].update(learned.encode())
            now[5] += size
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
            rows = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(closed(), types)], names)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Of each stored conversation: turns, learned and formatted characters, and SHA-256 digests.

    Chunks are parsed where they are read. A digest needs its conversation's chunks in order in one
    task, which holds one batch of them.
    """
    chunks = spark.read.schema(CHUNKS).parquet(path)
    parts = chunks.mapInArrow(
        _recovered,
        "conv_id long, part long, n_turns long, source string, learned string, loss_chars long, formatted_chars long",
    )
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.select("conv_id", "n_turns", "source", "learned", "loss_chars", "formatted_chars").mapInArrow(
        _summed,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
