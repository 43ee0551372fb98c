"""Chat formatting by columnar byte assembly.

Rows (conversation, turn, role, text) become formatted conversations. The bytes
of headers and contents are placed into one preallocated Arrow buffer: segment
lengths give cumulative offsets, and scatter indices made in numpy copy every
segment to its place.

Template: ``<|im_start|>role\\n`` text ``<|im_end|>\\n``. Inside roles and texts a
backslash is doubled and every control string gets ``\\-`` after its first
character, so no control string of the template can come from a text, and the
escape can be undone from left to right. A line feed in a role becomes ``\\n``.

Defined cases: a null text or role is empty; turns are ordered by turn (null
first), then role, then text; equal rows are all kept; a null conversation id is
a conversation of its own; an empty table gives no rows; other columns are
ignored. A conversation of any length, and a turn with any number of rows, is
written in parts of whole rows, so a task never holds more than one part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind, text_bytes, tune

# The strings that steer chat templates.
CONTROL = ["<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>"]
OPEN, CLOSE, LOSS_ROLE = "<|im_start|>", "<|im_end|>\n", "assistant"
#: The order of the parts of conversations; characters of a text by which equal turns are dealt to tasks.
PARTS = ["conv_id", "turn", "role", "head", "part"]
HEAD = 64


def escape(texts: pa.Array, control: list[str]) -> pa.Array:
    """Texts in which no control string is left."""
    texts = pc.replace_substring(pc.fill_null(texts, ""), "\\", "\\\\")
    for c in control:
        texts = pc.replace_substring(texts, c, c[0] + "\\-" + c[1:])
    return texts


def unescape(text: str) -> str:
    """Undo :func:`escape`, and ``\\n`` in roles."""
    return re.sub(r"\\(.)", lambda m: {"-": "", "n": "\n"}.get(m[1], m[1]), text) if "\\" in text else text


def assemble(segments: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Row by row, the bytes of all segments in one buffer; and the offset of each segment of each row."""
    parts = [text_bytes(s) for s in segments]
    lengths = np.stack([np.diff(o) for _, o in parts], 1)
    offsets = np.zeros(lengths.size + 1, np.int64)
    np.cumsum(lengths.ravel(), out=offsets[1:])
    out = np.empty(offsets[-1], np.uint8)
    for j, (data, where) in enumerate(parts):
        shift = offsets[j : -1 : len(parts)] - where[:-1]
        out[np.repeat(shift, lengths[:, j]) + np.arange(len(data))] = data
    return out, offsets


def _format(batches: Iterator[pa.RecordBatch], control: list[str]) -> Iterator[pa.RecordBatch]:
    part = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = batch.column(0)
        role = batch.column(2)
        head = pc.binary_join_element_wise(OPEN, pc.replace_substring(escape(role, control), "\n", "\\n"), "\n", "")
        body = escape(batch.column(3), control)
        data, where = assemble([head, body, pa.array([CLOSE] * n)])
        code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        last = np.r_[first[1:], n]
        # Code points before each byte: all bytes that do not continue a character.
        points = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        base = np.repeat(points[where[first * 3]], last - first)
        loss = pc.equal(role, LOSS_ROLE).to_numpy(zero_copy_only=False)
        marks = pa.StructArray.from_arrays([pa.array((points[where[1:-1:3]] - base)[loss]), pa.array((points[where[2::3]] - base)[loss])], ["start", "end"])
        seen = np.r_[0, np.cumsum(loss)]
        starts = np.r_[where[first * 3], where[-1]]
        text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(starts), pa.py_buffer(data)).cast(pa.string())
        spans = pa.ListArray.from_arrays(pa.array(np.r_[seen[first], seen[-1]], pa.int32()), marks)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(pa.array(first)) for c in ("conv_id", "turn", "role", "head")), pa.array(np.arange(part, part + len(first))), text, pa.array(last - first, pa.int64()), spans],
            ["conv_id", "turn", "role", "head", "part", "formatted", "n_turns", "loss"],
        )
        part += len(first)


def format_chats(chats: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", control: list[str] | None = None) -> DataFrame:
    """One row for each part of a conversation: conv_id, turn, role and head (of the text) of its first row, part, formatted, n_turns, loss.

    ``loss`` lists spans of ``formatted`` (code points) under the loss mask. The
    parts of one conversation are in order by PARTS. Rows are dealt by range, so
    that one huge conversation is spread over tasks; rows that are equal in all
    columns but ``part`` are in one task, which numbers its parts in order.
    """
    tune(chats.sparkSession)
    control = sorted({OPEN, CLOSE[:-1], *(CONTROL if control is None else control)}, key=lambda c: (-len(c), c))
    said = F.coalesce(F.col(text), F.lit(""))
    rows = chats.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), said.alias("text"), F.substring(said, 1, HEAD).alias("head"))
    n = int(chats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "conv_id", "turn", "role", "head").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = f"conv_id {kind(rows, 'conv_id')}, turn {kind(rows, 'turn')}, role string, head string, part long, formatted string, n_turns long, loss array<struct<start:long,end:long>>"
    return rows.mapInArrow(lambda batches: _format(batches, control), schema)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted part."""
    out = []
    for turn in formatted.split(CLOSE)[:-1]:
        role, _, text = turn.removeprefix(OPEN).partition("\n")
        out.append((unescape(role), unescape(text)))
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now, rows, kind_of = None, [], None

    def emit():
        done = [[r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5]] for r in rows]
        rows.clear()
        types = [kind_of, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types)], names)

    for batch in batches:
        kind_of = batch.column(0).type
        for r in batch.to_pylist():
            if now is None or now[0] != r["conv_id"]:
                if now:
                    rows.append(now)
                if len(rows) >= 1000:
                    yield emit()
                now = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text = r["formatted"]
            for role, said in read_back(text):
                now[1] += 1
                now[2].update(f"{role}\n{said}\n".encode())
            for s in r["loss"]:
                said = unescape(text[s["start"] : s["end"]])
                now[3] += len(said)
                now[4].update(said.encode())
            now[5] += len(text)
    if now:
        rows.append(now)
        yield emit()


def chat_digest(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from what :func:`format_chats` has written.

    The digests run over a conversation from its start to its end; its parts
    pass through one after the other and are never held together.
    """
    rows = formatted.repartition("conv_id").sortWithinPartitions(*PARTS).select("conv_id", "formatted", "loss")
    schema = f"conv_id {kind(formatted, 'conv_id')}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInArrow(_digest, schema)
