"""Chat formatting: turns laid out by a template, assembled byte by byte in numpy.

A turn is ``### role: text</turn>`` and a line feed. Inside texts the control strings ``### `` and
``</turn>`` and the backslash get a backslash before them, inside roles every backslash, ``:``,
``#`` and ``<``. So an unescaped control string is always the template's, and reading back gives
roles and texts unchanged. Assistant texts are the ones trained on; their spans are the loss mask.

Turns are formatted wherever their rows lie: segment lengths, cumulative offsets and scatter
indices are computed for a whole batch, and headers, contents and escapes are copied into one
preallocated buffer, which becomes the Arrow column. Only the formatted turns are then shuffled
and sorted, and a conversation is written in parts of bounded size: a conversation of any length
streams through a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template.
OPEN, AFTER_ROLE, CLOSE, ESCAPE = b"### ", b": ", b"</turn>\n", b"\\"
TEXT_CONTROLS = (b"\\", b"### ", b"</turn>")
ROLE_CONTROLS = (b"\\", b":", b"#", b"<")
TRAINED_ROLE = "assistant"
PART_BYTES = 1 << 20

_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def _flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array in a row, and the offset of each string in them; null is empty."""
    strings = pa.array(["" if s is None else s for s in strings.to_pylist()], pa.large_string())
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    return bytes_, offsets - offsets[0]


def _starts(data: np.ndarray, control: bytes) -> np.ndarray:
    """Where ``control`` begins in ``data``."""
    n = max(0, len(data) - len(control) + 1)
    hits = np.ones(n, bool)
    for i, byte in enumerate(control):
        hits &= data[i : i + n] == byte
    return np.flatnonzero(hits)


def escaped(strings: pa.Array, controls: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The strings with a backslash before each control string, flat, and their offsets."""
    data, offsets = _flat(strings)
    marks = []
    for control in controls:
        at = _starts(data, control)
        row = np.searchsorted(offsets, at, side="right") - 1
        marks.append(at[at + len(control) <= offsets[row + 1]] if len(at) else at)  # not across two strings
    marks = np.unique(np.concatenate(marks))
    extra = np.zeros(len(data) + 1, np.int64)
    extra[marks + 1] = 1
    shift = np.cumsum(extra)  # escapes before each byte
    out = np.empty(len(data) + len(marks), np.uint8)
    before_self = shift[:-1].copy()
    before_self[marks] += 1  # a control byte stands after its own escape
    out[np.arange(len(data)) + before_self] = data
    out[marks + shift[marks]] = ESCAPE[0]
    return out, offsets + shift[offsets]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """One formatted turn per row, and first and end code point of its text in the turn."""
    role, role_at = escaped(roles, ROLE_CONTROLS)
    text, text_at = escaped(texts, TEXT_CONTROLS)
    n = len(role_at) - 1
    role_len, text_len = np.diff(role_at), np.diff(text_at)
    lengths = len(OPEN) + role_len + len(AFTER_ROLE) + text_len + len(CLOSE)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)

    def put(fixed: bytes, at: np.ndarray) -> None:
        out[(at[:, None] + np.arange(len(fixed))).ravel()] = np.tile(np.frombuffer(fixed, np.uint8), n)

    def scatter(data: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> None:
        out[np.repeat(at - offsets[:-1], sizes) + np.arange(len(data))] = data

    role_to = starts + len(OPEN)
    text_to = role_to + role_len + len(AFTER_ROLE)
    put(OPEN, starts)
    scatter(role, role_len, role_at, role_to)
    put(AFTER_ROLE, role_to + role_len)
    scatter(text, text_len, text_at, text_to)
    put(CLOSE, ends - len(CLOSE))
    turns = pa.Array.from_buffers(
        pa.large_string(), n, [None, pa.py_buffer(np.append(starts, len(out)).astype(np.int64)), pa.py_buffer(out)]
    )
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])  # code points before each byte
    return turns, points[text_to] - points[starts], points[text_to + text_len] - points[starts]


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, formatted, first, end: each row formatted by itself, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, first, end = assemble(batch.column(2), batch.column(3))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), done.cast(pa.string()), pa.array(first, pa.int64()), pa.array(end, pa.int64())],
                names=["conv_id", "turn", "role", "formatted", "first", "end"],
            )

    wanted = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return wanted.mapInArrow(run, "conv_id long, turn long, role string, formatted string, first long, end long")


def format_conversations(turns: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """conv_id, part, formatted, loss (list of first and end code points in the part).

    The parts of a conversation in order are its formatted text; a part holds whole turns and ends
    with the first that fills ``part_bytes``. Rows stand by turn, null first, then by their
    formatted text, so that ties have one order; repeated rows stay. Null roles and texts are
    empty. A null conv_id is a conversation like any other. Parts come sorted within partitions.
    Only conv_id, turn, role and text are read.
    """
    schema = "conv_id long, part long, formatted string, loss array<struct<first:long,end:long>>"
    done = format_turns(turns).withColumn("trained", F.coalesce(F.col("role") == TRAINED_ROLE, F.lit(False))).drop("role")
    done = done.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, texts, size, points, loss = None, -1, [], 0, 0, []
        for batch in batches:
            out = []
            for conv_id, text, first, end, trained in zip(
                *(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "formatted", "first", "end", "trained")), strict=True
            ):
                if part < 0 or conv_id != conv or size >= part_bytes:
                    if part >= 0:
                        out.append((conv, part, "".join(texts), loss))
                    part = part + 1 if part >= 0 and conv_id == conv else 0
                    conv, texts, size, points, loss = conv_id, [], 0, 0, []
                texts.append(text)
                if trained:
                    loss.append({"first": points + first, "end": points + end})
                size += len(text.encode("utf-8"))
                points += len(text)
            if out:
                yield _parts(out)
        if part >= 0:
            yield _parts([(conv, part, "".join(texts), loss)])

    return done.mapInArrow(run, schema)


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "part", "formatted", "loss"]
    )


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn; anything that is not a turn is an error."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at code point {at}")
        turns.append((_ESCAPED.sub(r"\1", found[1]), _ESCAPED.sub(r"\1", found[2])))
        at = found.end()
    return turns


def read_back(parts: DataFrame, ordered: bool = False) -> DataFrame:
    """Digests of what the formatted conversations hold, parsed and unescaped.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_parts. ``ordered``
    says that the parts of a conversation already follow each other within a partition.
    """
    if not ordered:
        parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_parts long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, open_ = None, False
        turns = loss = None
        counts = [0, 0, 0, 0]

        def close() -> tuple:
            return conv, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2], counts[3]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string() if "sha" in n else pa.int64() for n in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            out = []
            for conv_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if not open_ or conv_id != conv:
                    if open_:
                        out.append(close())
                    conv, open_, turns, loss, counts = conv_id, True, hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0]
                for role, said in parse_turns(text):
                    turns.update(f"{role}\n{said}\n".encode("utf-8"))
                    counts[0] += 1
                for span in spans:
                    said = _ESCAPED.sub(r"\1", text[span["first"] : span["end"]])
                    loss.update(said.encode("utf-8"))
                    counts[1] += len(said)
                counts[2] += len(text)
                counts[3] += 1
            if out:
                yield batch_of(out)
        if open_:
            yield batch_of([close()])

    return parts.select("conv_id", "part", "formatted", "loss").mapInArrow(run, schema)
