"""Chat formatting by columnar byte assembly.

Turns are dealt by conversation and sorted by turn, then assembled a batch at a time: bytes of
all roles and texts of the batch are escaped at once, the lengths of all segments (headers,
contents, ends) are computed in numpy, their cumulative sums give each segment's place, and
scatter indices copy headers and contents into one preallocated buffer, which becomes the Arrow
column without a copy. No Python code runs per character and little per turn.

A turn is ``### role<newline>text</turn><newline>``. Inside roles and texts a backslash stands
before every ``\\``, ``#`` and ``<`` (and, in roles, before a newline), so the control strings
never occur in contents, and dropping the backslashes gives the contents back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, MID, END = b"### ", b"\n", b"</turn>\n"
LEARNED = "assistant"
SCHEMA = (
    "conv_id long, part long, n_turns long, formatted string, "
    "loss_starts array<long>, loss_lengths array<long>"
)
_TURN = re.compile(rb"### ((?:[^\\\n]|\\.)*)\n((?:[^\\<]|\\.)*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(rb"\\(.)", re.DOTALL)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of a string column; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and len(column) else np.empty(0, np.uint8)
    if len(column) == 0:
        return whole[:0], np.zeros(0, np.int64)
    return whole[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def escaped(data: np.ndarray, ends: np.ndarray, newline: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with a backslash before each control byte, and the new ends."""
    control = (data == 92) | (data == 35) | (data == 60)
    if newline:
        control |= data == 10
    shift = np.cumsum(control)
    out = np.full(len(data) + (int(shift[-1]) if len(data) else 0), 92, np.uint8)
    out[np.arange(len(data)) + shift] = data
    more = np.concatenate(([0], shift))
    return out, ends + more[ends]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of all segments, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def assembled(
    conv: np.ndarray, roles: pa.Array, texts: pa.Array, learned: str = LEARNED
) -> tuple[np.ndarray, np.ndarray, list, list, np.ndarray]:
    """Buffer, ends per conversation, loss starts and lengths (bytes), turns per conversation.

    ``conv`` numbers the conversations of the batch from 0 in order.
    """
    n = len(conv)
    role, role_ends = escaped(*_bytes(roles), newline=True)
    text, text_ends = escaped(*_bytes(texts), newline=False)
    role_size, text_size = np.diff(role_ends, prepend=0), np.diff(text_ends, prepend=0)
    fixed = (np.frombuffer(HEAD, np.uint8), np.frombuffer(MID, np.uint8), np.frombuffer(END, np.uint8))
    sizes = np.empty((n, 5), np.int64)
    sizes[:, 0], sizes[:, 2], sizes[:, 4] = map(len, fixed)
    sizes[:, 1], sizes[:, 3] = role_size, text_size
    ends = np.cumsum(sizes.ravel()).reshape(n, 5)
    starts = ends - sizes
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for slot, value in zip((0, 2, 4), fixed, strict=True):
        out[(starts[:, slot, None] + np.arange(len(value))).ravel()] = np.tile(value, n)
    out[_spread(starts[:, 1], role_size)] = role
    out[_spread(starts[:, 3], text_size)] = text
    turns = np.bincount(conv)
    last = np.cumsum(turns) - 1
    conv_ends = ends[last, -1]
    base = np.concatenate(([0], conv_ends[:-1]))[conv]
    mask = np.array([r.as_py() == learned for r in roles], bool)
    return out, conv_ends, starts[:, 3] - base, np.where(mask, text_size, -1), turns


def _table(batch: pa.RecordBatch, part: int, learned: str) -> pa.RecordBatch:
    """Formatted rows of the whole conversations in a batch of sorted turns."""
    ids = batch.column(0)
    keys = ids.fill_null(0).to_numpy(zero_copy_only=False)
    null = ids.is_null().to_numpy(zero_copy_only=False)
    new = np.r_[True, (keys[1:] != keys[:-1]) | (null[1:] != null[:-1])]
    conv = np.cumsum(new) - 1
    out, ends, starts, lengths, turns = assembled(conv, batch.column(2), batch.column(3), learned)
    offsets = np.concatenate(([0], ends))
    formatted = pa.Array.from_buffers(
        pa.large_string(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)]
    )
    masked = lengths >= 0
    per = np.bincount(conv[masked], minlength=len(ends))
    list_offsets = pa.array(np.concatenate(([0], np.cumsum(per))), pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(np.flatnonzero(new))),
            pa.array(np.full(len(ends), part, np.int64)),
            pa.array(turns.astype(np.int64)),
            formatted.cast(pa.string()),
            pa.ListArray.from_arrays(list_offsets, pa.array(starts[masked])),
            pa.ListArray.from_arrays(list_offsets, pa.array(lengths[masked])),
        ],
        names=["conv_id", "part", "n_turns", "formatted", "loss_starts", "loss_lengths"],
    )


def format_conversations(
    turns: DataFrame, learned: str = LEARNED, part_bytes: int = 16 << 20
) -> DataFrame:
    """One row per conversation: conv_id, part, n_turns, formatted, loss_starts, loss_lengths.

    Turns go by ``turn`` (nulls first), then role and text. Null roles and texts are empty,
    rows with a null conv_id form one conversation, equal rows are separate turns, an empty
    table gives no rows, further columns are not read. Loss spans are byte ranges of the
    formatted text's contents whose role is ``learned``. A conversation of more than
    ``part_bytes`` is given in several rows, ``part`` 0, 1, ..., one after the other in the
    same partition; nothing is dropped, and no task holds more than a part of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        part, of, size = 0, None, 0

        def joined() -> pa.RecordBatch:
            return pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

        for batch in batches:
            step = max(1, min(4096, batch.num_rows * part_bytes // max(1, batch.nbytes)))
            for low in range(0, batch.num_rows, step):
                piece = batch.slice(low, step)
                ids = piece.column(0).to_pylist()
                if waiting and ids[0] != of:
                    yield _table(joined(), part, learned)
                    waiting, part, size = [], 0, 0
                cut = len(ids)
                while cut and ids[cut - 1] == ids[-1]:
                    cut -= 1
                if cut:  # all but the last conversation are whole now
                    waiting.append(piece.slice(0, cut))
                    whole = joined()
                    if part:  # the first one goes on from its earlier parts
                        first = whole.column(0).to_pylist()
                        n = next((i for i, x in enumerate(first) if x != first[0]), len(first))
                        yield _table(whole.slice(0, n), part, learned)
                        whole = whole.slice(n)
                    if whole.num_rows:
                        yield _table(whole, 0, learned)
                    waiting, part, size = [], 0, 0
                waiting.append(piece.slice(cut))
                of = ids[-1]
                size += piece.nbytes
                if size > part_bytes:
                    yield _table(joined(), part, learned)
                    waiting, part, size = [], part + 1, 0
        if waiting:
            yield _table(joined(), part, learned)

    slim = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").alias("role"),
        F.col("text").alias("text"),
    )
    dealt = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, SCHEMA)


def unescaped(content: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", content)


def parsed(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of the turns of a formatted conversation."""
    return [(unescaped(r), unescaped(t)) for r, t in _TURN.findall(formatted)]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, read from the formatted text and its loss spans.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline per turn), loss_chars,
    loss_sha256 (code points and digest of the texts under the loss spans, without their
    escapes) and formatted_chars. Parts of a conversation follow each other, so hashes run on
    and memory holds one part.
    """
    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            for conv, part, _, text, starts, lengths in zip(
                *[c.to_pylist() for c in batch.columns], strict=True
            ):
                if part == 0:
                    if state:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                data = text.encode()
                state[5] += len(text)
                for role, said in parsed(data):
                    state[1] += 1
                    state[2].update(role + b"\n" + said + b"\n")
                for low, size in zip(starts, lengths, strict=True):
                    said = unescaped(data[low : low + size])
                    state[3] += len(said.decode())
                    state[4].update(said)
            if done:
                yield _digests(done)
        if state:
            yield _digests([state])

    return formatted.mapInArrow(run, schema)


def _digests(states: list[list]) -> pa.RecordBatch:
    columns = list(zip(*states, strict=True))
    arrays = [
        pa.array(columns[0], pa.int64()),
        pa.array(columns[1], pa.int64()),
        pa.array([h.hexdigest() for h in columns[2]]),
        pa.array(columns[3], pa.int64()),
        pa.array([h.hexdigest() for h in columns[4]]),
        pa.array(columns[5], pa.int64()),
    ]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays(arrays, names)
