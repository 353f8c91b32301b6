r"""Chat formatting by columnar byte assembly.

A turn becomes <turn ROLE>TEXT</turn> and a newline. In roles and texts a backslash goes before each
of \ < > , so no text can look like a mark and taking the backslashes away gives it back.
Segment lengths, cumulative offsets and scatter indices of a whole batch are computed in numpy, and
marks and contents are copied into one preallocated buffer that becomes the Arrow column.

Rows are range-partitioned by (conversation, turn), so a conversation with a third of all turns is
formatted by many tasks. A conversation comes out as one row, or as several consecutive parts where
it crosses a batch or a task; each part has the byte spans of its assistant texts (the loss mask).

Defined results: a null text or role is empty; null conversation ids form one conversation; turns
with one number are ordered by role and text; repeated rows are turns of their own; an empty
table gives an empty table; turns are put together some megabytes at a time, so very long texts need no buffer of more than one
of them; other columns are ignored, whatever their names.
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

OPEN, CLOSE, END = b"<turn ", b">", b"</turn>\n"
LOSS_ROLE = "assistant"
PART_BYTES = 8 << 20
#: Bytes of text that are assembled at once.
BATCH_BYTES = 64_000_000
PARTS = "conv_id long, first_turn long, first_order string, formatted string, loss_starts array<long>, loss_sizes array<long>"


def escaped(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column with a backslash before each of \\ < >, and the offsets of its rows in them."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    at = at - at[0]
    marked = (raw == 0x5C) | (raw == 0x3C) | (raw == 0x3E)
    before = np.concatenate([[0], np.cumsum(marked)])
    out = np.full(len(raw) + int(before[-1]), 0x5C, np.uint8)
    out[np.arange(len(raw)) + before[1:]] = raw
    return out, at + before[at]


def _scatter(out: np.ndarray, to: np.ndarray, source: np.ndarray, at: np.ndarray) -> None:
    """Copies row i of source (bytes at[i]:at[i+1]) to out[to[i]:]."""
    sizes = np.diff(at)
    out[np.repeat(to - at[:-1], sizes) + np.arange(len(source))] = source


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all formatted turns, the offset of each turn in it, and where its text starts and how long it is."""
    roles, r_at = escaped(role)
    texts, t_at = escaped(text)
    n = len(role)
    r_size, t_size = np.diff(r_at), np.diff(t_at)
    ends = np.cumsum(len(OPEN) + r_size + len(CLOSE) + t_size + len(END))
    start = np.concatenate([[0], ends])[:n]
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for k, mark, to in ((0, OPEN, start), (1, CLOSE, start + len(OPEN) + r_size), (2, END, ends - len(END))):
        out[(to[:, None] + np.arange(len(mark))).ravel()] = np.tile(np.frombuffer(mark, np.uint8), n)
    _scatter(out, start + len(OPEN), roles, r_at)
    begin = start + len(OPEN) + r_size + len(CLOSE)
    _scatter(out, begin, texts, t_at)
    return out, np.concatenate([start, ends[-1:]]), begin, t_size


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most BATCH_BYTES of text, or of one turn."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(3).cast(pa.binary())), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH_BYTES, side="right")))
            yield batch.slice(at, end - at)
            at = end


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _bounded(batches):
        conv, turn, role, text = (batch.column(k) for k in range(4))
        out, at, begin, size = assemble(role, text)
        ids = conv.to_numpy(zero_copy_only=False)
        null = np.asarray(conv.is_null())
        new = np.ones(len(ids), bool)
        new[1:] = (null[1:] != null[:-1]) | (~null[1:] & (ids[1:] != ids[:-1]))
        full = at[:-1] // PART_BYTES
        new[1:] |= full[1:] != full[:-1]
        first = np.flatnonzero(new)
        loss = np.array([r == LOSS_ROLE for r in role.to_pylist()], bool)
        spans = np.flatnonzero(loss)
        cut = np.searchsorted(spans, np.append(first, len(ids)))
        part = np.searchsorted(first, spans, side="right") - 1
        offsets = pa.array(np.append(at[first], at[-1]), pa.int64())
        formatted = pa.LargeStringArray.from_buffers(len(first), offsets.buffers()[1], pa.py_buffer(out.tobytes()))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.int64()))
        order = [f"{role[int(i)].as_py() or ''}\x00{hashlib.md5((text[int(i)].as_py() or '').encode()).hexdigest()}" for i in first]
        yield pa.RecordBatch.from_arrays(
            [conv.take(pa.array(first)), turn.take(pa.array(first)), pa.array(order, pa.string()), formatted.cast(pa.string()), lists(begin[spans] - at[first][part]), lists(size[spans])],
            names=["conv_id", "first_turn", "first_order", "formatted", "loss_starts", "loss_sizes"],
        )


def format_chats(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text), one a turn, to formatted parts in the order (conv_id, first_turn, first_order)."""
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    # equal turns are ordered by role and text digest, which also lets a hot (conversation, turn) be cut between tasks
    keys = ["conv_id", F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.md5(F.coalesce("text", F.lit("")))]
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return turns.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(_format, PARTS)


_TURN = re.compile(rb"<turn ((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.)*)</turn>\n", re.DOTALL)
_UNESCAPE = re.compile(rb"\\(.)", re.DOTALL)
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def unescaped(raw: bytes) -> bytes:
    return _UNESCAPE.sub(rb"\1", raw) if b"\\" in raw else raw


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """The (role, text) of each turn; a text that is not whole turns is an error."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no whole turn at byte {at}")
    return out


class _Digest:
    def __init__(self, conv) -> None:
        self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str, starts: list[int], sizes: list[int]) -> None:
        raw = formatted.encode()
        self.chars += len(formatted)
        for role, text in parse(raw):
            self.n += 1
            self.turns.update(role + b"\n" + text + b"\n")
        for start, size in zip(starts, sizes, strict=True):
            text = unescaped(raw[start : start + size])
            self.loss.update(text)
            self.loss_chars += len(text.decode())

    def row(self) -> dict:
        return {"conv_id": self.conv, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    now, done = None, []
    for batch in batches:
        for conv, _, _, formatted, starts, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.conv != conv:
                done += [now.row()] if now else []
                now = _Digest(conv)
            now.add(formatted, starts, sizes)
        if len(done) > 5000:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    done += [now.row()] if now else []
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


def read_back(parts: DataFrame) -> DataFrame:
    """Digests per conversation, parsed from the formatted parts in a stream: what is held is one part and the running digests.

    A digest over a conversation is sequential, so its parts do pass one task, but as a sorted stream."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["conv_id", F.col("first_turn").asc_nulls_first(), "first_order"]
    return parts.repartition(n, "conv_id").sortWithinPartitions(*keys).mapInArrow(_read_back, DIGESTS)
