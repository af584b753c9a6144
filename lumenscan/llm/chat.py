"""Chat formatting by columnar byte assembly.

A turn is written ``<turn>role\\ntext</turn>\\n``. Inside roles and texts a backslash is put before every backslash,
``<turn>`` and ``</turn>`` (and a line end of a role is ``\\n`` spelled out), so no content can pass for a mark and the
text can be read back exactly. The loss mask is the byte span of every assistant text.

Rows are shuffled by conversation and sorted; a batch of them is assembled at once in numpy: segment lengths, cumulative
offsets and scatter indices of headers and contents, copied into one preallocated buffer that becomes the Arrow column.
A conversation that goes on in the next slice of about ``SLICE`` bytes goes on in a further part, so a task holds one
slice, however long a conversation is; only a single longer text is held whole. A hot conversation is one sorted stream: the order of its turns is what is computed.

Edge cases: null role or text counts as empty; turns are ordered by turn (null first), then role and text, so ties and
repeated rows have one order and all count; a null conv_id is a conversation of its own. Very long texts are formatted whole. No rows give no rows. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.llm._common import text_chunks

SLICE = 4 << 20
OPEN, CLOSE, LINE = b"<turn>", b"</turn>\n", b"\n"
_TURN = re.compile(r"<turn>((?:[^\\\n]++|\\.)*+)\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def _bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = col.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def escaped(col: pa.Array, line_ends: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of col with its control strings escaped."""
    b, offsets = _bytes_of(col)
    special = b == 92
    at = np.flatnonzero(b == 60)
    row_end = offsets[np.searchsorted(offsets, at, side="right")] if len(at) else at
    for mark in (OPEN, CLOSE[:-1]):
        fits = at[at + len(mark) <= row_end]
        same = np.ones(len(fits), dtype=bool)
        for k, c in enumerate(mark):
            same &= b[fits + k] == c
        special[fits[same]] = True
    if line_ends:
        special |= b == 10
        b = np.where(b == 10, np.uint8(110), b)
    before = np.append(0, np.cumsum(special))
    out = np.empty(len(b) + int(before[-1]), np.uint8)
    to = np.arange(len(b)) + before[1:]
    out[to] = b
    out[to[special] - 1] = 92
    return out, offsets + before[offsets]


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copies segment i of data to out[at[i]:]."""
    lengths = np.diff(offsets)
    out[np.repeat(at - offsets[:-1], lengths) + np.arange(len(data))] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all formatted turns; offsets of turns; begin and end of each text."""
    (r, ro), (t, to) = escaped(roles, True), escaped(texts, False)
    n_r, n_t = np.diff(ro), np.diff(to)
    offsets = np.append(0, np.cumsum(len(OPEN) + n_r + len(LINE) + n_t + len(CLOSE)))
    out = np.empty(int(offsets[-1]), np.uint8)
    begin = offsets[:-1]
    text = begin + len(OPEN) + n_r + len(LINE)
    for at, what in ((begin, OPEN), (text - 1, LINE), (text + n_t, CLOSE)):
        out[at[:, None] + np.arange(len(what))] = np.frombuffer(what, np.uint8)
    _scatter(out, begin + len(OPEN), r, ro)
    _scatter(out, text, t, to)
    return out, offsets, text, text + n_t


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, formatted, loss (byte spans in formatted): one row a conversation and part, parts in order.

    Partitions are sorted by conversation and part."""
    ordered = rows.selectExpr("cast(conv_id as long) conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = (None,), -1
        for b in (part for batch in batches for part in text_chunks(batch, "text", SLICE)):
            ids = b.column("conv_id").to_pylist()
            out, offsets, begin, end = assemble(b.column("role"), b.column("text"))
            first = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            cuts = np.array([*first, len(ids)])
            parts = []
            for i in first:
                part = part + 1 if (ids[i],) == last else 0
                last = (ids[i],)
                parts.append(part)
            where = offsets[cuts]
            assistant = np.array([x == "assistant" for x in b.column("role").to_pylist()], dtype=bool)
            owner = np.repeat(np.arange(len(first)), np.diff(cuts))
            spans = pa.StructArray.from_arrays([pa.array((x - where[owner])[assistant], pa.int32()) for x in (begin, end)], fields=list(_SPAN))
            n_spans = np.bincount(owner[assistant], minlength=len(first))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in first], pa.int64()),
                    pa.array(parts, pa.int64()),
                    pa.array(np.diff(cuts), pa.int64()),
                    pa.StringArray.from_buffers(len(first), pa.py_buffer(where.astype(np.int32)), pa.py_buffer(out)),
                    pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_spans)), pa.int32()), spans),
                ],
                names=["conv_id", "part", "n_turns", "formatted", "loss"],
            )

    return ordered.mapInArrow(run, "conv_id long, part long, n_turns long, formatted string, loss array<struct<start:int,end:int>>")


def unescaped(s: str, line_ends: bool = False) -> str:
    return _ESCAPED.sub(lambda m: "\n" if line_ends and m[1] == "n" else m[1], s) if "\\" in s else s


def parse_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        yield unescaped(m[1], True), unescaped(m[2])
        at = m.end()


class _Digest:
    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, spans: list[dict]) -> None:
        self.chars += len(formatted)
        for role, text in parse_turns(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        raw = formatted.encode()
        for s in spans:
            text = unescaped(raw[s["start"] : s["end"]].decode())
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What format_conversations wrote, read back: one row a conversation. Keeps the order of its partitions."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for b in batches:
            done = []
            for conv_id, part, text, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss"))):
                if part == 0:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv_id)
                now.add(text, spans)
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*done)))))
        if now is not None:
            yield pa.RecordBatch.from_pydict(dict(zip(names, ([x] if x is not None else pa.array([None], pa.int64()) for x in now.row()))))

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_control_conversation(rows: DataFrame) -> DataFrame:
    """rows and conversation -7, whose texts have control strings."""
    text = "\\### Assistant: </turn> ok"
    extra = rows.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return rows.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text").unionByName(extra)
