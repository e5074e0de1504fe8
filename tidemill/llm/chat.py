"""Chat formatting by columnar byte assembly.

A turn becomes ``<|turn|>role<|text|>text<|end|>``. Control strings inside roles
and texts get a backslash after their first character, and backslashes are
doubled, so the template's own marks are the only ones and the escape can be
undone. A batch is assembled at once: segment lengths, cumulative offsets and
scatter indices are worked out in numpy, and constants, roles and texts are
copied into one preallocated buffer that becomes the Arrow column.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits

OPEN, SEP, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that a text may hold but a formatted conversation may not, besides the template's own marks.
CONTROL = (OPEN, SEP, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
LEARNED_ROLE = "assistant"

_CONTROL = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(SEP)}(.*?){re.escape(CLOSE)}", re.DOTALL)
#: Rows and characters of whole conversations that are assembled together.
ROWS_AT_ONCE, CHARS_AT_ONCE = 4096, 1 << 25
#: Bytes from which a part is copied by itself, and bytes that index arrays and counts cover at once.
LONG, AT_ONCE = 1 << 12, 1 << 20


def escape(text: str) -> str:
    """Text without control strings; ``unescape`` gives it back."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _scatter(out: np.ndarray, to: np.ndarray, parts: list[bytes]) -> None:
    """Copy each part to its place: long ones as slices, short ones by one index array for some megabytes of them."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    for i in np.flatnonzero(lengths > LONG):
        out[to[i] : to[i] + lengths[i]] = np.frombuffer(parts[i], np.uint8)
    short = np.flatnonzero(lengths <= LONG)
    ends = np.cumsum(lengths[short])
    for some in np.split(short, np.flatnonzero(np.diff(ends // AT_ONCE)) + 1):
        length = lengths[some]
        source = np.frombuffer(b"".join([parts[i] for i in some]), np.uint8)
        out[np.repeat(to[some] - (np.cumsum(length) - length), length) + np.arange(len(source))] = source


def _code_points(out: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Code points that begin before each of some ascending places of a UTF-8 buffer."""
    found, before = np.zeros(len(places), np.int64), 0
    for start in range(0, len(out) + 1, AT_ONCE):
        counts = np.r_[0, np.cumsum((out[start : start + AT_ONCE] & 0xC0) != 0x80, dtype=np.int64)]
        a, b = np.searchsorted(places, [start, start + AT_ONCE])
        found[a:b] = before + counts[places[a:b] - start]
        before += counts[-1]
    return found


def assemble(conv: np.ndarray, roles: list[str], texts: list[str]) -> tuple[pa.Array, list[list[dict]]]:
    """Formatted conversations and their loss spans in code points. ``conv``: numbers from 0 upwards, one for each turn, in order."""
    n, count = len(roles), int(conv[-1]) + 1 if len(conv) else 0
    role, text = [escape(r).encode() for r in roles], [escape(t).encode() for t in texts]
    marks = [np.frombuffer(x.encode(), np.uint8) for x in (OPEN, SEP, CLOSE)]
    size = np.empty((n, 5), np.int64)
    size[:, 0], size[:, 2], size[:, 4] = map(len, marks)
    size[:, 1], size[:, 3] = [len(x) for x in role], [len(x) for x in text]
    ends = np.cumsum(size.ravel())
    at = (ends - size.ravel()).reshape(n, 5)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for k, mark in zip((0, 2, 4), marks):
        out[at[:, k, None] + np.arange(len(mark))] = mark
    _scatter(out, at[:, 1], role)
    _scatter(out, at[:, 3], text)
    # offsets of conversations in the buffer, and code points before each segment
    first = np.searchsorted(conv, np.arange(count + 1))
    offsets = np.r_[at[:, 0], len(out)][first]
    chars = _code_points(out, at.ravel()).reshape(n, 5)
    learned = np.fromiter((r == LEARNED_ROLE for r in roles), bool, n)
    spans: list[list[dict]] = [[] for _ in range(count)]
    for i in np.flatnonzero(learned):
        c = int(conv[i])
        base = chars[first[c], 0]
        spans[c].append({"start": int(chars[i, 3] - base), "end": int(chars[i, 4] - base)})
    kind, width = (pa.string(), np.int32) if len(out) < 2**31 else (pa.large_string(), np.int64)
    column = pa.Array.from_buffers(kind, count, [None, pa.py_buffer(offsets.astype(width).tobytes()), pa.py_buffer(out)])
    return column, spans


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation: id, ``n_turns``, ``formatted``, ``loss_spans`` (code points of the learned texts in ``formatted``).

    Turns follow ``turn``, null first; ties go by role and text, and repeated
    rows are turns of their own. Null roles and texts are empty; rows without an
    id form one conversation. An empty table gives none. Rows are sorted by
    conversation and streamed, so a task holds one conversation besides a batch;
    a conversation is one value of the result, which no other split can give.
    """
    arrow_limits(turns.sparkSession)
    rows = turns.select(F.col(f"`{conv_col}`").alias("c"), F.col(f"`{turn_col}`").alias("n"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("r"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    rows = rows.repartition("c").sortWithinPartitions("c", "n", "r", "t").select("c", "r", "t")

    def done(ids, roles, texts):
        starts = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
        conv = np.zeros(len(ids), np.int64)
        conv[starts[1:]] = 1
        column, spans = assemble(np.cumsum(conv), roles, texts)
        if column.type != pa.string():
            raise ValueError("a formatted conversation of 2 GB and more is no value of a Spark column")
        sizes = np.diff([*starts, len(ids)])
        return pa.RecordBatch.from_arrays(
            [pa.array([ids[i] for i in starts], pa.int64()), pa.array(sizes, pa.int64()), column, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            names=["conv", "n_turns", "formatted", "loss_spans"],
        )

    def run(batches):
        ids, roles, texts = [], [], []
        last = size = 0  # where the last conversation begins, and characters held
        for batch in batches:
            new = batch.column(0).to_pylist()
            for i, c in enumerate(new, len(ids)):
                if i and c != (ids[-1] if i == len(ids) else new[i - len(ids) - 1]):
                    last = i
            for x, column in zip((ids, roles, texts), (new, *map(pa.Array.to_pylist, batch.columns[1:]))):
                x += column
            size += sum(map(len, texts[-len(new) :])) if new else 0
            if (len(ids) >= ROWS_AT_ONCE or size >= CHARS_AT_ONCE) and last:
                yield done(ids[:last], roles[:last], texts[:last])
                ids, roles, texts = ids[last:], roles[last:], texts[last:]
                last, size = 0, sum(map(len, texts))
        if ids:
            yield done(ids, roles, texts)

    made = rows.mapInArrow(run, "conv long, n_turns long, formatted string, loss_spans array<struct<start: bigint, end: bigint>>")
    return made.withColumnRenamed("conv", conv_col)


def read_back(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests of what ``formatted`` and ``loss_spans`` say once they are parsed and unescaped."""

    def run(batches):
        for batch in batches:
            out = []
            for formatted, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = parse(formatted)
                learned = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted)))
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    made = chats.select(F.col(f"`{conv_col}`"), "formatted", "loss_spans").mapInArrow(run, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return made.withColumnRenamed("conv", conv_col)
