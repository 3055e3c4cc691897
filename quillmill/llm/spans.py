"""Runs of bytes in many texts at once: Arrow text columns as one NumPy buffer, words in it, and words as an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z were lowered: digits, a-z, all beyond ASCII.
WORD_BYTES = np.zeros(256, dtype=bool)
for _from, _to in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    WORD_BYTES[_from:_to] = True


def flat(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, A-Z lowered if asked for; where each text begins and the last ends); null is an empty text."""
    column = pc.fill_null(texts.cast(pa.large_string()).cast(pa.large_binary()), b"")
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    raw = bytes(memoryview(data)[offsets[0] : offsets[-1]]) if data is not None else b""
    return np.frombuffer(raw.lower() if lower else raw, dtype=np.uint8), offsets - offsets[0]


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of member bytes; no run reaches over the end of a text."""
    before, after = np.zeros(len(member), dtype=bool), np.zeros(len(member), dtype=bool)
    before[1:], after[:-1] = member[:-1], member[1:]
    edges = offsets[(offsets > 0) & (offsets < len(member))]
    before[edges] = False
    after[edges - 1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def column(data: np.ndarray, member: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs as a column of binaries."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[member])])
