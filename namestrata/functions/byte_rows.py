"""Byte strings of an Arrow batch, read for all rows at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class ByteRows:
    """A BINARY column as one buffer; ``start`` and ``end`` bound each row's bytes and may be moved."""

    def __init__(self, column: pa.Array):
        if not pa.types.is_binary(column.type):
            column = column.cast(pa.binary())
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
        data = column.buffers()[2]
        self.data = b"" if data is None else data.to_pybytes()
        # Rows that end too early read from the front, so there must be as much as a number takes.
        self.flat = np.frombuffer(self.data if len(self.data) >= 8 else self.data + bytes(8), np.uint8)
        self.known = np.asarray(column.is_valid())
        self.start = ends[:-1].astype(np.int64)
        self.end = np.where(self.known, ends[1:], self.start)

    @property
    def size(self) -> np.ndarray:
        return self.end - self.start

    def uint(self, place, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Unsigned big-endian integers at ``place`` in every row, and where there are as many bytes."""
        at = self.start + place
        there = at + width <= self.end
        at = np.where(there, at, 0)
        number = self.flat[at].astype(np.int64)
        for i in range(1, width):
            number = number << 8 | self.flat[at + i]
        return number, there

    def pieces(self, place, width, known: np.ndarray) -> pa.Array:
        """``width`` bytes from ``place`` on, fewer at the end of a row; NULL where not ``known``."""
        start = np.minimum(self.start + place, self.end)
        end = np.where(known, np.minimum(start + width, self.end), start)
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
        data = self.data
        body = b"".join([data[a:b] for a, b in zip(start.tolist(), end.tolist())])
        valid = None if known.all() else pa.array(known, pa.bool_()).buffers()[1]
        return pa.Array.from_buffers(pa.binary(), len(start), [valid, pa.py_buffer(offsets), pa.py_buffer(body)])


def numbers(values: np.ndarray, known: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind, mask=~known)
