"""Columns as the walk over flows reads them."""

import pyarrow as pa

from namestrata.operators import reassembly


def test_column_values_are_those_of_to_pylist():
    columns = [
        pa.array([1, -2, 3 << 40], pa.int64()), pa.array([1, None, 3], pa.int32()), pa.array([True, False, True]),
        pa.array(["a", "", "ä", "a"], pa.string()), pa.array([b"", b"\0x", b"", b"yy"], pa.binary()),
        pa.array([b"", b""], pa.binary()), pa.array([None, b"a"], pa.binary()), pa.array([], pa.binary()),
    ]
    for column in columns:
        for piece in (column, column.slice(1), column.slice(1, 1), column.slice(0, 0)):
            got = reassembly.column_values(piece)
            assert got == piece.to_pylist() and [type(v) for v in got] == [type(v) for v in piece.to_pylist()]
