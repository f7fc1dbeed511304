"""The codec of stored vectors, without Spark."""

import numpy as np
import pyarrow as pa
import pytest

from quillrank.operators.vector_columns import bytes_of, floats_of


def packed(*values):
    return np.array(values, "<f4").tobytes()


BINARY = [packed(1.0, -2.5), b"", None, b"abc", packed(0.0), b"12345678", packed(3.0, 4.0, 5.0), None, b"\x00" * 7]
FLOATS = [[1.0, -2.5], None, None, None, [0.0], np.frombuffer(b"12345678", "<f4").tolist(), [3.0, 4.0, 5.0], None, None]


@pytest.mark.parametrize("start,stop", [(0, 9), (1, 9), (2, 5), (3, 4), (4, 4), (6, 9)])
@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
def test_bytes_to_floats(start, stop, kind):
    assert floats_of(pa.array(BINARY, kind).slice(start, stop - start)).to_pylist() == FLOATS[start:stop]


@pytest.mark.parametrize("start,stop", [(0, 6), (1, 6), (2, 3), (3, 3)])
@pytest.mark.parametrize("kind", [pa.float32(), pa.float64()])
def test_floats_to_bytes(start, stop, kind):
    lists = [[1.0, -2.5], [], None, [0.25], [None, 2.0], [9.0] * 5]
    found = bytes_of(pa.array(lists, pa.list_(kind)).slice(start, stop - start)).to_pylist()
    expected = [np.array([np.nan if x is None else x for x in v or ()], "<f4").tobytes() for v in lists[start:stop]]
    assert found == expected


def test_round_trip():
    rng = np.random.default_rng(1)
    lists = [rng.normal(size=n).astype(np.float32).tolist() for n in (64, 64, 1, 3)]
    assert floats_of(bytes_of(pa.array(lists, pa.list_(pa.float32())))).to_pylist() == lists
