"""Loading and checking stored vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def floats_of(raw: pa.Array) -> pa.Array:
    """Binary values as lists of 32-bit floats, all at once: their buffer is read as numbers, their offsets count fours.

    Null where there are no bytes, or not a multiple of four.
    """
    sizes = pc.fill_null(pc.binary_length(raw), 0)
    usable = pc.and_(pc.greater(sizes, 0), pc.equal(pc.bit_wise_and(sizes, 3), 0))
    kept = pc.if_else(usable, raw.cast(pa.binary()), pa.scalar(b"", pa.binary()))
    _, offsets, data = kept.buffers()
    ends = np.frombuffer(offsets, np.int32)[kept.offset : kept.offset + len(kept) + 1]
    values = np.frombuffer(data, "<f4", (ends[-1] - ends[0]) // 4, ends[0]) if data is not None and ends[-1] > ends[0] else np.zeros(0, "<f4")
    places = pa.array((ends - ends[0]) // 4, pa.int32())
    return pa.ListArray.from_arrays(places, pa.array(values, pa.float32()), mask=pc.invert(usable))


def bytes_of(vectors: pa.Array) -> pa.Array:
    """Lists of numbers as little-endian 32-bit floats; null and empty lists as no bytes, missing numbers as NaN."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    values = pc.fill_null(vectors.flatten().cast(pa.float32()), float("nan")).to_numpy(zero_copy_only=False).astype("<f4")
    ends = np.append(0, 4 * np.cumsum(sizes, dtype=np.int64)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


@F.arrow_udf(ArrayType(FloatType()))
def _from_bytes(raw: pa.Array) -> pa.Array:
    return floats_of(raw)


@F.arrow_udf(BinaryType())
def _to_bytes(vectors: pa.Array) -> pa.Array:
    return bytes_of(vectors)


def decode_vectors(rows: DataFrame, raw: str, kind: Column, into: str) -> DataFrame:
    """Decode stored vectors: ``kind`` says 'float32' or 'json' for every row.

    The format is told and not guessed from the first byte, which a raw float may share with
    JSON. Empty or undecodable values become null.
    """
    text = F.from_json(F.col(raw).cast("string"), "array<float>")
    decoded = F.when(kind == "json", text).otherwise(_from_bytes(F.when(kind == "float32", F.col(raw))))
    return rows.withColumn(into, F.when(F.size(decoded) > 0, decoded))


def encode_vectors(rows: DataFrame, vector: str, into: str) -> DataFrame:
    return rows.withColumn(into, _to_bytes(F.col(vector)))


def check_dimension(docs: DataFrame, dim: int, column: str = "title_vector") -> DataFrame:
    """Fail on a vector of another size, before it is written to an index."""
    size = F.size(column)
    wrong = F.col(column).isNotNull() & (size > 0) & (size != dim)
    message = F.concat(F.lit(f"{column}: expected {dim} values, got "), size.cast("string"))
    return docs.withColumn(column, F.when(wrong, F.raise_error(message).cast("array<float>")).otherwise(F.col(column)))
