"""Samples of a chunk: an array of doubles, or packed (``binary``, the low byte first), which goes through Spark as one value."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_packed(waveform: DataFrame) -> bool:
    return dict(waveform.dtypes)["samples"] == "binary"


def count(waveform: DataFrame) -> Column:
    """Samples of each chunk."""
    return (F.octet_length("samples") / 8).cast("int") if is_packed(waveform) else F.size("samples")


def part(waveform: DataFrame, first: Column, n: Column) -> Column:
    """``n`` samples of each chunk from its ``first`` on, as the chunk has them."""
    if is_packed(waveform):
        return F.substring("samples", (first * 8 + 1).cast("int"), (n * 8).cast("int"))
    return F.slice("samples", (first + 1).cast("int"), n.cast("int"))


def flat(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each chunk of a column begins and ends in the samples of all, and those."""
    if pa.types.is_list(chunks.type):
        return chunks.offsets.to_numpy(), chunks.values.to_numpy(zero_copy_only=False)
    _, ends, values = chunks.buffers()
    if not len(chunks) or values is None:
        return np.zeros(len(chunks) + 1, np.int32), np.zeros(0)
    ends = np.frombuffer(ends, np.int32)[chunks.offset : chunks.offset + len(chunks) + 1]
    return ends // 8, np.frombuffer(values, "<f8", count=int(ends[-1]) // 8)


def put_together(pieces: Column, packed: bool) -> Column:
    """The samples of all ``at, x`` of an array, in order of ``at``."""
    ordered = F.sort_array(pieces)
    return F.aggregate(ordered, F.lit(b""), lambda a, p: F.concat(a, p["x"])) if packed else F.flatten(F.transform(ordered, lambda p: p["x"]))


def _arrays(chunks: pa.Array) -> pa.Array:
    ends, values = flat(chunks)
    return pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(values[ends[0] :]), mask=chunks.is_null())


def unpacked(column: str) -> Column:
    """A packed column as arrays; a column of Spark's, so that it costs nothing where nobody reads it."""
    return F.arrow_udf(_arrays, "array<double>")(column)


def pack(ends: np.ndarray, samples: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    """A column of packed chunks, of samples side by side; ``ends`` has one number more than there are chunks; those of ``mask`` are null."""
    places = pa.py_buffer((np.asarray(ends) * 8).astype(np.int32))
    valid = None if mask is None else pa.array(~mask).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [valid, places, pa.py_buffer(np.ascontiguousarray(samples, "<f8"))])
