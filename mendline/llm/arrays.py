"""Helpers for operators that work on whole Arrow columns: spans of bytes, bit fields, rows with any names."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a field that travel as one row.
PIECE = 1 << 20
#: Most bits of a field (64 MB), so that it fits the driver and every worker.
MOST_BITS = 1 << 29


def positional(df: DataFrame) -> tuple[DataFrame, Column]:
    """``df`` with its columns named by position, so that no name of the user's meets one of ours, and all of them as one struct."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain, F.struct(*plain.columns)


def column_of(df: DataFrame, name: str) -> Column:
    """The column ``name`` of ``df``, in its positional form."""
    return F.col(f"c{df.columns.index(name)}")


def restored(df: DataFrame, names: list[str], *rest: Column | str) -> DataFrame:
    """The struct ``row`` with its fields under their own names again, then ``rest``."""
    fields = (F.col("row").getField(f"c{i}").alias(name) for i, name in enumerate(names))
    return df.select(F.struct(*fields).alias("row"), *rest)


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The spans ``start`` to ``end`` of ``data``, which may overlap, as an Arrow array of a large string or binary type."""
    sizes = (end - start).astype(np.int64)
    offsets = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], sizes)
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))])


def larger(rows: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``least`` bytes or more, up to the last."""
    held, size = [], 0
    for batch in rows:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if whole := pa.Table.from_batches(held).combine_chunks().to_batches() if held else None:
        yield whole[0]


def field_bits(keys: int, each: int = 16) -> int:
    """Size of a field for so many keys: ``each`` bits for a key, as a power of two within bounds."""
    return min(MOST_BITS, max(PIECE, 1 << (max(1, keys * each) - 1).bit_length()))


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The two bits of each 64-bit hash in a field, one row each."""
    low = np.uint64(bits - 1)
    return np.stack([hashes & low, (hashes >> np.uint64(32)) & low]).astype(np.int64)


def put(field: np.ndarray, at: np.ndarray) -> None:
    flat = at.ravel()
    np.bitwise_or.at(field, flat >> 3, np.left_shift(1, flat & 7).astype(np.uint8))


def has(field: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set: always for a hash that was put there, rarely for another."""
    a, b = places(hashes, len(field) * 8)
    return ((field[a >> 3] >> (a & 7)) & (field[b >> 3] >> (b & 7)) & 1).astype(bool)


def pieces_of(*fields: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The pieces of fields of one size that are not empty, compressed: ``piece``, then a column for each field."""
    size = PIECE // 8
    for i in range(len(fields[0]) // size):
        parts = [x[i * size : (i + 1) * size] for x in fields]
        if parts[0].any():
            packed = [pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True)], pa.binary()) for x in parts]
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *packed], names=["piece", *(f"f{k}" for k in range(len(fields)))])


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, PIECE // 8, "zstd", asbytes=True), np.uint8)


def _joined(rows: Iterator[pa.RecordBatch], twice: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of several tasks, sorted by number, as one each. Of two fields the second gets what two tasks have in the first."""
    now, held = None, []

    def out():
        packed = pa.array([pa.compress(held[-1].tobytes(), "zstd", asbytes=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), packed], names=["piece", "bits"])

    for batch in rows:
        for i, *parts in zip(*(c.to_pylist() for c in batch.columns)):
            fresh = [unpacked(x).copy() for x in parts]
            if i != now:
                if now is not None:
                    yield out()
                now, held = i, fresh
                continue
            if twice:
                held[1] |= fresh[1] | (held[0] & fresh[0])
            held[0] |= fresh[0]
    if now is not None:
        yield out()


def joined_field(pieces: DataFrame, bits: int, twice: bool = False) -> np.ndarray:
    """One field from the pieces of all tasks: what was put into ``f0`` or, with ``twice``, what at least two keys were (``f0, f1``).

    A piece is joined in one stream of sorted rows, two pieces in memory at a time. The
    driver receives one row for each piece, ``MOST_BITS`` in all at most.
    """
    several = pieces.repartition("piece").sortWithinPartitions("piece")
    table = several.mapInArrow(partial(_joined, twice=twice), "piece int, bits binary").toArrow()
    field = np.zeros(bits // 8, dtype=np.uint8)
    for i, data in zip(table.column("piece").to_pylist(), table.column("bits").to_pylist()):
        field[i * (PIECE // 8) : (i + 1) * (PIECE // 8)] = unpacked(data)
    return field
