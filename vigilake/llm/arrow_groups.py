"""Arrow helpers for tasks that see rows sorted by a key."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], width: int = 1) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) for each run of rows with equal first width columns; only the run at hand is held."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:width] != key:
                if rows:
                    yield key, rows
                key, rows = row[:width], []
            rows.append(row[width:])
    if rows:
        yield key, rows


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def texts_of(column: pa.Array, chars: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in slices of about so many bytes, null as empty, so that a batch is never held as strings at once."""
    start, held, out = 0, 0, []
    for i, value in enumerate(column):
        text = value.as_py() or ""
        out.append(text)
        held += len(text)
        if held >= chars:
            yield start, out
            start, held, out = i + 1, 0, []
    if out:
        yield start, out


def trim() -> None:
    """Memory that this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps its own ways


def give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last one the memory that the task has freed goes back to the system, as Spark keeps Python workers for later stages."""
    try:
        yield from batches
    finally:
        trim()
