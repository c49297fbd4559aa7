"""Helpers for mapInArrow: rows in, batches of bounded size out."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

LIMIT = 4 << 20


def batches(rows: Iterable[tuple], schema: pa.Schema, limit: int = LIMIT) -> Iterator[pa.RecordBatch]:
    """Record batches of about limit bytes from tuples."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 32 + sum(len(x) for x in row if isinstance(x, bytes | str))
        if size > limit:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def rows(arriving: Iterable[pa.RecordBatch], step: int = 512) -> Iterator[tuple]:
    """Tuples of the columns in order, converted a few at a time."""
    for batch in arriving:
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean", pa.float64(): "double", pa.int16(): "short"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def fields(**kinds: str) -> pa.Schema:
    """fields(a='long', b='string') as an Arrow schema."""
    by = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "short": pa.int16()}
    return pa.schema([(k, by[v]) for k, v in kinds.items()])


def thrifty(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a task's freed memory goes back to the system: Python workers
    outlive their tasks, and several of them wait beside each executor's own process."""

    def kept(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(arriving)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return kept
