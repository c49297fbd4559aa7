"""Vectorised words, hashes and shingles of Arrow string columns.

A word is a maximal run of bytes other than space, \\t, \\n, \\v, \\f and \\r.
Batches are cut into pieces of about ``PIECE`` bytes on row borders, so memory
is bounded by the longest text and not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

PIECE = 2 << 20
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE, _STEP = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
_BASE_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche; wraps around."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base of the rolling hash, or of its inverse."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << n.bit_length())
        size = n if size > 4 * PIECE else size
        row = np.full(size, _BASE_INVERSE if inverse else _BASE, U)
        row[0] = 1
        have = np.multiply.accumulate(row)
        if size > 4 * PIECE:  # one very long text: not kept
            return have[:n]
        _powers[key] = have
    return have[:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of codes[i:j] times base powers from i on, modulo 2^64.

    Equal spans have equal hashes, but long spans can be built that differ and
    have equal ones too: this finds candidates and never decides equality.
    """
    out = np.zeros(len(codes) + 1, U)
    np.cumsum((codes.astype(U) + U(1)) * powers(len(codes)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of [start, end); equal content gives equal hashes anywhere (see prefix_hash)."""
    raw = (prefix[end] - prefix[start]) * powers(len(prefix), True)[start]
    return mix(raw ^ ((end - start).astype(U) * _STEP))


def distinct_hash(column: pa.Array) -> np.ndarray:
    """64-bit content hashes (XXH3) of binary values, made once for each distinct value."""
    held = column.dictionary_encode()
    data, offsets = buffers(held.dictionary)
    raw, at, of = data.tobytes(), offsets.tolist(), xxhash.xxh3_64_intdigest
    known = np.fromiter((of(raw[i:j]) for i, j in zip(at, at[1:], strict=False)), U, len(at) - 1)
    return known[held.indices.to_numpy()] if len(held) else known


def span_digests(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The halves of the 128-bit content hashes (XXH3) of raw[start:end]."""
    of, view = xxhash.xxh3_128_digest, memoryview(raw)
    both = np.frombuffer(b"".join([of(view[i:j]) for i, j in zip(start.tolist(), end.tolist(), strict=True)]), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets from 0); a null is an empty text."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    parts = column.buffers()
    kind = np.dtype(np.int64 if large else np.int32)
    if len(column) == 0 or parts[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(parts[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(parts[2], np.uint8)[offsets[0] : offsets[-1]] if parts[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of the batch of at most limit text bytes, or of one row."""
    column = batch.column(batch.schema.get_field_index(text))
    _, offsets = buffers(column)
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of a column: byte starts and ends, row pointer and 64-bit content hashes."""

    def __init__(self, column: pa.Array, lower: bool = False):
        data, self.offsets = buffers(column)
        if lower:
            data = _LOWER[data]
        self.data, n = data, len(data)
        space = _SPACE[data]
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        edge = self.offsets[:-1]
        before[edge[edge < n]] = True
        last = self.offsets[1:] - 1
        after[last[(last >= 0) & (self.offsets[1:] > self.offsets[:-1])]] = True
        self._word = word = ~space
        self.start = np.flatnonzero(word & before)
        self.end = np.flatnonzero(word & after) + 1
        self.row_ptr = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.row_ptr)
        self.row = np.repeat(np.arange(len(self.count)), self.count)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            upto = np.append(0, np.cumsum(self.end - self.start))
            ink = np.ascontiguousarray(self.data[self._word])
            self._hash = distinct_hash(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(upto), pa.py_buffer(ink)]))
        return self._hash

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of the first word) of each run of k words inside a row."""
        h = self.hash
        if len(h) < k:
            return np.zeros(0, U), np.zeros(0, np.int64)
        # a rolling polynomial over the word hashes, so the cost doesn't grow with k; for the short runs
        # that are used here no pattern of two words cancels more than a few bits of it
        p = np.zeros(len(h) + 1, U)
        np.cumsum(h * powers(len(h)), out=p[1:])
        at = np.flatnonzero(self.row[: len(h) - k + 1] == self.row[k - 1 :])
        return mix((p[at + k] - p[at]) * powers(len(h) + 1, True)[at]), at

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, shingle hash), sorted by row and hash; a row of fewer
        than k words has its whole sequence as its only shingle."""
        h, at = self.grams(k)
        rows = self.row[at] if len(at) else np.zeros(0, np.int64)
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        if len(short):
            w = self.hash
            extra = np.zeros(len(short), U)
            for j in range(k - 1):
                has = self.count[short] > j
                i = np.where(has, self.row_ptr[short] + j, 0)
                extra = np.where(has, mix(extra * _STEP + w[i] + U(j + 1)), extra)
            h, rows = np.concatenate([h, extra]), np.concatenate([rows, short])
        order = np.lexsort((h, rows))
        h, rows = h[order], rows[order]
        if len(h):
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
            h, rows = h[new], rows[new]
        return rows, h


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
