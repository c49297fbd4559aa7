"""Line dedup by a segment-partition edit join.

A line of n characters is cut into t + 1 segments.  A line within t edits
holds one of them unchanged, near the same place and at a length that differs
by t at most.  Each line therefore offers its segments and probes the
substrings that may equal a segment of a line as long as itself or shorter by
up to t, under keys of (length, segment number, content).

Where t is a share of the length, long lines would have too many segments.
t edits leave a run of at least 3/4 of 1/share characters, which both lines
hold; they meet under the smallest hash of its grams (winnowing), so no pair
is lost and the keys of a line grow with its length only.

Keys that only one line has are dropped before any text moves.  Lines that
share a key meet in units of bounded size; there, pairs whose character
counts allow it are verified by a banded bit-parallel edit distance, unless
they are connected already, so that a group of near copies costs little more
than its size.  Classes are the connected components; the first line of a
class, by doc_id and place, stays.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batches, ddl, fields, thrifty
from .components import components
from .forest import Labels
from .jaccard import units
from .store import Scratch, width
from .tables import rewritten, table
from .words import U, buffers, mix, pieces, powers, prefix_hash, signed, span_digests, span_hash

EDITS, LEAST, LEAST_EXACT = 2, 40, 15
BAG = 32
#: Characters of the grams that are counted beside single ones, and their buckets: an edit changes 2 * TRI counts at most.
TRI, TRI_BAG = 3, 256
#: Grams of long lines, and how many of them a key is the least of: together GRAM + WINDOW - 1 characters.
GRAM, WINDOW = 32, 44


@dataclass(frozen=True)
class Rule:
    """How many edits a line of some length may be from a longer one: by steps
    of (least length, edits), and a 1/share of the length where that is more."""

    steps: tuple[tuple[int, int], ...] = ((10, 1), (40, 2))
    share: int = 100

    def at(self, n: np.ndarray) -> np.ndarray:
        out = np.zeros(len(n), np.int64)
        for least, edits in self.steps:
            out[n >= least] = edits
        return np.maximum(out, n // self.share) if self.share else out

    def one(self, n: int) -> int:
        return int(self.at(np.array([n]))[0])

    @property
    def least(self) -> int:
        return self.steps[0][0]

    def anchored(self, n: np.ndarray) -> np.ndarray:
        """Whether lines of these lengths meet by grams instead of segments."""
        return n >= 3 * self.share if self.share else np.zeros(len(n), bool)


#: Near copies of lines from 10 characters on, by length; exact copies of every line that isn't blank.
BY_LENGTH = Rule()
_LINES = fields(doc_id="long", rk="long", line_no="int", a="long", b="long")
_KEYS = fields(key="long", a="long", index="boolean")
_TEXTS = fields(a="long", b="long", text="string")
_EDGES = fields(a="binary", b="binary")


class Lines:
    """Trimmed lines of a column: code points, bounds, row, number in the row, and
    the halves a and b of a 128-bit hash, by which lines are equal or not."""

    def __init__(self, column: pa.Array, least: int):
        data, offsets = buffers(column)
        # a line end between rows: the last line of a row ends there like any other
        joined = np.insert(data, offsets[1:-1], 10) if len(offsets) > 2 else data
        ends = np.append(np.flatnonzero(joined == 10), len(joined))
        rows = len(offsets) - 1
        last = offsets[1:] + np.arange(rows)  # where the rows end in joined
        counts = np.diff(np.searchsorted(ends, last, side="right"), prepend=0) if rows else np.zeros(0, np.int64)
        self.codes = np.frombuffer(joined.tobytes().decode().encode("utf-32-le"), "<u4")
        codes = self.codes
        ends = np.append(np.flatnonzero(codes == 10), len(codes))[: int(counts.sum())]
        starts = np.append(0, ends[:-1] + 1)[: len(ends)]
        ink = np.flatnonzero((codes != 32) & ((codes < 9) | (codes > 13)))
        first, last = np.searchsorted(ink, starts), np.searchsorted(ink, ends)
        row = np.repeat(np.arange(rows), counts)
        number = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
        some = last > first
        start, end = ink[first[some]], ink[last[some] - 1] + 1
        use = end - start >= least
        self.start, self.end = start[use], end[use]
        self.row, self.number = row[some][use], number[some][use]
        self.a, self.b = span_digests(codes.tobytes(), 4 * self.start, 4 * self.end)
        self._prefix: np.ndarray | None = None

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            self._prefix = prefix_hash(self.codes)
        return self._prefix

    def once(self) -> np.ndarray:
        """One place of each distinct line."""
        order = np.lexsort((self.b, self.a))
        a, b = self.a[order], self.b[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return np.sort(order[new])


def segments(length: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(offset, size) of each of edits + 1 even segments, longer ones last."""
    parts = edits + 1
    base, longer = length // parts, length % parts
    out, at = [], np.zeros_like(length)
    for i in range(parts):
        size = base + (i >= parts - longer)
        out.append((at, size))
        at = at + size
    return out


def keys(lines: Lines, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, line, whether the line offers itself under it)."""
    n = lines.end - lines.start
    inverse = powers(len(lines.prefix), True)
    for shorter in range(max(e for _, e in rule.steps) + 1):
        every = n - shorter
        bound = rule.at(every)
        bound[rule.anchored(every) | (shorter > bound)] = 0
        for edits in np.unique(bound[bound > 0]).tolist():
            own = np.flatnonzero(bound == edits)
            length = every[own]
            for i, (offset, size) in enumerate(segments(length, edits)):
                # a segment moves by at most the edits before it, and by those after it from the other end
                low = max(-i, shorter - (edits - i))
                high = min(i, shorter + (edits - i))
                for move in range(low, high + 1):
                    at = offset + move
                    use = np.flatnonzero((at >= 0) & (at + size <= n[own]))
                    start = lines.start[own[use]] + at[use]
                    content = (lines.prefix[start + size[use]] - lines.prefix[start]) * inverse[start]
                    # lengths are under 2^32 and segments few: a number of its own for each pair of them
                    yield mix(content ^ ((length[use].astype(U) << U(3)) + U(i + 1)) * U(0xC2B2AE3D27D4EB4F)), own[use], np.full(len(use), shorter == 0 and move == 0)
    long = np.flatnonzero(rule.anchored(n))
    if len(long):
        yield from _anchors(lines, rule, long)


def _anchors(lines: Lines, rule: Rule, long: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys of long lines: the least gram hash of each run of GRAM + WINDOW - 1 characters, by classes of length."""
    if GRAM + WINDOW - 1 > -(-99 * 3 * rule.share // 400):
        raise ValueError("runs are too short for this share")
    n = (lines.end - lines.start)[long]
    grams = n - (GRAM - 1)
    before = np.cumsum(grams) - grams
    at = np.arange(int(grams.sum())) + np.repeat(lines.start[long] - before, grams)
    least, span = span_hash(lines.prefix, at, at + GRAM), 1
    while span < WINDOW:
        step = min(span, WINDOW - span)
        least, span = np.minimum(least[:-step], least[step:]), span + step
    count = n - (GRAM + WINDOW - 2)
    line = np.repeat(np.arange(len(long)), count)
    run = least[np.arange(len(line)) + np.repeat(before - (np.cumsum(count) - count), count)]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (line[1:] != line[:-1])
    run, line = run[new], line[new]
    # a class is wider than the gap that any bound allows, so a line meets its own and the one below
    top = np.floor(np.log(n) / np.log(1.04)).astype(U)
    low = np.floor(np.log(np.maximum(n - rule.at(n), 3 * rule.share)) / np.log(1.04)).astype(U)
    yield mix(run ^ mix(top[line] << U(3))), long[line], np.ones(len(line), bool)
    below = np.flatnonzero((low != top)[line])
    yield mix(run[below] ^ mix(low[line[below]] << U(3))), long[line[below]], np.zeros(len(below), bool)


def within(x: list[np.ndarray], y: list[np.ndarray], edits: int) -> np.ndarray:
    """Whether the edit distance of each pair is at most edits.

    The band of 2 * edits + 1 diagonals around the main one is a bit vector of
    vertical differences, moved down a row with each column; all pairs advance
    together.  x[i] isn't longer than y[i].
    """
    n = np.array([len(v) for v in x], np.int64)
    m = np.array([len(v) for v in y], np.int64)
    wide, count = int(m.max()) if len(m) else 0, len(x)
    xs = np.full((count, wide + 3 * edits + 2), 0xFFFFFFFF, np.uint32)
    ys = np.full((count, wide), 0xFFFFFFFE, np.uint32)
    for i in range(count):
        xs[i, edits : edits + n[i]] = x[i]
        ys[i, : m[i]] = y[i]
    bits = 2 * edits + 1
    full, top = np.uint32((1 << bits) - 1), np.uint32(1 << (bits - 1))
    one = np.uint32(1)
    vp = np.full(count, full & ~np.uint32((1 << edits) - 1), np.uint32)
    vn = np.zeros(count, np.uint32)
    dist = np.full(count, edits, np.int64)
    for j in range(1, wide + 1):
        match = np.zeros(count, np.uint32)
        for b in range(bits):
            match |= (xs[:, j - 1 + b] == ys[:, j - 1]).astype(np.uint32) << np.uint32(b)
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        down = j <= n - edits
        across = ~down & (j <= m)
        dist += down & ((d0 & top) == 0)
        shift = np.where(across, n - j + edits, 0).astype(np.uint32)
        dist += np.where(across, ((hp >> shift) & one).astype(np.int64) - ((hn >> shift) & one), 0)
        vp = (hn | ~((d0 >> one) | hp)) & full
        vn = (d0 >> one) & hp
    return dist <= edits


#: Runs of at most this many characters are equal if their hashes are; longer ones are compared.
TRUSTED = 32


def reach(x: list[np.ndarray], y: list[np.ndarray], edits: int) -> np.ndarray:
    """within() for larger bounds: how far each diagonal comes with 0, 1, ... edits;
    a pair is done when the last one is reached.

    Runs of equal characters are found by doubling, then halving, over hashes,
    so the cost grows with the square of the edits rather than with the lengths.
    """
    out = np.zeros(len(x), bool)
    size = max(1, 2_000_000 // (2 * edits + 1))
    for lo in range(0, len(x), size):
        a, b = x[lo : lo + size], y[lo : lo + size]
        n, m = np.array([len(v) for v in a], np.int64), np.array([len(v) for v in b], np.int64)
        codes = np.concatenate([*a, *b])
        hashes = prefix_hash(codes), powers(len(codes) + 1, True)
        starts = np.cumsum(np.append(n, m)) - np.append(n, m)
        sx, sy = starts[: len(n)], starts[len(n) :]
        goal = m - n + edits
        open_ = np.flatnonzero((goal >= 0) & (goal <= 2 * edits))
        diagonal = np.arange(-edits, edits + 1)[None, :]
        row = np.full((len(n), 2 * edits + 3), -1, np.int64)  # -1: not reached; a margin on either side
        for e in range(edits + 1):
            if not len(open_):
                break
            end = np.minimum(n[open_, None], m[open_, None] - diagonal)  # the last row of each diagonal
            if e:
                old = row[open_]
                before, same, after = old[:, :-2], old[:, 1:-1], old[:, 2:]
                now = np.maximum(np.maximum(before, np.where(same >= 0, same + 1, -1)), np.where(after >= 0, after + 1, -1))
            else:
                now = np.where(diagonal == 0, 0, np.full_like(end, -1))
            now = np.minimum(now, end)
            # a diagonal too far from the last one can't come back with the edits that are left
            far = np.abs(diagonal + edits - goal[open_, None]) > edits - e
            now = np.where((now + diagonal < 0) | far, -1, now)
            k, d = np.nonzero(now >= 0)
            i = now[k, d]
            now[k, d] = i + _runs(codes, hashes, sx[open_[k]] + i, sy[open_[k]] + i + d - edits, end[k, d] - i)
            row[open_, 1:-1] = now
            done = now[np.arange(len(open_)), goal[open_]] >= n[open_]
            out[lo + open_[done]] = True
            open_ = open_[~done]
    return out


def _runs(codes: np.ndarray, hashes: tuple[np.ndarray, np.ndarray], p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many characters from p and q on are equal, up to most."""
    prefix, inverse = hashes

    def same(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (prefix[i + n] - prefix[i]) * inverse[i] == (prefix[j + n] - prefix[j]) * inverse[j]

    out = np.zeros(len(p), np.int64)
    own, step = np.flatnonzero(most > 0), 8
    own = own[codes[p[own]] == codes[q[own]]]
    fails: list[tuple[np.ndarray, int]] = []
    while len(own):
        at = out[own]
        take = np.minimum(step, most[own] - at)
        i, j = p[own] + at, q[own] + at
        equal = same(i, j, take)
        out[own[equal]] += take[equal]
        if step > 1 and not equal.all():
            fails.append((own[~equal], step))
        own = own[equal]
        own = own[out[own] < most[own]]
        step *= 4
    for own, step in fails:  # the run ends inside the last step
        low, high = np.zeros(len(own), np.int64), np.minimum(step, most[own] - out[own]) - 1
        i, j = p[own] + out[own], q[own] + out[own]
        while True:
            some = low < high
            if not some.any():
                break
            mid = (low + high + 1) // 2
            equal = same(i, j, mid)
            low, high = np.where(some & equal, mid, low), np.where(some & ~equal, mid - 1, high)
        out[own] += low
    for v in np.flatnonzero(out > TRUSTED):  # hashes of longer runs may be equal by design
        n = int(out[v])
        differ = codes[p[v] : p[v] + n] != codes[q[v] : q[v] + n]
        if differ.any():
            out[v] = int(np.argmax(differ))
    return out


def close(x: list[np.ndarray], y: list[np.ndarray], rule: Rule) -> np.ndarray:
    """Whether each pair is within the bound of its first line, which isn't longer than the second."""
    bound = rule.at(np.array([len(v) for v in x], np.int64))
    out = np.zeros(len(x), bool)
    for edits in np.unique(bound).tolist():
        use = np.flatnonzero(bound == edits)
        out[use] = (within if edits <= 2 else reach)([x[i] for i in use], [y[i] for i in use], edits)
    return out


def _scan_lines(least: int):
    def run(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arriving:
            for part in pieces(batch, "text"):
                lines = Lines(part.column(2), least)
                take = pa.array(lines.row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(lines.number.astype(np.int32)), pa.array(signed(lines.a)), pa.array(signed(lines.b))], schema=_LINES)

    return run


#: Keys that a task holds before it deals them out, and that are compared at a time.
HELD, AT_ONCE = 1 << 20, 1 << 18
_DEALT = fields(bucket="int", keys="binary", lines="binary")


def _longs(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """data[at[i] : at[i + 1]], 8 bytes each, as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(data)])


def _scan_keys(rule: Rule, buckets: int):
    """The keys of the lines by ranges of keys, many in a row: a row for each would cost
    more to move and sort than to make.  The last bit of a key tells whether the line
    offers itself under it."""

    def dealt(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, line = (np.concatenate(x) for x in zip(*found, strict=True))
        bucket = ((key >> U(32)) * U(buckets)) >> U(32)
        order = np.argsort(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")
        count = np.bincount(bucket.astype(np.int64), minlength=buckets)
        some = np.flatnonzero(count)
        at = np.append(0, np.cumsum(count[some]))
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), _longs(key[order], at), _longs(line[order], at)], schema=_DEALT)

    def run(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in arriving:
            for part in pieces(batch, "text"):
                lines = Lines(part.column(0), rule.least)
                if not len(lines.start):
                    continue
                _, once = np.unique(lines.a, return_index=True)
                lines.start, lines.end, lines.a = lines.start[once], lines.end[once], lines.a[once]
                for key, use, own in keys(lines, rule):
                    found.append(((key & ~U(1)) | own.astype(U), lines.a[use]))
                    size += len(key)
                    if size >= HELD:
                        yield dealt(found)
                        found, size = [], 0
        if size:
            yield dealt(found)

    return run


def _named(key: np.ndarray, a: np.ndarray) -> pa.RecordBatch:
    """Of all entries of some keys: those of keys that two lines have and one offers, named
    by a hash of the key's lines.  Near copies share many keys, most of them among the
    same lines: these become one, and a line's text moves once for all of them."""
    order = np.argsort(key)
    own = key[order] >> U(1)
    twin = np.zeros(len(order) + 1, bool)
    twin[1:-1] = own[1:] == own[:-1]
    order = order[twin[1:] | twin[:-1]]  # most keys have one line
    own, key, a = key[order] & U(1) == 1, key[order] >> U(1), a[order].view(np.int64)
    order = np.lexsort((a, key))
    key, a, own = key[order], a[order], own[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(new)
    if not len(start):
        return pa.RecordBatch.from_pylist([], schema=_KEYS)
    other = np.zeros(len(key), np.int64)
    other[1:] = (a[1:] != a[:-1]) & ~new[1:]
    use = (np.add.reduceat(other, start) > 0) & np.logical_or.reduceat(own, start)
    once = np.ones(len(key), bool)
    once[1:] = new[1:] | (a[1:] != a[:-1])
    # a line may offer itself and probe under one key: it then counts as offering
    first = np.flatnonzero(once)
    offers = np.logical_or.reduceat(own, first)
    group = np.cumsum(new)[first] - 1
    total = np.zeros(len(first) + 1, U)
    np.cumsum(mix(a[first].view(U) ^ (offers.astype(U) * U(0x9E3779B97F4A7C15))), out=total[1:])
    edge = np.searchsorted(group, np.arange(len(start) + 1))
    name = mix(total[edge[1:]] - total[edge[:-1]])
    keep = use[group]
    return pa.RecordBatch.from_arrays([pa.array(signed(name)[group][keep]), pa.array(a[first][keep]), pa.array(offers[keep])], schema=_KEYS)


def _shared(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys that lines share, from rows sorted by bucket."""

    def done():
        return _named(*(np.frombuffer(b"".join(x), U) for x in (held, lines)))

    held, lines, size, last = [], [], 0, None
    for batch in arriving:
        for bucket, key, line in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if size >= AT_ONCE and bucket != last:
                yield done()
                held, lines, size = [], [], 0
            held.append(key.as_buffer())
            lines.append(line.as_buffer())
            size, last = size + held[-1].size // 8, bucket
    if size:
        yield done()


#: Bits of the map that tells which lines share a key: a fixed size, so beyond some ten million lines more texts move than need to.
BITS = 1 << 26


def _bit(a: np.ndarray) -> np.ndarray:
    return (mix(a.view(U)) >> U(64 - BITS.bit_length() + 1)).astype(np.int64)


def _marked(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the map that a task's lines set, and what they hold."""
    bits = np.zeros(BITS, bool)
    for batch in arriving:
        bits[_bit(batch.column(0).to_numpy())] = True
    held = np.packbits(bits)
    at = np.flatnonzero(held)
    for i in range(0, len(at), 1 << 20):
        own = at[i : i + (1 << 20)]
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(held[own].astype(np.int32))], names=["at", "bits"])


def _map_of(shared: DataFrame) -> np.ndarray:
    """The map of all lines with a shared key: BITS / 8 bytes for any input."""
    found = shared.select("a").mapInArrow(_marked, "at int, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS // 8, np.uint8)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().astype(np.uint8)
    return out


def _scan_texts(least: int, held: Any):
    """Lines that may share a key, each once per batch; held: a broadcast of _map_of()."""

    def run(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arriving:
            for part in pieces(batch, "text"):
                lines = Lines(part.column(0), least)
                once = lines.once()
                bit = _bit(lines.a[once])
                once = once[(held.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1]
                texts = [lines.codes[lines.start[i] : lines.end[i]].tobytes().decode("utf-32-le") for i in once]
                yield pa.RecordBatch.from_arrays([pa.array(signed(lines.a[once])), pa.array(signed(lines.b[once])), pa.array(texts, pa.string())], schema=_TEXTS)

    return run


def bags(codes: list[np.ndarray], n: int, buckets: int) -> np.ndarray:
    """How many runs of n characters of each line fall into each bucket of their hash."""
    count = len(codes)
    flat = np.concatenate(codes).astype(U) if count else np.zeros(0, U)
    row = np.repeat(np.arange(count), [len(c) for c in codes])
    h = mix(flat)
    for k in range(1, n):
        h = mix(h[:-1] * U(3) + flat[k:])
    if n > 1:
        same = row[: len(h)] == row[n - 1 :] if len(h) else np.zeros(0, bool)
        h, row = h[same], row[: len(h)][same]
    place = (h >> U(65 - buckets.bit_length())).astype(np.int64)
    return np.bincount(row * buckets + place, minlength=count * buckets).reshape(count, buckets).astype(np.int32)


def link(texts: list[str], index: np.ndarray, part: np.ndarray, rule: Rule, mine: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between the lines that offer and all lines.

    Pairs for which mine() is false are another unit's work.
    """
    codes = [np.frombuffer(x.encode("utf-32-le"), "<u4") for x in texts]
    size = np.array([len(x) for x in codes], np.int64)
    bound = rule.at(size)
    count = len(codes)
    bag = bags(codes, 1, BAG)
    grams, made = np.zeros((count, TRI_BAG), np.int32), np.zeros(count, bool)
    labels = Labels(count)
    across = bool(part.min() != part.max())
    offers = np.flatnonzero(index)
    order = np.argsort(size, kind="stable")
    sorted_size = size[order]
    for i in range(0, len(offers), 32):
        x = offers[i : i + 32]
        probes = order[np.searchsorted(sorted_size, size[x].min()) : np.searchsorted(sorted_size, size[x].max() + bound[x].max(), side="right")]
        for k in range(0, len(probes), 4096):
            y = probes[k : k + 4096]
            gap = size[y][None, :] - size[x][:, None]
            open_ = (gap >= 0) & (gap <= bound[x][:, None]) & (labels.of[x][:, None] != labels.of[y][None, :])
            if across:
                open_ &= part[x][:, None] != part[y][None, :]
            if not open_.any():
                continue
            open_ &= np.abs(bag[x][:, None, :] - bag[y][None, :, :]).sum(axis=2) <= 2 * bound[x][:, None]
            p, q = np.nonzero(open_)
            at = 0
            while at < len(p):
                a, b = x[p[at : at + 512]], y[q[at : at + 512]]
                at += 512
                apart = labels.of[a] != labels.of[b]  # what the pairs before have tied is not looked at again
                a, b = a[apart], b[apart]
                if not len(a):
                    continue
                new = np.unique(np.concatenate([a, b]))
                new = new[~made[new]]
                if len(new):  # counted for lines that single characters don't tell apart only
                    grams[new], made[new] = bags([codes[v] for v in new], TRI, TRI_BAG), True
                few = np.abs(grams[a] - grams[b]).sum(axis=1) <= 2 * TRI * bound[a]
                if mine is not None:
                    few[few] = [mine(v, w) for v, w in zip(a[few].tolist(), b[few].tolist(), strict=True)]
                a, b = a[few], b[few]
                # a batch that would tie the same two components again keeps one try of each at a time
                while len(a):
                    differ = labels.of[a] != labels.of[b]
                    a, b = a[differ], b[differ]
                    if not len(a):
                        break
                    _, once = np.unique(labels.of[a] * count + labels.of[b], return_index=True)
                    once = once[np.cumsum(size[b[once]]) <= max(2_000_000, int(size[b[once[0]]]))]
                    ok = close([codes[v] for v in a[once]], [codes[v] for v in b[once]], rule)
                    for v in once[ok]:
                        labels.join(int(a[v]), int(b[v]))
                    rest = np.ones(len(a), bool)
                    rest[once] = False
                    a, b = a[rest], b[rest]
    return labels.edges


class _Row:
    """A line in a unit: its name (both halves of its hash, 16 bytes big-endian), part,
    whether it offers, text, and its keys, whose last bit tells whether it offers under them."""

    __slots__ = ("name", "part", "own", "text", "raw", "sets")

    def __init__(self, name: bytes, part: int, own: bool, text: str, raw: bytes):
        self.name, self.part, self.own, self.text, self.raw, self.sets = name, part, own, text, raw, None

    def keys(self) -> tuple[frozenset[int], frozenset[int]]:
        """All keys and those that the line offers itself under, without their last bit."""
        if self.sets is None:
            every = np.frombuffer(self.raw, np.int64)
            self.sets = frozenset((every & -2).tolist()), frozenset((every[every & 1 == 1] & -2).tolist())
        return self.sets


def _merged(found: list[tuple]) -> list[_Row]:
    """The lines of a unit; a line may come from several tasks."""
    by: dict[bytes, _Row] = {}
    for _, _, _, part, a, b, own, text, keys in found:
        name = struct.pack(">qq", a, b)
        if name in by:
            by[name].own |= own
        else:
            by[name] = _Row(name, part, own, text, keys)
    return list(by.values())


def _first(key: int, x: _Row, y: _Row) -> bool:
    """Whether key is the least that both lines have and one offers itself under: each
    pair is looked at in one unit only."""
    (p, q), (r, s) = x.keys(), y.keys()
    return min((p & s) | (q & r), default=None) == key & -2


class _Pairs:
    """Pairs of small units, verified many at a time."""

    def __init__(self, rule: Rule):
        self.rule = rule
        self.texts: dict[bytes, str] = {}
        self.pairs: dict[tuple[bytes, bytes], tuple[_Row, _Row, list[int]]] = {}
        self.size = 0

    def add(self, key: int, rows: list[_Row]) -> None:
        across = len({r.part for r in rows}) > 1
        size = [len(r.text) for r in rows]
        bound = self.rule.at(np.array(size)).tolist()
        for i, x in enumerate(rows):
            for j, y in enumerate(rows[:i]):
                if (x.own or y.own) and abs(size[i] - size[j]) <= min(bound[i], bound[j]) and not (across and x.part == y.part):
                    short, long = (x, y) if size[i] <= size[j] else (y, x)
                    pair = short.name, long.name
                    if pair in self.pairs:
                        self.pairs[pair][2].append(key)
                    else:
                        self.pairs[pair] = short, long, [key]
                        self.texts[short.name], self.texts[long.name] = short.text, long.text
                        self.size += len(long.text)

    def mine(self, pair: tuple[bytes, bytes]) -> bool:
        x, y, found = self.pairs[pair]
        return any(_first(key, x, y) for key in found)

    def verified(self) -> Iterator[tuple[bytes, bytes]]:
        place = {a: i for i, a in enumerate(self.texts)}
        every = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in self.texts.values()]
        codes = dict(zip(self.texts, every, strict=True))
        pairs = list(self.pairs)
        p, q = (np.array([place[x[k]] for x in pairs], np.int64) for k in (0, 1))
        bound = self.rule.at(np.array([len(c) for c in every], np.int64))[p] if pairs else p
        use = []
        bag, near = bags(every, 1, BAG), []
        for i in range(0, len(pairs), 4096):
            a, b, most = p[i : i + 4096], q[i : i + 4096], bound[i : i + 4096]
            near.append(i + np.flatnonzero(np.abs(bag[a] - bag[b]).sum(axis=1) <= 2 * most))
        near = np.concatenate(near) if near else np.zeros(0, np.int64)
        some, place = np.unique(np.concatenate([p[near], q[near]]), return_inverse=True)
        grams = bags([every[v] for v in some], TRI, TRI_BAG)
        for i in range(0, len(near), 4096):
            own = near[i : i + 4096]
            a, b = grams[place[i : i + len(own)]], grams[place[len(near) + i : len(near) + i + len(own)]]
            own = own[np.abs(a - b).sum(axis=1) <= 2 * TRI * bound[own]]
            use += [pairs[v] for v in own if self.mine(pairs[v])]
        use.sort(key=lambda p: len(codes[p[1]]))
        at = 0
        while at < len(use):  # pairs of like length, so that little is padding
            to, longest = at + 1, len(codes[use[at][1]])
            while to < len(use) and len(codes[use[to][1]]) <= longest + longest // 4 + 16 and (to - at) * longest < 1_000_000:
                to += 1
            ok = close([codes[a] for a, _ in use[at:to]], [codes[b] for _, b in use[at:to]], self.rule)
            yield from (p for p, good in zip(use[at:to], ok, strict=True) if good)
            at = to


SMALL = 12


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with its last column, a list of longs, as binary values over the same bytes."""
    lists = batch.column(batch.num_columns - 1)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    data = np.ascontiguousarray(lists.values.to_numpy()[offsets[0] : offsets[-1]])
    held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer((offsets - offsets[0]) * 8), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], held], names=batch.schema.names)


def _verify(rule: Rule):
    def run(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Pairs(rule)

        def done(found):
            nonlocal held
            got, key = _merged(found), found[0][0]
            if len(got) <= SMALL:
                held.add(key, got)
                if held.size > 2_000_000:
                    now, held = held, _Pairs(rule)
                    yield from now.verified()
                return
            mine = lambda v, w: _first(key, got[v], got[w])
            for i, j in link([g.text for g in got], np.array([g.own for g in got]), np.array([g.part for g in got]), rule, mine):
                yield got[i].name, got[j].name

        def every():
            yield from units(map(_packed, arriving), 3, done)
            yield from held.verified()

        yield from batches(every(), _EDGES)

    return run


def _own(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(key).cast("long"), F.col(text)).alias("rk"), F.col(text).alias("text"))


def line_classes(docs: DataFrame, edits: int = EDITS, least: int = LEAST, least_exact: int = LEAST_EXACT, text: str = "text", key: str = "doc_id", unit: int = 2000, rule: Rule | None = None) -> DataFrame:
    """One row per line that has a twin: doc_id, rk, line_no (from 0), class_doc_id,
    class_line_no (the place of the class's first line), class_size, kept.

    Lines are compared without the white space around them.  Lines of at least
    ``least`` characters are twins within ``edits`` edits, directly or through
    others, and those of at least ``least_exact`` if they are equal; shorter
    lines are never twins.  A ``rule`` replaces edits and least: the bound then
    goes by the length of the shorter line.  Null, empty and blank texts have none.  Null ids
    come last.  Rows equal in id and text have equal rk and places: the first
    line of a class stays in each of them.  unit bounds the lines of a part of
    a key's group.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    rule = rule or Rule(((least, edits),), 0)
    own = _own(docs, text, key)
    lines = scratch.save(own.mapInArrow(thrifty(_scan_lines(least_exact)), ddl(_LINES)), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rk", "line_no")
    classes = scratch.save(lines.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    buckets = max(4096, 8 * width(spark))
    offered = own.select("text").mapInArrow(thrifty(_scan_keys(rule, buckets)), ddl(_DEALT)).repartition(width(spark), "bucket").sortWithinPartitions("bucket")
    shared = scratch.save(offered.mapInArrow(thrifty(_shared), ddl(_KEYS)).distinct(), "shared")
    heavy = shared.groupBy("key").agg(F.ceil(F.countDistinct("a") / unit).cast("int").alias("parts")).where("parts > 1")
    shares = shared.join(heavy, "key", "left").groupBy("a").agg(F.collect_list(F.struct("key", "index", F.coalesce("parts", F.lit(1)).alias("parts"))).alias("keys"))
    held = spark.sparkContext.broadcast(_map_of(shared))
    texts = own.select("text").mapInArrow(thrifty(_scan_texts(rule.least, held)), ddl(_TEXTS)).join(shares, "a")
    dealt = texts.select("a", "b", "text", F.transform("keys", lambda k: k["key"].bitwiseAND(-2).bitwiseOR(k["index"].cast("long"))).alias("all"), F.explode("keys").alias("k"))
    part = F.pmod(F.xxhash64("a"), F.col("k.parts")).cast("int")
    dealt = dealt.select("a", "b", "text", "all", "k.key", "k.index", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("k.parts") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "a", "b", "index", "text", "all")
    near = dealt.repartition(width(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(thrifty(_verify(rule)), ddl(_EDGES))
    name = F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("a", "b")]))
    roots = components(near, scratch, "near")
    named = classes.withColumn("node", name).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = scratch.save(named.select("a", "b", "root", "first", "n"), "named")
    whole = named.groupBy("root").agg(F.min("first").alias("class_first"), F.sum("n").alias("class_size")).where("class_size > 1")
    used = named.join(whole, "root").select("a", "b", "class_first", "class_size")
    out = lines.join(used, ["a", "b"])
    return out.select("doc_id", "rk", "line_no", F.col("class_first.doc_id").alias("class_doc_id"), F.col("class_first.line_no").cast("int").alias("class_line_no"), "class_size", place.eqNullSafe(F.col("class_first")).alias("kept"))


def _cut(text: pa.Array, gone: pa.Array) -> pa.Array:
    out = []
    for x, lines in zip(text, gone, strict=True):
        own = x.as_py()
        if lines.is_valid:
            drop = set(lines.as_py())
            own = "\n".join(line for i, line in enumerate(own.split("\n")) if i not in drop)
        out.append(own)
    return pa.array(out, pa.string())


def remove_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """docs without the lines that aren't the first of their class; a document
    left blank by that goes.  Others are untouched, with all columns; n_chars,
    where there is one, follows the text."""
    scratch = Scratch(docs.sparkSession, "cutlines")
    gone = scratch.save(line_classes(docs, text=text, key=key, **options).where("not kept").groupBy("doc_id", "rk").agg(F.collect_set("line_no").alias("gone")), "gone")
    out = rewritten(docs, gone, "gone", _cut, text, key)
    return out.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in docs.columns else out


def op7_line_dedup(spark, sf_dir):
    found = line_classes(table(spark, sf_dir, "documents"), least_exact=1, rule=BY_LENGTH)
    return found.select("doc_id", "line_no", "class_doc_id", "class_line_no", "class_size", "kept")
