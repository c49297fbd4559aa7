"""Encoders over whole texts that look up the ids of repeated pieces.

The splitting pattern of byte-level BPE never joins what stands on the two
sides of a single space or line end between other characters (the space opens
the next pre-token, and a lone line end is one of its own), nor a letter and
the mark after it.  Texts are cut there by masks over their bytes, so each cut
has the ids that it has in the whole text.  The cuts of a batch are
dictionary-encoded, only distinct ones are looked up or encoded, and the ids
of all are gathered at once.  The tests hold this against the plain encoders.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa

from .words import buffers

IDS = np.dtype("<u4")
_NATIVE = array("I", [1]).tobytes() == np.array([1], IDS).tobytes()
#: An optional space before letters up to U+024F: one pre-token.
_PLAIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+")
#: Bytes by what a cut needs to know of them.
_GAP, _SPACE, _LETTER, _MARK = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[:33] = _SPACE
_KIND[[32, 10]] = _GAP
for _low, _high in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _KIND[_low:_high] = _MARK
_KIND[65:91] = _KIND[97:123] = _LETTER
#: Bytes of text that are encoded at once, cuts of at most this many bytes are remembered, and what an entry costs beside its bytes.
PART, REMEMBERED, ENTRY = 8 << 20, 128, 160


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out = [""] * 256
    for b in shown:
        out[b] = chr(b)
    for i, b in enumerate(b for b in range(256) if b not in set(shown)):
        out[b] = chr(256 + i)
    return out


def cuts(data: np.ndarray, offsets: np.ndarray, unbroken: tuple[bytes, ...] = ()) -> np.ndarray:
    """Places in data where a cut begins, the rows' own beginnings included, and its
    end; none is inside one of the unbroken strings."""
    n = len(data)
    kind = _KIND[data]
    space = (kind == _GAP) | (kind == _SPACE)
    letter = kind == _LETTER
    wide = np.flatnonzero(data >= 0xC2)
    if len(wide):
        one = data[wide].astype(np.int64)
        two = data[np.minimum(wide + 1, n - 1)].astype(np.int64)
        three = data[np.minimum(wide + 2, n - 1)].astype(np.int64)
        latin = (one >= 0xC3) & (one <= 0xC8) & ~((one == 0xC3) & ((two == 0x97) | (two == 0xB7)))
        letter[wide[latin] + 1] = True
        blank = (one == 0xC2) & ((two == 0x85) | (two == 0xA0))
        for at, size in ((wide[blank], 2), (wide[_blank3(one, two, three)], 3)):
            for k in range(size):
                space[at + k] = True
    cut = np.zeros(n + 1, bool)
    if n > 2:
        lone = (kind[1:-1] == _GAP) & ~space[:-2] & ~space[2:]
        cut[1 : n - 1] = lone
        cut[2:n] |= lone & (data[1:-1] == 10)  # a lone line end has nothing to do with what follows
        cut[1:n] |= (kind[1:] == _MARK) & letter[:-1]
    raw = data.tobytes() if unbroken else b""
    for one in unbroken:
        at = raw.find(one)
        while at >= 0:
            cut[at + 1 : at + len(one)] = False
            at = raw.find(one, at + 1)
    cut[offsets] = True
    return np.flatnonzero(cut)


def _blank3(one: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
    """White space of three bytes: U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F and U+3000."""
    general = (one == 0xE2) & (two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF))
    return general | ((one == 0xE1) & (two == 0x9A)) | ((one == 0xE2) & (two == 0x81) & (three == 0x9F)) | ((one == 0xE3) & (two == 0x80) & (three == 0x80))


def _strings(column: pa.Array) -> list[bytes]:
    data, offsets = buffers(column)
    raw, at = data.tobytes(), offsets.tolist()
    return [raw[i:j] for i, j in zip(at, at[1:], strict=False)]


class PieceCache:
    """encode(texts) gives the ids of each text of an Arrow string column.

    ``piece`` encodes a cut, given in UTF-8.  About ``limit`` bytes of cuts and their ids
    are held in two generations: when the young one is full, it becomes the old
    one, and what is met again there moves back.  Long cuts are encoded each
    time, so texts without a space don't fill it.
    """

    def __init__(self, piece: Callable[[bytes], list[int]], limit: int = 160 << 20, unbroken: tuple[bytes, ...] = ()):
        self.piece, self.limit, self.unbroken = piece, limit, unbroken
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size = 0

    def _found(self, distinct: list[bytes]) -> list[bytes]:
        out = list(map(self.young.get, distinct))
        before = self.old.get
        for i, cut in enumerate(distinct):
            if out[i] is not None:
                continue
            ids = before(cut)
            if ids is None:
                own = self.piece(cut)
                ids = array("I", own).tobytes() if _NATIVE else np.array(own, IDS).tobytes()
            out[i] = ids
            if len(cut) <= REMEMBERED:
                self.young[cut] = ids
                self.size += ENTRY + len(cut) + len(ids)
        if 2 * self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        return out

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, ids per text); a null is an empty text
        and ``end``, where given, is the last id of each."""
        data, offsets = buffers(texts)
        at = cuts(data, offsets, self.unbroken)
        held = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))) if len(at) > 1 else pa.array([], pa.string())
        held = held.dictionary_encode()
        taken = pa.array(self._found(_strings(held.dictionary)), pa.large_binary()).take(held.indices)
        ids = np.frombuffer(taken.buffers()[2] or b"", IDS)
        upto = np.frombuffer(taken.buffers()[1], np.int64)[: len(at)] // IDS.itemsize if len(taken) else np.zeros(1, np.int64)
        row = upto[np.searchsorted(at, offsets)]
        ids = ids[: row[-1]]
        if end is not None:
            return np.insert(ids, row[1:], end).astype(IDS, copy=False), np.diff(row) + 1
        return ids, np.diff(row)


def id_columns(ids: np.ndarray, counts: np.ndarray) -> Iterator[tuple[slice, pa.Array]]:
    """Rows and their ids as binary values, a bounded number of bytes at a time."""
    upto = np.append(0, np.cumsum(counts))
    at = 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + (1 << 21), side="right")) - 1)
        own = np.ascontiguousarray(ids[upto[at] : upto[to]])
        offsets = ((upto[at : to + 1] - upto[at]) * IDS.itemsize).astype(np.int32)
        yield slice(at, to), pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(offsets), pa.py_buffer(own)])
        at = to


_made: dict[tuple[str, str], PieceCache] = {}


def huggingface(path: str | None = None, limit: int = 160 << 20) -> PieceCache:
    """By the tokenizers library with add_special_tokens=False: an added token's
    string in a text has that token's id.  One for each file and Python process, which
    holds limit bytes from its last call on."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    if ("hf", path) not in _made:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        merge = whole.model.tokenize
        chars = dict(enumerate(byte_characters()))

        def piece(raw: bytes) -> list[int]:
            if _PLAIN.fullmatch(raw):
                return [x.id for x in merge(raw.decode("latin-1").translate(chars))]
            return whole.encode(raw.decode(), add_special_tokens=False).ids

        added = tuple(x.content.encode() for x in whole.get_added_tokens_decoder().values())
        _made["hf", path] = PieceCache(piece, unbroken=added)
    _made["hf", path].limit = limit
    return _made["hf", path]
