"""Byte-level BPE encoding and decoding by a serialised sentencepiece model.

The model file is written directly from a vocabulary of byte strings and
ranks: every byte is mapped to a printable character, a piece scores minus its
rank, and the normaliser changes nothing.  Pre-tokens are encoded one by one;
decoding is the inverse mapping of ids to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batches, ddl, fields
from .tables import table
from .tokens import IDS, PART, PieceCache, byte_characters, id_columns
from .words import buffers, pieces

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
_ENCODED = fields(doc_id="long", ids="binary")
_DIGEST = fields(doc_id="long", n_tokens="long", ids_sha256="string", decoded_sha256="string")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protocol buffer message."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece i + 1 is the byte string of rank i."""
    chars = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    out = [_field(1, _field(1, "⁇".encode()) + _field(2, 0.0) + _field(3, unknown))]
    out += [_field(1, _field(1, "".join(chars[b] for b in piece).encode()) + _field(2, float(-rank)) + _field(3, normal)) for piece, rank in by_rank]
    out.append(_field(2, _field(3, bpe) + _field(4, len(by_rank) + 1)))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class ByteBpe:
    """Encoder and decoder of one vocabulary; one for each file and Python process."""

    made: dict[str, ByteBpe] = {}

    def __init__(self, path: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.bytes = [b for b, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.chars = byte_characters()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.cache = PieceCache(lambda raw: self.encode(raw.decode()))

    @classmethod
    def of(cls, path: str | None) -> ByteBpe:
        path = path or public_tokenizers.path(VOCABULARY)
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def encode(self, text: str) -> list[int]:
        out, chars, ranks, encode = [], self.chars, self.ranks, self.model.encode
        for token in self.split(text):
            raw = token.encode()
            rank = ranks.get(raw)
            if rank is not None:  # a whole pre-token in the vocabulary is its own id
                out.append(rank)
            else:
                out.extend(i - 1 for i in encode("".join([chars[b] for b in raw])))
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def encode(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of each row.

    A null or empty text has no ids; null keys stay null; repeated rows are
    encoded each.  One pass over the scan without a shuffle; memory grows with
    the longest text and not with the table.
    """

    def run(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ByteBpe.of(path).cache

        for batch in arriving:
            for part in pieces(batch, "text", PART):
                ids, counts = cache.encode(part.column(1))
                for use, column in id_columns(ids, counts):
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(use.start, use.stop - use.start), column], schema=_ENCODED)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ddl(_ENCODED))


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Counts and hashes of the ids and of the bytes that they decode to."""

    def run(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(path)
        decimal = [b"%d," % i for i in range(len(bpe.bytes))]

        def found():
            for batch in arriving:
                data, offsets = buffers(batch.column(1))
                ids, at = np.frombuffer(data.tobytes(), IDS), (offsets // IDS.itemsize).tolist()
                for doc, i, j in zip(batch.column(0).to_pylist(), at, at[1:], strict=False):
                    own = ids[i:j].tolist()
                    yield doc, len(own), hashlib.sha256(b"".join(map(decimal.__getitem__, own))[:-1]).hexdigest(), hashlib.sha256(bpe.decode(own)).hexdigest()

        yield from batches(found(), _DIGEST)

    return encoded.mapInArrow(run, ddl(_DIGEST))


def op6_byte_bpe(spark, sf_dir):
    return digests(encode(table(spark, sf_dir, "documents")))
