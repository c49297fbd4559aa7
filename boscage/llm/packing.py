"""Packing by power-of-two decomposition.

A document's ids and its end id are cut into pieces whose lengths are powers
of two: full sequences first, then the binary digits of what is left, from
high to low.  Each piece is a sequence of its own, so no sequence crosses
documents, equal lengths share a bucket and nothing is padded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import ddl, fields, thrifty
from .tables import table
from .tokens import PART, huggingface, id_columns
from .words import pieces

_PIECES = fields(doc_id="long", start="long", length="long", ids="binary", doc_tokens="long", sequence_id="long", offset="long", bucket="int")

#: Bytes of known cuts that a Python worker holds on to, after its task too.
HELD = 64 << 20


def lengths(n: int, longest: int) -> list[int]:
    """Powers of two, longest first, that sum to n; none is over longest."""
    out = [longest] * (n // longest)
    rest = n % longest
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def decompose(counts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, length) of the pieces of rows of these lengths, in order: lengths() of each."""
    rows, sizes = [np.repeat(np.arange(len(counts)), counts // longest)], []
    sizes.append(np.full(len(rows[0]), longest, np.int64))
    bit = longest >> 1
    while bit:
        own = np.flatnonzero(counts & bit)
        rows.append(own)
        sizes.append(np.full(len(own), bit, np.int64))
        bit >>= 1
    row, size = np.concatenate(rows), np.concatenate(sizes)
    order = np.argsort(row, kind="stable")
    return row[order], size[order]


def _cut(longest: int, end_id: int | None, path: str | None):
    def run(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = huggingface(path, HELD)
        k = TaskContext.get().partitionId() << 33
        for batch in arriving:
            for part in pieces(batch, "text", PART // 4):
                ids, counts = encoder.encode(part.column(1), end_id)
                row, size = decompose(counts, longest)
                start = np.cumsum(size) - size - (np.cumsum(counts) - counts)[row]
                for use, column in id_columns(ids, size):
                    n, own = use.stop - use.start, row[use]
                    number = np.arange(k + use.start, k + use.stop)
                    bucket = np.log2(size[use]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.array(start[use]), pa.array(size[use]), column, pa.array(counts[own]), pa.array(number), pa.array(np.zeros(n, np.int64)), pa.array(bucket)], schema=_PIECES)
                k += len(size)

    return run


def pack(docs: DataFrame, longest: int = 2048, end_id: int | None = 1, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset, bucket (log2 of the length).

    A null or empty text is its end id alone; null keys stay null; repeated
    rows are packed each.  sequence_id is the partition and a count within it:
    one per piece, and the same on a second run over the same scan or written
    table.  No shuffle and no state across rows; memory grows with the longest
    text and not with the table.  longest is a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(thrifty(_cut(longest, end_id, path)), ddl(_PIECES))


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder for each length, so that a loader reads equal lengths."""
    packed.write.partitionBy("bucket").parquet(path)


def op1_packing(spark, sf_dir):
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
