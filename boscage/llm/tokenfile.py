"""Token-id files: documents compressed one by one with a shared dictionary.

A file set is a folder of three tables that any store takes:

* ``dictionary``: the Zstandard dictionary, its sha256 and the id width;
* ``data``: rows of segments in ascending doc_id order.  ``payload`` is one
  Zstandard frame per document end to end; ``doc_ids``, ``offsets`` and
  ``counts`` are the index (little-endian), so a single document is found by
  the statistics of first_doc_id and last_doc_id, its offset and one frame;
* ``manifest``: ids before each shard, a row per shard.

Every row of data names the dictionary's hash.  Files are written by Spark's
own committer, so a lost executor leaves no half file and no double one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import batches, ddl, fields, rows
from .store import Scratch, width
from .tables import table
from .tokens import IDS, PART, huggingface
from .words import pieces

_DATA = fields(
    shard="long", segment="long", first_doc_id="long", last_doc_id="long", null_ids="long", n_docs="long", n_ids="long", shard_start="long",
    dictionary_sha256="string", id_bytes="int", doc_ids="binary", offsets="binary", counts="binary", payload="binary",
)
_READ = fields(doc_id="long", start="long", n_tokens="long", ids="binary")


def train_dictionary(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A Zstandard dictionary, or the samples themselves if they are too few to train on."""
    samples = [x for x in samples if x]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes, level: int | None = None) -> zstandard.ZstdCompressionDict | None:
    """The dictionary; for a compressor digested once instead of for each document."""
    if not raw:
        return None
    out = zstandard.ZstdCompressionDict(raw)
    if level is not None:
        out.precompute_compress(level=level)
    return out


#: Bytes of text that the dictionary is trained on at most.
SAMPLE_BYTES = 8 << 20


def _sample(docs: DataFrame, n: int) -> list[str]:
    """Whole texts of the n rows with the smallest hash of their key, as far as they fit in SAMPLE_BYTES."""
    some = docs.where("doc_id is not null").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    keys, size = [], 0
    for r in some.orderBy(F.xxhash64("doc_id"), "doc_id", "size").limit(n).collect():
        if size + r["size"] <= SAMPLE_BYTES:
            keys.append((r["doc_id"], r["size"]))
            size += r["size"]
    if not keys:
        return []
    near = docs.where(F.col("doc_id").isin(sorted({k for k, _ in keys})) & (F.octet_length("text") <= max(x for _, x in keys)))
    return [r[0] for r in near.orderBy("doc_id", "text").select("text").limit(n).collect()]


def write(docs: DataFrame, path: str, end_id: int | None = 0, vocabulary: str | None = None, sample: int = 512, level: int = 3, segment: int = 4 << 20, text: str = "text", key: str = "doc_id") -> None:
    """Encode the texts, append end_id to each and write the file set to path.

    Null texts are empty; rows without a key come first, equal keys in the
    order of a hash of their texts, so that a hot key fills many shards.  The dictionary is trained on the whole texts of at
    most ``sample`` rows and SAMPLE_BYTES, a bound that doesn't grow; all rows
    are compressed with it.  Memory grows with the longest text and a segment.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    encoder = huggingface(vocabulary)
    from tokenizers import Tokenizer

    import public_tokenizers

    largest = Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json")).get_vocab_size()
    # 2 bytes where the vocabulary allows it
    kind = np.dtype("<u2") if max(largest, end_id or 0) <= 65536 else np.dtype("<u4")
    ids, counts = encoder.encode(pa.array(_sample(own, sample), pa.string()), end_id)
    raw = train_dictionary([x.astype(kind).tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else [])
    digest = hashlib.sha256(raw).hexdigest()
    spark.range(1).select(F.lit(bytearray(raw)).alias("dictionary"), F.lit(digest).alias("sha256"), F.lit(kind.itemsize).alias("id_bytes")).coalesce(1).write.parquet(f"{path}/dictionary")

    def run(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = huggingface(vocabulary)
        pack = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(raw, level), write_content_size=True).compress
        shard = TaskContext.get().partitionId()

        def segments():
            docs_, offsets, counts, frames, size, k, before = [], [0], [], [], 0, 0, 0

            def row():
                known = [x for x in docs_ if x is not None]
                return (
                    shard, k, known[0] if known else None, known[-1] if known else None, len(docs_) - len(known), len(docs_), sum(counts), before, digest, kind.itemsize,
                    np.array(known, "<i8").tobytes(), np.array(offsets, "<u8").tobytes(), np.array(counts, "<u8").tobytes(), b"".join(frames),
                )

            for batch in arriving:
                for part in pieces(batch, "text", PART):
                    ids, n_ids = encoder.encode(part.column(1), end_id)
                    raw_ids = memoryview(ids.astype(kind)).cast("B")
                    upto = 0
                    for doc, n in zip(part.column(0).to_pylist(), n_ids.tolist(), strict=True):
                        frame = pack(raw_ids[upto : upto + n * kind.itemsize])
                        upto += n * kind.itemsize
                        docs_.append(doc)
                        counts.append(n)
                        frames.append(frame)
                        size += len(frame)
                        offsets.append(size)
                        if size >= segment:
                            yield row()
                            before += sum(counts)
                            docs_, offsets, counts, frames, size, k = [], [0], [], [], 0, k + 1
            if docs_:
                yield row()

        yield from batches(segments(), _DATA)

    dealt = own.withColumn("h", F.xxhash64("text")).repartitionByRange(width(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    dealt.mapInArrow(run, ddl(_DATA)).write.option("compression", "uncompressed").parquet(f"{path}/data")
    # a row per shard: as many as range partitions, whatever the input
    shards = spark.read.parquet(f"{path}/data").groupBy("shard").agg(F.min("first_doc_id").alias("first"), F.sum("n_ids").alias("n"), F.sum("n_docs").alias("docs")).orderBy("shard").collect()
    base, manifest = 0, []
    for r in shards:
        manifest.append((r["shard"], base, r["n"], r["docs"]))
        base += r["n"]
    spark.createDataFrame(manifest, "shard long, base long, n_ids long, n_docs long").coalesce(1).write.parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids of each document."""
    head = spark.read.parquet(f"{path}/dictionary").first()
    raw, digest = bytes(head["dictionary"]), head["sha256"]
    base = {r["shard"]: r["base"] for r in spark.read.parquet(f"{path}/manifest").collect()}

    def run(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if hashlib.sha256(raw).hexdigest() != digest:
            raise ValueError("the dictionary doesn't match its hash")
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)).decompress

        def found():
            for shard, before, named, width_, nulls, docs_, offsets, counts, payload in rows(arriving, 1):
                if named != digest:
                    raise ValueError("data was written with another dictionary")
                start = base[shard] + before
                ids = [None] * nulls + np.frombuffer(docs_, "<i8").tolist()
                at = np.frombuffer(offsets, "<u8").tolist()
                for i, (doc, n) in enumerate(zip(ids, np.frombuffer(counts, "<u8").tolist(), strict=True)):
                    own = np.frombuffer(unpack(payload[at[i] : at[i + 1]]), f"<u{width_}").astype(IDS).tobytes()
                    yield doc, start, n, own
                    start += n

        yield from batches(found(), _READ)

    data = spark.read.parquet(f"{path}/data").select("shard", "shard_start", "dictionary_sha256", "id_bytes", "null_ids", "doc_ids", "offsets", "counts", "payload")
    return data.mapInArrow(run, ddl(_READ))


def lookup(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The rows of one document: only segments whose key range holds it are read."""
    head = spark.read.parquet(f"{path}/dictionary").first()
    raw = bytes(head["dictionary"])

    def run(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)).decompress

        def found():
            for width_, nulls, docs_, offsets, payload in rows(arriving, 1):
                at = np.frombuffer(offsets, "<u8").tolist()
                for i in np.flatnonzero(np.frombuffer(docs_, "<i8") == doc_id).tolist():
                    i += nulls
                    yield doc_id, np.frombuffer(unpack(payload[at[i] : at[i + 1]]), f"<u{width_}").astype(IDS).tobytes()

        yield from batches(found(), fields(doc_id="long", ids="binary"))

    held = spark.read.parquet(f"{path}/data").where((F.col("first_doc_id") <= doc_id) & (F.col("last_doc_id") >= doc_id))
    return held.select("id_bytes", "null_ids", "doc_ids", "offsets", "payload").mapInArrow(run, "doc_id long, ids binary")


def op9_token_file(spark, sf_dir):
    path = Scratch(spark, "tokenfile").path("files")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
