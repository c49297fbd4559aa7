"""Exact dedup by Patricia-trie owners.

Texts are compared as whole byte strings after white space is normalised.
Each scan task inserts its texts into compressed radix tries of its own, one
per (length, content hash) partition, so that a group of copies that holds a
third of all rows leaves a task as one row.  The rows that are left meet by
length and content hash, are inserted into the final tries, and the terminal
nodes hold the smallest identifier and the number of copies.  A trie that
outgrows its budget writes its heaviest subtrees to disk and finishes them one
by one, so memory is bounded whatever the partition holds.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batches, ddl, fields, rows
from .store import Scratch, join_groups, width
from .tables import table

SPACES = r"[\x20\x09-\x0D]+"


def _spill_dir() -> str | None:
    """Where Spark itself spills in this executor; a task's spill dies with the task."""
    found = os.environ.get("LOCAL_DIRS") or os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("TMPDIR")
    return found.split(",")[0] if found else None


class _Node:
    """An edge label, the terminal's (smallest id, copies) or None, and children by first byte."""

    __slots__ = ("label", "terminal", "children")

    def __init__(self, label: bytes, terminal: tuple | None):
        self.label, self.terminal, self.children = label, terminal, None


def _smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _common(a: bytes, b: memoryview) -> int:
    """Length of the common prefix: doubling, then halving, over memory compares."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, step = 0, 16
    while a[low : low + step] == b[low : low + step]:
        low, step = low + step, step * 2
    high = min(n, low + step)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class PatriciaOwners:
    """A compressed radix trie from byte strings to (smallest id, copies).

    ``budget`` bounds the bytes of labels in memory.  Beyond it the child of
    the root that has taken the most bytes is written to a file of the task's
    own folder, together with what arrives for it later, and is built after
    the others by a trie of its own.
    """

    def __init__(self, budget: int = 64 << 20, depth: int = 0):
        self.budget, self.depth = budget, depth
        self.root = _Node(b"", None)
        self.bytes = 0
        self.weight: dict[int, int] = {}
        self.spilled: dict[int, object] = {}

    def add(self, text: bytes, owner: int | None, copies: int = 1) -> None:
        if text and text[0] in self.spilled:
            self._write(self.spilled[text[0]], text, owner, copies)
            return
        grown = self._insert(self.root, text, owner, copies)
        self.bytes += grown
        if text:
            self.weight[text[0]] = self.weight.get(text[0], 0) + grown
        if self.bytes > self.budget and len(self.weight) and self.depth < 64:
            self._spill(max(self.weight, key=self.weight.get))

    @staticmethod
    def _insert(node: _Node, text: bytes, owner: int | None, copies: int) -> int:
        rest = memoryview(text)
        while True:
            if not len(rest):
                grown = 0 if node.terminal else 64
                old = node.terminal
                node.terminal = (_smaller(old[0], owner), old[1] + copies) if old else (owner, copies)
                return grown
            if node.children is None:
                node.children = {}
            child = node.children.get(rest[0])
            if child is None:
                node.children[rest[0]] = _Node(bytes(rest), (owner, copies))
                return len(rest) + 200
            n = _common(child.label, rest)
            if n < len(child.label):  # the edge splits where the strings part
                upper = _Node(child.label[:n], None)
                child.label = child.label[n:]
                upper.children = {child.label[0]: child}
                node.children[rest[0]] = upper
                child = upper
            node, rest = child, rest[n:]

    @staticmethod
    def _write(file, text: bytes, owner: int | None, copies: int) -> None:
        own = b"" if owner is None else str(owner).encode()
        file.write(b"%d %d %d\n" % (len(text), len(own), copies) + text + own)

    def _spill(self, first: int) -> None:
        file = tempfile.TemporaryFile(dir=_spill_dir())
        for text, (owner, copies) in self._walk(self.root.children.pop(first), b""):
            self._write(file, text, owner, copies)
        self.bytes -= self.weight.pop(first)
        self.spilled[first] = file

    def _walk(self, node: _Node, above: bytes) -> Iterator[tuple[bytes, tuple]]:
        stack = [(node, above)]
        while stack:
            node, above = stack.pop()
            text = above + node.label
            if node.terminal:
                yield text, node.terminal
            if node.children:
                stack.extend((x, text) for x in node.children.values())

    def owners(self) -> Iterator[tuple[bytes, int | None, int]]:
        """(text, smallest id, copies) of each terminal, spilled subtrees last."""
        for text, (owner, copies) in self._walk(self.root, b""):
            yield text, owner, copies
        self.root = _Node(b"", None)
        for first, file in self.spilled.items():
            below = PatriciaOwners(self.budget, self.depth + 1)
            file.seek(0)
            while head := file.readline():
                n, k, copies = map(int, head.split())
                text, own = file.read(n), file.read(k)
                below.add(text[1:], int(own) if own else None, copies)
            file.close()
            for text, owner, copies in below.owners():
                yield bytes([first]) + text, owner, copies



def _tries(arriving: Iterable[tuple], budget: int) -> Iterator[tuple]:
    """Rows of (length, hash, text, owner, copies) with equal texts merged."""
    tries: dict[tuple, PatriciaOwners] = {}
    held = 0
    for n, h, text, owner, copies in arriving:
        trie = tries.get((n, h))
        if trie is None:
            trie = tries[n, h] = PatriciaOwners(budget)
        before = trie.bytes
        trie.add(text, owner, copies)
        held += trie.bytes - before + 100
        if held > budget:  # partitions are finished and emptied, a later copy makes a new row
            for key, x in tries.items():
                for found in x.owners():
                    yield (*key, *found)
            tries, held = {}, 0
    for key, x in tries.items():
        for found in x.owners():
            yield (*key, *found)


_PARTIAL = fields(n_bytes="long", content_hash="long", text="binary", owner="long", copies="long")
_FINAL = fields(text_sha256="string", keep_id="long", group_size="long")


def _partial(budget: int):
    def run(arriving):
        yield from batches(_tries(rows(arriving), budget), _PARTIAL)

    return run


def _final(budget: int):
    """A partition's rows arrive sorted by length and hash, so one trie is open at a time."""

    def found(arriving):
        trie, key = None, None
        for n, h, text, owner, copies in rows(arriving):
            if key != (n, h):
                if trie:
                    yield from trie.owners()
                trie, key = PatriciaOwners(budget), (n, h)
            trie.add(text, owner, copies)
        if trie:
            yield from trie.owners()

    def run(arriving):
        found_rows = ((hashlib.sha256(text).hexdigest(), owner, copies) for text, owner, copies in found(arriving))
        yield from batches(found_rows, _FINAL)

    return run


def normalised(text):
    """Each run of white space as one space; null as the empty text."""
    return F.coalesce(F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " "), F.lit(""))


def owner_table(docs: DataFrame, text: str = "text", key: str = "doc_id", budget: int = 64 << 20) -> DataFrame:
    """One row per distinct text: text_sha256, keep_id, group_size."""
    t = normalised(F.col(text))
    texts = docs.select(F.octet_length(t).cast("long").alias("n_bytes"), F.xxhash64(t).alias("content_hash"), t.cast("binary").alias("text"), F.col(key).cast("long").alias("owner"), F.lit(1).cast("long").alias("copies"))
    local = texts.mapInArrow(_partial(budget), ddl(_PARTIAL))
    dealt = local.repartition(width(docs.sparkSession), "n_bytes", "content_hash").sortWithinPartitions("n_bytes", "content_hash")
    return dealt.mapInArrow(_final(budget), ddl(_FINAL))


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Null texts equal empty ones.  Null keys come after all others: a group of
    them alone has a null keep_id and keeps its first row.  Of rows with equal
    key and text one stays.  Other columns of docs are not read.
    """
    t = normalised(F.col(text))
    members = docs.select(F.col(key).cast("long").alias("doc_id"), F.sha2(t.cast("binary"), 256).alias("text_sha256"))
    owners = Scratch(docs.sparkSession, "exact").save(owner_table(docs, text, key), "owners")
    # equal rows are interchangeable: they are counted first and dealt out again, some thousand at a time
    counted = members.groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n_rows"))
    joined = join_groups(counted, owners, ["text_sha256"], "group_size")
    blocks = joined.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n_rows - 1) div 4096"))).alias("block"))
    nth = F.sequence(F.col("block") * 4096 + 1, F.least(F.col("block") * 4096 + 4096, F.col("n_rows")))
    out = blocks.select("doc_id", "keep_id", "group_size", F.explode(nth).alias("nth"), "text_sha256")
    return out.select("doc_id", "keep_id", "group_size", ((F.col("nth") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))
