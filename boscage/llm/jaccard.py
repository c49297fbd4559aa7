"""N-gram Jaccard join by count-vector R-trees.

Documents are sets of word shingles.  Equal sets are one class.  Each class's
shingles are hashed into groups; the counts per group are a point, and the
overlap of two sets is at most the sum of the coordinate minima of their
points, or of the upper corners of the boxes that hold them.  R-trees over the
points find the pairs whose bound reaches the threshold, and these are verified
on the sets themselves.

An R-tree holds one unit of work.  Units come from an exact filter: two sets
above the threshold share one of their first n - ceil(t n) + 1 shingles in any
fixed order of all shingles.  The order puts rare cells of a fixed-size count
sketch first, so that frequent passages seldom meet; shingles of the same sets
count as one.  Sets that share such a shingle meet twice.  First only their points do: an R-tree per shingle links
those whose bound allows it, and what is linked, directly or through others,
forms a block.  Then the sets of a block meet, and an R-tree over them with
verification gives the links.  A heavy block or shingle is cut by a hash and
each pair of its parts is a unit, so no task holds more than a bounded number
of sets.  Inside a unit a pair that is already connected is not looked at
again, and a unit returns a spanning forest, so the rows are linear in the
documents whatever the size of a group of copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batches, ddl, fields
from .components import components
from .forest import Labels
from .store import Scratch, width
from .tables import table
from .words import U, Words, mix, pieces, signed

CELLS = 1 << 22
SLICES = 64
GROUPS = 64
LEAF = 32
_SETS = fields(doc_id="long", n_shingles="long", s1="long", s2="long", node="long", point="binary", cell_slice="int", cells="binary")
_ENTRIES = fields(key="long", node="long")
_EDGES = fields(a="long", b="long")
_POINTS = fields(comp="long", i="int", j="int", part="int", doc_id="long", shingles="binary")


def _identity(rows: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each row's set."""
    one, two = np.zeros(n, U), np.zeros(n, U)
    ptr = np.searchsorted(rows, np.arange(n + 1))
    for out, salt in ((one, U(0x5851F42D4C957F2D)), (two, U(0x14057B7EF767814F))):
        total = np.zeros(len(h) + 1, U)
        np.cumsum(mix(h ^ salt), out=total[1:])
        out[:] = total[ptr[1:]] - total[ptr[:-1]]
    return one, two


def _node(s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    return mix(s1 ^ mix(s2))


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> U(40)).astype(np.int64) % CELLS


def _groups(n: np.ndarray) -> np.ndarray:
    """Number of groups of a set of n: a power of two near n / 16, from 32 to 256."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(n, 1) / 16)).astype(int).clip(0), 32, 256)


def _point_array(rows: np.ndarray, h: np.ndarray, size: np.ndarray) -> pa.Array:
    """Counts per group, one byte each: counts over 255 are scaled and rounded up,
    so that sums of minima stay upper bounds; the first byte is the scale."""
    out = []
    ptr = np.searchsorted(rows, np.arange(len(size) + 1))
    for i, g in enumerate(_groups(size).tolist()):
        own = h[ptr[i] : ptr[i + 1]]
        c = np.bincount((own >> U(65 - g.bit_length())).astype(np.int64), minlength=g)
        scale = min(255, max(1, -(-int(c.max(initial=0)) // 255)))
        out.append(bytes((scale,)) + np.minimum(-(-c // scale), 255).astype(np.uint8).tobytes() if c.max(initial=0) <= 255 * 255 else bytes((0,)))
    return pa.array(out, pa.binary())


def _sets(k: int):
    """Per document the identity of its set; per task the counts of shingles by cell."""

    def run(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int32)
        none = lambda n, kind: pa.nulls(n, kind)
        for batch in arriving:
            for part in pieces(batch, "text"):
                rows, h = Words(part.column(1), lower=True).shingles(k)
                n = part.num_rows
                counts += np.bincount(_cell(h), minlength=CELLS).astype(np.int32)
                s1, s2 = _identity(rows, h, n)
                size = np.bincount(rows, minlength=n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(signed(s1)), pa.array(signed(s2)), pa.array(signed(_node(s1, s2))), _point_array(rows, h, size), none(n, pa.int32()), none(n, pa.binary())], schema=_SETS)
        step = CELLS // SLICES
        cells = [np.minimum(counts[i * step : (i + 1) * step], 65535).astype("<u2").tobytes() for i in range(SLICES)]
        yield pa.RecordBatch.from_arrays([*[none(SLICES, pa.int64())] * 5, none(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(cells, pa.binary())], schema=_SETS)

    return run


def _add(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of each slice, then their binary orders of magnitude."""
    total: dict[int, np.ndarray] = {}
    for batch in arriving:
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(raw.as_buffer(), "<u2").astype(np.int64)
            total[i] = total[i] + own if i in total else own
    if total:
        levels = [np.ceil(np.log2(total[i] + 1)).astype(np.uint8).tobytes() for i in total]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(levels, pa.binary())], schema=fields(cell_slice="int", cells="binary"))


def _levels(sets: DataFrame) -> np.ndarray:
    """One byte per cell: a table of CELLS bytes for any input."""
    found = sets.where("cell_slice is not null").select("cell_slice", "cells").repartition(SLICES, "cell_slice").mapInArrow(_add, "cell_slice int, cells binary").collect()
    out = np.zeros(CELLS, np.uint8)
    step = CELLS // SLICES
    for r in found:
        out[r["cell_slice"] * step : (r["cell_slice"] + 1) * step] = np.frombuffer(r["cells"], np.uint8)
    return out


def _entries(k: int, percent: int, levels: np.ndarray):
    """(shingle, set) for the first shingles of each set; copies inside a buffer count once."""

    def run(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_node, size = [], [], 0

        def flush():
            key, node = np.concatenate(held_key), np.concatenate(held_node)
            order = np.lexsort((node, key))
            key, node = key[order], node[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            yield from _entry_batches(key[new], node[new])

        for batch in arriving:
            for part in pieces(batch, "text"):
                rows, h = Words(part.column(1), lower=True).shingles(k)
                if not len(h):
                    continue
                s1, s2 = _identity(rows, h, part.num_rows)
                rank = (levels[_cell(h)].astype(U) << U(58)) | (h >> U(6))
                order = np.lexsort((h, rank, rows))
                h, rows = h[order], rows[order]
                start = np.searchsorted(rows, np.arange(part.num_rows))
                n = np.bincount(rows, minlength=part.num_rows)
                first = n - (percent * n + 99) // 100 + 1
                use = np.arange(len(h)) - start[rows] < first[rows]
                held_key.append(h[use])
                held_node.append(_node(s1, s2)[rows[use]])
                size += int(use.sum())
                if size > 500_000:
                    yield from flush()
                    held_key, held_node, size = [], [], 0
        if size:
            yield from flush()

    return run


def _entry_batches(key: np.ndarray, node: np.ndarray, step: int = 200_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(key), step):
        yield pa.RecordBatch.from_arrays([pa.array(signed(key[i : i + step])), pa.array(signed(node[i : i + step]))], schema=_ENTRIES)


def _shared(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and node: those of keys that two sets have, once each, named
    by a hash of the key's sets.  Near copies share most of their rare shingles among
    the same sets: these meet once for all of them."""

    def whole(key, node):
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node = key[new], node[new]
        same = key[1:] == key[:-1]
        use = np.zeros(len(key), bool)
        use[1:] |= same
        use[:-1] |= same
        key, node = key[use], node[use]
        if not len(key):
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], schema=_ENTRIES)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        total = np.add.reduceat(mix(node.view(U)), np.flatnonzero(new))
        return pa.RecordBatch.from_arrays([pa.array(signed(mix(total))[np.cumsum(new) - 1]), pa.array(node)], schema=_ENTRIES)

    held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for batch in arriving:
        if not batch.num_rows:
            continue
        key, node = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(held))
        cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
        if cut:
            yield whole(key[:cut], node[:cut])
        held = [key[cut:], node[cut:]]
    if len(held[0]):
        yield whole(*held)


def _bound(percent: int):
    """Rows of one shingle (and pair of parts): a spanning forest of the pairs whose bound allows a link."""

    def done(rows):
        node = [r[4] for r in rows]
        size = np.array([r[5] for r in rows], np.int64)
        part = np.array([r[3] for r in rows])
        labels = Labels(len(rows))
        groups = _groups(size)
        points = [np.frombuffer(r[6], np.uint8) for r in rows]
        for g in np.unique(groups).tolist():
            own = np.flatnonzero(groups == g)
            top = size[own].max()
            near = np.concatenate([own, np.flatnonzero((groups == 2 * g) & (percent * size <= 100 * top))])
            counts = np.stack([_unpacked(points[i], int(size[i]), int(groups[i]), g) for i in near])
            forest(counts, size[near], part[near], percent, labels, near, lambda a, b: True)
        for a, b in labels.edges:
            yield node[a], node[b]

    def run(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(units(arriving, 3, done), _EDGES)

    return run


def _unpacked(raw: np.ndarray, n: int, groups: int, g: int) -> np.ndarray:
    """Counts in g groups; a point that couldn't be packed allows anything."""
    if not raw[0]:
        return np.full(g, n, np.int32)
    c = raw[1:].astype(np.int32) * int(raw[0])
    return c.reshape(g, groups // g).sum(axis=1)


class RTree:
    """Boxes over count vectors, packed by size and then by the first counts."""

    def __init__(self, counts: np.ndarray, size: np.ndarray):
        self.order = np.lexsort((counts[:, 1], counts[:, 0] // 4, size))
        c, s = counts[self.order], size[self.order]
        self.levels = []
        at = np.arange(0, len(s), LEAF)
        top, low, high = np.maximum.reduceat(c, at, axis=0), np.minimum.reduceat(s, at), np.maximum.reduceat(s, at)
        self.levels.append((top, low, high))
        while len(low) > 16:
            at = np.arange(0, len(low), 16)
            top, low, high = np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))

    def leaves(self, top: np.ndarray, low: int, high: int, percent: int, upto: int) -> np.ndarray:
        """Leaves below upto that may hold a partner of a set inside the given box."""
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            tops, lows, highs = self.levels[depth]
            at = at[(at * 16**depth < upto) & (100 * highs[at] >= percent * low) & (100 * high >= percent * lows[at])]
            bound = np.minimum(tops[at], top).sum(axis=1)
            at = at[(100 + percent) * bound >= percent * (lows[at] + low)]
            if depth:
                at = (at[:, None] * 16 + np.arange(16)).ravel()
                at = at[at < len(self.levels[depth - 1][1])]
        return at


def forest(counts: np.ndarray, size: np.ndarray, part: np.ndarray, percent: int, labels: Labels, ids: np.ndarray, check: Callable[[int, int], bool]) -> None:
    """Join the labels of ids whose counts allow a link and that pass check.

    part: pairs of the same part are left to the unit of that part alone,
    unless all have one part.
    """
    tree = RTree(counts, size)
    order = tree.order
    across = bool(part.min() != part.max())
    tops, lows, highs = tree.levels[0]
    for leaf in range(len(lows)):
        x = order[leaf * LEAF : (leaf + 1) * LEAF]
        for other in tree.leaves(tops[leaf], lows[leaf], highs[leaf], percent, leaf + 1):
            y = order[other * LEAF : (other + 1) * LEAF]
            lx, ly = labels.of[ids[x]], labels.of[ids[y]]
            open_ = lx[:, None] != ly[None, :]
            if across:
                open_ &= part[x][:, None] != part[y][None, :]
            if other == leaf:
                open_ &= np.arange(len(x))[:, None] > np.arange(len(y))[None, :]
            if not open_.any():
                continue
            bound = np.minimum(counts[x][:, None, :], counts[y][None, :, :]).sum(axis=2)
            both = size[x][:, None] + size[y][None, :]
            least = np.minimum(size[x][:, None], size[y][None, :])
            open_ &= ((100 + percent) * bound >= percent * both) & ((100 + percent) * least >= percent * both)
            for p, q in zip(*np.nonzero(open_), strict=True):
                a, b = int(ids[x[p]]), int(ids[y[q]])
                if labels.of[a] != labels.of[b] and check(a, b):
                    labels.join(a, b)


def link(sets: list[np.ndarray], part: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sorted sets (100 * overlap >= percent * union)."""
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets) if n else np.zeros(0, U)
    row = np.repeat(np.arange(n), size)
    counts = np.bincount(row * GROUPS + (flat >> U(58)).astype(np.int64), minlength=n * GROUPS).reshape(n, GROUPS).astype(np.int32)
    labels = Labels(n)

    def check(a: int, b: int) -> bool:
        s, t = (sets[a], sets[b]) if size[a] <= size[b] else (sets[b], sets[a])
        overlap = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
        return (100 + percent) * overlap >= percent * int(size[a] + size[b])

    forest(counts, size, part, percent, labels, np.arange(n), check)
    return labels.edges


def _points(k: int):
    """A document's sorted shingles, once for each unit that it belongs to."""

    def run(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in arriving:
                for part in pieces(batch, "text"):
                    rows, h = Words(part.column(1), lower=True).shingles(k)
                    ptr = np.searchsorted(rows, np.arange(part.num_rows + 1))
                    s1, s2 = (signed(x).tolist() for x in _identity(rows, h, part.num_rows))
                    meta = [part.column(c).to_pylist() for c in (0, 2, 3, 4, 5, 6)]
                    for r, (doc, comp, parts, own, t1, t2) in enumerate(zip(*meta, strict=True)):
                        if (s1[r], s2[r]) == (t1, t2):  # another text under the same id stays out
                            raw = h[ptr[r] : ptr[r + 1]].tobytes()
                            for other in range(parts):
                                yield comp, min(own, other), max(own, other), own, doc, raw

        yield from batches(found(), _POINTS)

    return run


def units(arriving: Iterable[pa.RecordBatch], key: int, done: Callable) -> Iterator:
    """Calls done(rows) for each run of equal values in the first key columns."""
    now, held = None, []
    for batch in arriving:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if row[:key] != now:
                    if held:
                        yield from done(held)
                    now, held = row[:key], []
                held.append(row)
    if held:
        yield from done(held)


def _verify(percent: int):
    def done(rows):
        # copies of a row under one id are one set
        by = {(r[4], r[5]): r for r in rows}
        rows = list(by.values())
        sets = [np.frombuffer(r[5], U) for r in rows]
        for a, b in link(sets, np.array([r[3] for r in rows]), percent):
            yield rows[a][4], rows[b][4]

    def run(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(units(arriving, 3, done), _EDGES)

    return run


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", unit: int = 1_500_000, meeting: int = 20_000) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are lower-cased (A-Z).  component_id is the smallest doc_id that
    links reach, the row's own included.  Null, empty and blank texts have no
    shingles and link with nothing; rows with a null doc_id are counted and
    link with nothing; rows that share a doc_id are one node; repeated rows
    are returned each.  unit bounds the shingles of a
    part of a block and meeting the points of a part of a shingle.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = scratch.save(own.mapInArrow(_sets(k), ddl(_SETS)), "sets")
    levels = _levels(sets)
    members = sets.where("cell_slice is null").select("doc_id", "n_shingles", "s1", "s2", "node", "point")
    classes = members.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.max("node").alias("node"), F.max("point").alias("point"))
    classes = scratch.save(classes, "classes")
    dealt = own.mapInArrow(_entries(k, percent, levels), ddl(_ENTRIES)).repartition(width(spark), "key").sortWithinPartitions("key", "node")
    shared = scratch.save(dealt.mapInArrow(_shared, ddl(_ENTRIES)).distinct(), "shared")
    heavy = shared.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / meeting).cast("int").alias("parts")).where("parts > 1")
    # two sets under one node are both kept: their points may meet either way
    met = shared.join(classes.select("node", "n", "point"), "node").join(heavy, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    met = met.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "n", "point")
    near = met.repartition(width(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_bound(percent), ddl(_EDGES))
    blocks = components(near, scratch, "blocks")
    inside = scratch.save(classes.join(blocks, "node").select("rep", "n", "s1", "s2", F.col("root").alias("comp")), "candidates")
    weight = inside.groupBy("comp").agg(F.ceil(F.sum("n") / unit).cast("int").alias("parts"))
    dealt = inside.join(weight, "comp").select(F.col("rep").alias("doc_id"), "comp", "parts", F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("part"), "s1", "s2")
    # a merge join at every size: what would be broadcast grows with the documents
    with_text = own.join(dealt.hint("merge"), "doc_id").select("doc_id", "text", "comp", "parts", "part", "s1", "s2")
    points = with_text.mapInArrow(_points(k), ddl(_POINTS)).repartition(width(spark), "comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    links = components(points.mapInArrow(_verify(percent), ddl(_EDGES)), scratch, "links")
    roots = classes.select("s1", "s2", "rep").join(links.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("root", "rep").alias("root"))
    out = members.select("doc_id", "n_shingles", "s1", "s2").join(roots, ["s1", "s2"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("root"))).otherwise(F.col("doc_id")).alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) >= 5 THEN list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')) WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS s FROM w),
h AS (SELECT doc_id, hash(s) AS a, hash(s || '#') AS b FROM g),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY 1),
p AS (SELECT x.doc_id AS d, y.doc_id AS e, count(*) AS c FROM h x JOIN h y ON x.a = y.a AND x.b = y.b AND x.doc_id < y.doc_id GROUP BY 1, 2),
k AS (SELECT d, e FROM p JOIN n nd ON nd.doc_id = d JOIN n ne ON ne.doc_id = e WHERE 100 * c >= 80 * (nd.n + ne.n - c)),
r(d, e) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.d, CASE WHEN k.d = r.e THEN k.e ELSE k.d END FROM r JOIN k ON k.d = r.e OR k.e = r.e)
SELECT doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.e) AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.d = doc_id GROUP BY doc_id
"""


def op10_jaccard_join(spark, sf_dir):
    return jaccard_groups(table(spark, sf_dir, "documents"))
