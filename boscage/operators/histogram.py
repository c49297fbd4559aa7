"""Fixed-point gradients and histograms.

Sums are of integers, so results don't depend on partitioning or order.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a task's dense histogram; beyond it the cells of some batches are sent on at a time.
DENSE_CELLS = 1 << 23
_PARTIAL = pa.schema([("cls", pa.int32()), ("node", pa.int32()), ("feat", pa.int32()), ("bin", pa.int32()), ("g", pa.int64()), ("h", pa.int64())])


def bounds(df: DataFrame, g: list[str], h: list[str]) -> tuple[int, list[tuple[float, float]]]:
    """(rows, largest absolute gradient and hessian of each output); rejects what isn't finite."""
    each = [F.max(F.abs(F.col(c))).alias(f"x{i}") for i, c in enumerate([*g, *h])]
    r = df.agg(F.count(F.lit(1)).alias("n"), *each).first()
    top = [r[f"x{i}"] or 0.0 for i in range(len(each))]
    if any(not math.isfinite(x) for x in top):
        raise ValueError("gradients are not finite")
    return r["n"], list(zip(top[: len(g)], top[len(g) :], strict=True))


def power_of_two(n: int, top: float) -> float:
    """The largest power of two that keeps the sum of n values inside 62 bits."""
    if not top or not n:
        return 1.0
    return 2.0 ** min(max(math.floor(math.log2(2.0**62 / n / top)), -1000), 1000)


def fixed(column: Column, scale: float) -> Column:
    return F.round(column.cast("double") * scale).cast("bigint")


def histogram(df: DataFrame, bins: dict[int, str], keys: list[str], g: str = "gq", h: str = "hq") -> DataFrame:
    """Sums by (keys, feat, bin) of present values: one scan for all nodes and
    outputs; partial sums leave each task, at most nodes x features x bins rows."""
    cells = F.array(*[F.struct(F.lit(f).alias("feat"), F.col(c).cast("int").alias("bin")) for f, c in bins.items()])
    own = df.select(*keys, g, h, F.explode(cells).alias("c"))
    own = own.where("c.bin is not null").select(*keys, "c.feat", "c.bin", g, h)
    return own.groupBy(*keys, "feat", "bin").agg(F.sum(g).alias("g"), F.sum(h).alias("h"))


def node_sums(df: DataFrame, keys: list[str], g: str = "gq", h: str = "hq") -> DataFrame:
    """Sums over all rows of a node, those with missing values too."""
    return df.groupBy(*keys).agg(F.sum(g).alias("g"), F.sum(h).alias("h"), F.count(F.lit(1)).alias("n"))


def with_totals(df: DataFrame, bins: dict[int, str], keys: list[str], g: str = "gq", h: str = "hq") -> DataFrame:
    """histogram() and node_sums() of one scan: the sums come as feature -1, bin 0."""
    marked = df.withColumn("_all", F.lit(0))
    return histogram(marked, {-1: "_all"} | bins, keys, g, h)


def exact_sums(key: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Integer sums by key: the high and low parts are each exact as doubles."""
    low = value & 0xFFFFF
    return (np.bincount(key, value >> 20, size).astype(np.int64) << 20) + np.bincount(key, low, size).astype(np.int64)


class BinnedTree:
    """A tree as arrays, to walk a batch of binned rows level by level."""

    def __init__(self, tree):
        nodes = tree.nodes
        self.feat, self.bin, self.left, self.right = (np.array([getattr(n, k) for n in nodes]) for k in ("feat", "bin", "left", "right"))
        self.default_left = np.array([n.default_left for n in nodes])
        self.value = np.array([n.value for n in nodes], np.float32)
        self.cats = {i: np.array(n.cats, int) for i, n in enumerate(nodes) if n.cats is not None}
        self.depth = tree.depth()

    def leaves(self, columns: dict[int, np.ndarray], rows: int) -> np.ndarray:
        """The leaf of each row; -1 is a missing bin."""
        at = np.zeros(rows, np.int64)
        for _ in range(self.depth):
            feats = self.feat[at]
            for f in np.unique(feats[feats >= 0]).tolist():
                own = np.flatnonzero(feats == f)
                n, v = at[own], columns[f][own]
                left = v < self.bin[n]
                for c in {int(i) for i in np.unique(n)} & self.cats.keys():
                    here = n == c
                    left[here] = ~np.isin(v[here], self.cats[c])
                left = np.where(v < 0, self.default_left[n], left)
                at[own] = np.where(left, self.left[n], self.right[n])
        return at


def bins_of(batch: pa.RecordBatch, feats: Iterable[int]) -> dict[int, np.ndarray]:
    """Bin numbers of a batch's columns b0, b1, ..., -1 for missing."""
    out = {}
    for f in feats:
        c = batch.column(batch.schema.get_field_index(f"b{f}"))
        out[f] = (c.fill_null(-1) if c.null_count else c).to_numpy(zero_copy_only=False)
    return out


def by_batches(df: DataFrame, trees: list, wanted: dict[int, list[int]], feats: list[int], sizes: list[int]) -> DataFrame:
    """(cls, node, feat, bin, g, h) of the wanted nodes of each output's tree, feature -1 for whole nodes.

    One scan: a task walks its rows down the trees and adds them to dense
    integer histograms, which it sends on at its end, so what is shuffled is
    tasks x nodes x features x bins and not rows x features.
    """
    used = sorted(set(feats) | {n.feat for k in wanted for n in trees[k].nodes if not n.leaf})
    walkers = {k: BinnedTree(trees[k]) for k in wanted}
    cells = sum(len(n) for n in wanted.values()) * (sum(sizes[f] for f in feats) + 1)

    def run(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {}
        for k, nodes in wanted.items():
            places[k] = np.full(len(walkers[k].feat), -1, np.int64)
            places[k][nodes] = np.arange(len(nodes))
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

        def add(k: int, f: int, key: np.ndarray, g: np.ndarray, h: np.ndarray, size: int) -> None:
            some = exact_sums(key, g, size), exact_sums(key, h, size)
            if (k, f) in held:
                for total, own in zip(held[k, f], some, strict=True):
                    total += own
            else:
                held[k, f] = some

        def sent() -> Iterator[pa.RecordBatch]:
            for (k, f), (g, h) in held.items():
                at = np.flatnonzero((g != 0) | (h != 0))
                wide = sizes[f] if f >= 0 else 1
                nodes = np.array(wanted[k])[at // wide]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(at), k, np.int32), nodes.astype(np.int32), np.full(len(at), f, np.int32), (at % wide).astype(np.int32), g[at], h[at])], schema=_PARTIAL)
            held.clear()

        for batch in arriving:
            columns = bins_of(batch, used)
            for k, nodes in wanted.items():
                place = places[k][walkers[k].leaves(columns, batch.num_rows)]
                own = np.flatnonzero(place >= 0)
                if not len(own):
                    continue
                place = place[own]
                g, h = (batch.column(batch.schema.get_field_index(f"{x}{k}")).to_numpy(zero_copy_only=False)[own] for x in ("gq", "hq"))
                add(k, -1, place, g, h, len(nodes))
                for f in feats:
                    b = columns[f][own]
                    key = place * sizes[f] + b
                    some = (b >= 0) & (b < sizes[f])
                    if some.all():
                        add(k, f, key, g, h, len(nodes) * sizes[f])
                    else:
                        add(k, f, key[some], g[some], h[some], len(nodes) * sizes[f])
            if cells > DENSE_CELLS:
                yield from sent()
        yield from sent()

    columns = [*[f"b{f}" for f in used], *[f"{x}{k}" for k in wanted for x in ("gq", "hq")]]
    partial = df.select(*columns).mapInArrow(run, "cls int, node int, feat int, bin int, g long, h long")
    return partial.groupBy("cls", "node", "feat", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


def with_leaf_values(df: DataFrame, trees: list) -> DataFrame:
    """df with the leaf value of each output's new tree added to m0, m1, ..., by Arrow batches: for trees too large to compile."""
    used = sorted({n.feat for t in trees for n in t.nodes if not n.leaf})
    walkers = [BinnedTree(t) for t in trees]

    def run(arriving: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arriving:
            columns = bins_of(batch, used)
            for k, w in enumerate(walkers):
                i = batch.schema.get_field_index(f"m{k}")
                new = batch.column(i).to_numpy(zero_copy_only=False).astype(np.float32) + w.value[w.leaves(columns, batch.num_rows)]
                batch = batch.set_column(i, batch.schema.field(i), pa.array(new, pa.float32()))
            yield batch

    return df.mapInArrow(run, df.schema)


def subtract(parent: DataFrame, child: DataFrame, keys: list[str]) -> DataFrame:
    """The sibling's histogram, exact because sums are integers."""
    p, c = parent.alias("p"), child.alias("c")
    joined = p.join(c, [*keys, "feat", "bin"], "left")
    return joined.select(*keys, "feat", "bin", (F.col("p.g") - F.coalesce(F.col("c.g"), F.lit(0))).alias("g"), (F.col("p.h") - F.coalesce(F.col("c.h"), F.lit(0))).alias("h"))
