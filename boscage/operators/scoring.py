"""Scoring: trees compiled to CASE expressions, or walked by levels in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import objectives
from ..plans.model import Model, Tree

#: Nodes up to which trees are compiled; code beyond that outgrows what the JVM compiles.
COMPILED_NODES = 2000


def _in_set(v: Column, cats: tuple[int, ...]) -> Column:
    return v.cast("int").isin(*cats) if cats else F.lit(False)


def route(tree: Tree, columns: dict[int, Column], leaf, binned: bool = False, at: int = 0) -> Column:
    """leaf(node number, node) of the leaf that a row reaches.  Columns are null for missing."""
    n = tree.nodes[at]
    if n.leaf:
        return leaf(at, n)
    v = columns[n.feat]
    if n.cats is not None:
        right = _in_set(v, n.cats) & (v >= 0) & (v < 2**24)
        left = ~right
    else:
        left = v < (F.lit(n.bin) if binned else F.lit(n.cond).cast("float"))
    go = F.when(v.isNull(), F.lit(n.default_left)).otherwise(left)
    return F.when(go, route(tree, columns, leaf, binned, n.left)).otherwise(route(tree, columns, leaf, binned, n.right))


def leaf_value(tree: Tree, columns: dict[int, Column], binned: bool = False) -> Column:
    return route(tree, columns, lambda _, n: F.lit(float(n.value)).cast("float"), binned)


def leaf_id(tree: Tree, columns: dict[int, Column], binned: bool = False) -> Column:
    return route(tree, columns, lambda i, _: F.lit(i), binned)


def features_of(df: DataFrame, model: Model, missing: float = float("nan")) -> dict[int, Column]:
    """Column of each feature that a split uses, as float or code; the whole schema is
    checked.  A category that training didn't see fails the job."""
    from .binning import as_feature, known_code

    for f in model.features:
        if f not in df.columns:
            raise ValueError(f"feature {f!r} is missing")
    out = {}
    for i in model.used_features():
        f = model.features[i]
        names = model.categories.get(f)
        if names:
            out[i] = known_code(names, f).cast("float")
        else:
            out[i] = as_feature(f, missing)
    return out


def margins(df: DataFrame, model: Model, base_margin: list[str] | None = None, missing: float = float("nan")) -> list[Column]:
    """A float expression per output, added in tree order."""
    columns = features_of(df, model, missing)
    out = []
    for k in range(model.outputs):
        m = F.col(base_margin[k]).cast("float") if base_margin else F.lit(float(model.base_margins[k])).cast("float")
        for t in model.trees[k :: model.outputs]:
            m = m + leaf_value(t, columns)
        out.append(m)
    return out


class Walker:
    """Arrays of a model for walking all rows of a batch one level at a time."""

    def __init__(self, model: Model):
        self.model = model
        self.trees = []
        for t in model.trees:
            a = {k: np.array([getattr(n, k) for n in t.nodes]) for k in ("feat", "cond", "default_left", "left", "right", "value", "cover")}
            a["cond"], a["value"] = a["cond"].astype(np.float32), a["value"].astype(np.float32)
            a["cats"] = [n.cats for n in t.nodes]
            a["depth"] = t.depth()
            self.trees.append(a)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf numbers, rows x trees, of float32 rows with NaN for missing."""
        out = np.zeros((len(x), len(self.trees)), np.int32)
        rows = np.arange(len(x))
        for j, a in enumerate(self.trees):
            at = np.zeros(len(x), np.int32)
            for _ in range(a["depth"]):
                f = a["feat"][at]
                inner = f >= 0
                v = x[rows, np.maximum(f, 0)]
                left = self.goes_left(a, at, v)
                at = np.where(inner, np.where(left, a["left"][at], a["right"][at]), at)
            out[:, j] = at
        return out

    @staticmethod
    def goes_left(a: dict, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        left = np.where(np.isnan(v), a["default_left"][at], v < a["cond"][at])
        for node in {int(i) for i in np.unique(at) if a["cats"][int(i)] is not None}:
            here = (at == node) & ~np.isnan(v)
            left[here] = ~(np.isin(np.trunc(v[here]), a["cats"][node]) & (v[here] >= 0))
        return left

    def margins(self, x: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        k = self.model.outputs
        out = np.tile(np.array(self.model.base_margins, np.float32), (len(x), 1)) if start is None else start.astype(np.float32)
        leaves = self.leaves(x)
        for j, a in enumerate(self.trees):
            out[:, j % k] += a["value"][leaves[:, j]]
        return out


def matrix(batch: pa.RecordBatch, names: list[str], width: int, at: list[int]) -> np.ndarray:
    x = np.full((batch.num_rows, width), np.nan, np.float32)
    for name, i in zip(names, at, strict=True):
        x[:, i] = batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.float32)
    return x


def compiles(model: Model) -> bool:
    return sum(len(t.nodes) for t in model.trees) <= COMPILED_NODES


def _walked(df: DataFrame, model: Model, base_margin: list[str] | None, missing: float, what: str) -> DataFrame:
    """df with column `what` ('margins' or 'leaves') as an array, by Arrow batches."""
    used = model.used_features()
    columns = features_of(df, model, missing)
    names = [f"_x{i}" for i in used]
    own = df.withColumns({f"_x{i}": columns[i] for i in used})
    kind = pa.float32() if what == "margins" else pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker(model)
        for b in batches:
            x = matrix(b, names, len(model.features), used)
            start = np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in base_margin], 1) if base_margin else None
            y = walker.margins(x, start) if what == "margins" else walker.leaves(x)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(y.ravel(), kind), y.shape[1]).cast(pa.list_(kind)) if y.shape[1] else pa.array([[]] * len(y), pa.list_(kind))
            keep = [i for i, f in enumerate(b.schema) if f.name not in names]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], lists], names=[*[b.schema.field(i).name for i in keep], what])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {what} array<{'float' if what == 'margins' else 'int'}>"
    return own.mapInArrow(run, out)


def with_margins(df: DataFrame, model: Model, base_margin: list[str] | None = None, missing: float = float("nan")) -> DataFrame:
    """df with an array column margins."""
    if compiles(model):
        return df.withColumn("margins", F.array(*margins(df, model, base_margin, missing)))
    return _walked(df, model, base_margin, missing, "margins")


def with_leaves(df: DataFrame, model: Model, missing: float = float("nan")) -> DataFrame:
    """df with an array column leaves: the leaf number of each tree."""
    if compiles(model):
        columns = features_of(df, model, missing)
        return df.withColumn("leaves", F.array(*[leaf_id(t, columns) for t in model.trees]) if model.trees else F.array().cast("array<int>"))
    return _walked(df, model, None, missing, "leaves")


def prediction(model: Model, margins_: Column, output_margin: bool = False, named: str | None = None) -> Column:
    """A float, or an array for several outputs; ``named`` replaces the objective's own link."""
    link = named or objectives.link_of(model.objective)
    if output_margin:
        return F.get(margins_, F.lit(0)) if model.outputs == 1 else margins_
    if link == "softmax":
        return objectives.softmax(margins_)
    if link == "argmax":
        return objectives.argmax(margins_)
    if model.outputs > 1:
        if named:
            return F.transform(margins_, lambda m: objectives.apply_link(m, link))
        return F.array_sort(margins_)  # quantiles don't cross
    return objectives.apply_link(F.get(margins_, F.lit(0)), link)


#: Links that a prediction may be asked for by name.
LINKS = ("identity", "sigmoid", "exp", "softmax")


def _some_rounds(model: Model, rounds: tuple[int, int] | None, n_trees: int | None) -> Model:
    if rounds is not None and n_trees is not None:
        raise ValueError("give rounds or n_trees, not both")
    return model.rounds(*rounds) if rounds is not None else model.first_trees(n_trees) if n_trees is not None else model


def predict(
    df: DataFrame, model: Model, output_margin: bool = False, base_margin: list[str] | None = None, missing: float = float("nan"), rounds: tuple[int, int] | None = None, n_trees: int | None = None,
    column: str = "prediction", strict_shape: bool = False, link: str | None = None,
) -> DataFrame:
    """df with a prediction column; no shuffle, and only columns that a split uses are read.

    strict_shape gives an array for one output too; link is one of LINKS and
    replaces the objective's own.
    """
    if link is not None and (link not in LINKS or output_margin):
        raise ValueError(f"link must be one of {', '.join(LINKS)}, without output_margin")
    m = _some_rounds(model, rounds, n_trees)
    p = prediction(m, F.col("margins"), output_margin, link)
    if strict_shape and (m.outputs == 1 or objectives.link_of(m.objective) == "argmax" and not output_margin and link is None) and link != "softmax":
        p = F.array(p)
    return with_margins(df, m, base_margin, missing).withColumn(column, p).drop("margins")


def predict_array(x: np.ndarray, model: Model, base_margin: np.ndarray | None = None, missing: float = float("nan"), rounds: tuple[int, int] | None = None, n_trees: int | None = None) -> np.ndarray:
    """Margins, rows x outputs, of a dense array whose columns are the model's features, on the driver."""
    if x.ndim != 2 or x.shape[1] != len(model.features):
        raise ValueError(f"an array of {len(model.features)} columns is needed")
    own = x.astype(np.float32)
    if not np.isnan(missing):
        own = np.where(own == np.float32(missing), np.float32("nan"), own)
    return Walker(_some_rounds(model, rounds, n_trees)).margins(own, None if base_margin is None else np.asarray(base_margin).reshape(len(x), -1))
