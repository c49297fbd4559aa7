"""Feature contributions of predictions, by Arrow batches.

SHAP values are exact for the path-dependent tree expectation: every leaf is
a product game over the features on its path, whose Shapley value is an
integral of a polynomial of degree under the number of those features; a
Gauss-Legendre rule of enough points integrates it without error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import Model, Tree
from .scoring import Walker, _some_rounds, features_of, matrix


def _paths(tree: Tree) -> list[tuple[int, dict[int, list[tuple[int, bool]]], dict[int, float]]]:
    """(leaf, feature -> [(node, whether the path goes left)], feature -> share of cover) of each leaf."""
    out = []
    stack: list[tuple[int, dict, dict]] = [(0, {}, {})]
    while stack:
        at, steps, share = stack.pop()
        n = tree.nodes[at]
        if n.leaf:
            out.append((at, steps, share))
            continue
        for child, left in ((n.left, True), (n.right, False)):
            part = tree.nodes[child].cover / n.cover if n.cover > 0 else 0.5
            out_steps = {k: list(v) for k, v in steps.items()}
            out_steps.setdefault(n.feat, []).append((at, left))
            stack.append((child, out_steps, share | {n.feat: share.get(n.feat, 1.0) * part}))
    return out


def root_mean(tree: Tree, at: int = 0) -> float:
    n = tree.nodes[at]
    if n.leaf:
        return n.value
    a, b = tree.nodes[n.left], tree.nodes[n.right]
    total = a.cover + b.cover
    share = a.cover / total if total > 0 else 0.5
    return share * root_mean(tree, n.left) + (1 - share) * root_mean(tree, n.right)


class Explainer:
    def __init__(self, model: Model):
        self.model, self.walker = model, Walker(model)
        self.paths = [_paths(t) for t in model.trees]
        self.bias = np.array(model.base_margins, float)
        for j, t in enumerate(model.trees):
            self.bias[j % model.outputs] += root_mean(t)

    def _games(self, x: np.ndarray) -> Iterator[tuple[int, float, list[int], np.ndarray, np.ndarray]]:
        """(output, leaf value, features, whether each row satisfies each, share of each)."""
        for j, (t, paths) in enumerate(zip(self.model.trees, self.paths, strict=True)):
            a = self.walker.trees[j]
            left = {}
            for i, n in enumerate(t.nodes):
                if not n.leaf:
                    left[i] = self.walker.goes_left(a, np.full(len(x), i), x[:, n.feat])
            for leaf, steps, share in paths:
                feats = sorted(steps)
                one = np.stack([np.all([left[i] == go for i, go in steps[f]], axis=0) for f in feats], 1) if feats else np.zeros((len(x), 0), bool)
                yield j % self.model.outputs, t.nodes[leaf].value, feats, one.astype(float), np.array([share[f] for f in feats])

    def shap(self, x: np.ndarray) -> np.ndarray:
        """rows x outputs x (features + 1); the last is the bias."""
        k, m = self.model.outputs, len(self.model.features)
        out = np.zeros((len(x), k, m + 1))
        out[:, :, m] = self.bias
        for o, value, feats, one, share in self._games(x):
            if not feats:
                continue
            nodes, weights = np.polynomial.legendre.leggauss(len(feats) // 2 + 1)
            for u, w in zip((nodes + 1) / 2, weights / 2, strict=True):
                each = u * one + (1 - u) * share
                whole = each.prod(axis=1)
                for i, f in enumerate(feats):
                    rest = whole / each[:, i] if (each[:, i] > 0).all() else np.delete(each, i, axis=1).prod(axis=1)
                    out[:, o, f] += w * value * rest * (one[:, i] - share[i])
        return out

    def interactions(self, x: np.ndarray) -> np.ndarray:
        """rows x outputs x (features + 1) x (features + 1); a row sums to the contribution."""
        k, m = self.model.outputs, len(self.model.features)
        out = np.zeros((len(x), k, m + 1, m + 1))
        for o, value, feats, one, share in self._games(x):
            if len(feats) < 2:
                continue
            nodes, weights = np.polynomial.legendre.leggauss(max(1, (len(feats) - 1) // 2 + 1))
            for u, w in zip((nodes + 1) / 2, weights / 2, strict=True):
                each = u * one + (1 - u) * share
                for i in range(len(feats)):
                    for j in range(i):
                        rest = np.delete(each, [i, j], axis=1).prod(axis=1)
                        v = w * value * rest * (one[:, i] - share[i]) * (one[:, j] - share[j]) / 2
                        out[:, o, feats[i], feats[j]] += v
                        out[:, o, feats[j], feats[i]] += v
        own = self.shap(x)
        at = np.arange(m + 1)
        out[:, :, at, at] = own - out.sum(axis=3)
        return out

    def saabas(self, x: np.ndarray) -> np.ndarray:
        """Changes of the node means along the path."""
        k, m = self.model.outputs, len(self.model.features)
        out = np.zeros((len(x), k, m + 1))
        out[:, :, m] = self.bias
        rows = np.arange(len(x))
        for j, t in enumerate(self.model.trees):
            a = self.walker.trees[j]
            mean = np.array([root_mean(t, i) for i in range(len(t.nodes))])
            at = np.zeros(len(x), int)
            for _ in range(a["depth"]):
                f = a["feat"][at]
                inner = f >= 0
                to = np.where(inner, np.where(self.walker.goes_left(a, at, x[rows, np.maximum(f, 0)]), a["left"][at], a["right"][at]), at)
                np.add.at(out, (rows[inner], j % k, f[inner]), (mean[to] - mean[at])[inner])
                at = to
        return out


def explain(df: DataFrame, model: Model, kind: str = "shap", missing: float = float("nan"), rounds: tuple[int, int] | None = None, n_trees: int | None = None, base_margin: list[str] | None = None) -> DataFrame:
    """df with an array column contributions: outputs x (features + 1) values, or
    their square for interactions, in row-major order.

    rounds or n_trees explain a part of the model.  base_margin names a column
    per output that takes the place of the intercept in the bias term.
    """
    model = _some_rounds(model, rounds, n_trees)
    if base_margin and len(base_margin) != model.outputs:
        raise ValueError(f"base_margin needs {model.outputs} columns")
    if kind not in ("shap", "saabas", "interactions"):
        raise ValueError(f"unknown explanation {kind!r}")
    used = model.used_features()
    columns = features_of(df, model, missing)
    names = [f"_x{i}" for i in used]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explainer = Explainer(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                y = getattr(explainer, kind)(matrix(b, names, len(model.features), used)).reshape(b.num_rows, model.outputs, -1)
                for k, c in enumerate(base_margin or ()):
                    y[:, k, -1] += b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) - model.base_margins[k]
                y = y.reshape(b.num_rows, -1)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(y.ravel().astype(np.float32)), y.shape[1]).cast(pa.list_(pa.float32()))
                keep = [i for i, f in enumerate(b.schema) if f.name not in names]
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], lists], names=[*[b.schema.field(i).name for i in keep], "contributions"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", contributions array<float>"
    return df.withColumns({f"_x{i}": columns[i] for i in used}).mapInArrow(run, out)


def contributions_sum(df: DataFrame) -> DataFrame:
    return df.withColumn("total", F.aggregate("contributions", F.lit(0.0), lambda a, b: a + b))
