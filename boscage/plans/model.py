"""Trees, the model and its JSON form."""

from __future__ import annotations

import json
import math
import os
import tempfile
import uuid
from dataclasses import dataclass, field
from typing import Any

import numpy as np

from ..functions import objectives

FLOAT_MIN, FLOAT_MAX = -3.4028234663852886e38, 3.4028234663852886e38


@dataclass
class Node:
    """A leaf (feat < 0, value) or a split.  Missing goes left if default_left;
    numbers below cond go left; categories in cats go right."""

    value: float = 0.0
    cover: float = 0.0
    feat: int = -1
    cond: float = 0.0
    bin: int = 0
    default_left: bool = False
    gain: float = 0.0
    left: int = -1
    right: int = -1
    parent: int = 2147483647
    cats: tuple[int, ...] | None = None
    base_weight: float = 0.0

    @property
    def leaf(self) -> bool:
        return self.feat < 0


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=lambda: [Node()])

    def split(self, at: int, feat: int, cond: float, bin_: int, default_left: bool, gain: float, cats, left: Node, right: Node) -> tuple[int, int]:
        n = self.nodes[at]
        n.feat, n.cond, n.bin, n.default_left, n.gain, n.cats = feat, cond, bin_, default_left, gain, cats
        n.left, n.right = len(self.nodes), len(self.nodes) + 1
        left.parent = right.parent = at
        self.nodes += [left, right]
        return n.left, n.right

    def depth(self) -> int:
        d = {0: 0}
        for i, n in enumerate(self.nodes):
            if not n.leaf:
                d[n.left] = d[n.right] = d[i] + 1
        return max(d.values())


@dataclass
class Model:
    objective: str
    features: list[str]
    trees: list[Tree] = field(default_factory=list)
    base_score: float = 0.5
    base_margins: list[float] = field(default_factory=lambda: [0.0])
    params: dict[str, Any] = field(default_factory=dict)
    categories: dict[str, list] = field(default_factory=dict)
    categorical: list[bool] = field(default_factory=list)
    best_iteration: int | None = None
    best_score: float | None = None

    @property
    def outputs(self) -> int:
        return len(self.base_margins)

    @property
    def num_trees(self) -> int:
        return len(self.trees)

    @property
    def num_class(self) -> int | None:
        return self.params.get("num_class")

    @property
    def n_features(self) -> int:
        return len(self.features)

    def rounds(self, begin: int = 0, end: int = 0) -> Model:
        """The model of rounds [begin, end); end 0 is all."""
        k, n = self.outputs, len(self.trees) // self.outputs
        end = end or n
        if not 0 <= begin <= end <= n:
            raise ValueError(f"rounds must be inside 0..{n}")
        return self._with(self.trees[begin * k : end * k])

    def first_trees(self, n: int) -> Model:
        return self._with(self.trees[:n])

    def class_view(self, k: int) -> Model:
        out = self._with(self.trees[k :: self.outputs])
        out.base_margins = [self.base_margins[k]]
        return out

    def _with(self, trees: list[Tree]) -> Model:
        return Model(self.objective, self.features, trees, self.base_score, list(self.base_margins), self.params, self.categories, self.categorical)

    def used_features(self) -> list[int]:
        return sorted({n.feat for t in self.trees for n in t.nodes if not n.leaf})

    def get_categories(self) -> dict[str, list]:
        return {k: list(v) for k, v in self.categories.items()}

    def get_score(self, kind: str = "weight") -> dict[str, float]:
        """Importance of the features that split: weight, gain, cover and their totals."""
        count, gain, cover = {}, {}, {}
        for t in self.trees:
            for n in t.nodes:
                if not n.leaf:
                    f = self.features[n.feat]
                    count[f] = count.get(f, 0) + 1
                    gain[f] = gain.get(f, 0.0) + n.gain
                    cover[f] = cover.get(f, 0.0) + n.cover
        own = {"weight": count, "total_gain": gain, "total_cover": cover}.get(kind)
        if own is not None:
            return {f: float(v) for f, v in own.items()}
        if kind in ("gain", "cover"):
            return {f: v / count[f] for f, v in (gain if kind == "gain" else cover).items()}
        raise ValueError(f"unknown importance {kind!r}")

    # ---- JSON

    def to_dict(self) -> dict:
        names = [f for f in self.features]
        types = ["c" if c else "float" for c in self.categorical or [False] * len(names)]
        k = self.outputs
        trees = [_tree_dict(t, i, len(names)) for i, t in enumerate(self.trees)]
        attributes = {}
        if self.best_iteration is not None:
            attributes = {"best_iteration": str(self.best_iteration), "best_score": repr(self.best_score)}
        attributes["base_margins"] = json.dumps(self.base_margins)
        attributes["parameters"] = json.dumps({a: b for a, b in self.params.items() if b is not None and not (isinstance(b, float) and math.isnan(b)) and isinstance(b, str | int | float | list | bool)})
        if self.categories:
            attributes["categories"] = json.dumps(self.categories)
        return {
            "version": [3, 0, 0],
            "learner": {
                "attributes": attributes,
                "cats": _cats_dict(self.features, self.categories),
                "feature_names": names,
                "feature_types": types,
                "gradient_booster": {
                    "name": "gbtree",
                    "model": {
                        "gbtree_model_param": {"num_trees": str(len(trees)), "num_parallel_tree": "1"},
                        "iteration_indptr": list(range(0, len(trees) + 1, k)),
                        "tree_info": [i % k for i in range(len(trees))],
                        "trees": trees,
                    },
                },
                "learner_model_param": {"base_score": repr(self.base_score), "num_class": str(k if self.objective.startswith("multi:") else 0), "num_feature": str(len(names)), "num_target": str(1 if self.objective.startswith("multi:") else k)},
                "objective": {"name": self.objective} | _objective_dict(self.objective, self.params),
            },
        }

    def save_model(self, path: str) -> None:
        """Whole file or none: written beside and moved.  A path with a scheme goes to that store."""
        text = json.dumps(self.to_dict())
        if "://" in path:
            fs, at, beside = _store(path)
            out = fs.create(beside, True)
            try:
                out.write(bytearray(text.encode()))
            finally:
                out.close()
            fs.delete(at, False)
            if not fs.rename(beside, at):
                raise OSError(f"{path} could not be written")
            return
        handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
        try:
            with os.fdopen(handle, "w") as file:
                file.write(text)
                file.flush()
                os.fsync(file.fileno())
            os.replace(temporary, path)
        except BaseException:
            os.unlink(temporary)
            raise

    @classmethod
    def load_model(cls, path: str) -> Model:
        if "://" in path:
            from pyspark.sql import SparkSession

            # a model is one small file; wholetext makes it one row
            return cls.from_dict(json.loads(SparkSession.getActiveSession().read.text(path, wholetext=True).first()[0]))
        with open(path) as file:
            return cls.from_dict(json.load(file))

    @classmethod
    def from_dict(cls, d: dict) -> Model:
        own = d["learner"]
        inner = own["gradient_booster"]["model"]
        trees = [_tree_of(t) for t in inner["trees"]]
        n = int(own["learner_model_param"]["num_feature"])
        names = own.get("feature_names") or [f"f{i}" for i in range(n)]
        score = own["learner_model_param"]["base_score"].strip("[]").split(",")
        base = float(score[0])
        objective = own["objective"]["name"]
        objectives.check(objective)
        attributes = own.get("attributes", {})
        k = max([1, *(i + 1 for i in inner["tree_info"])], default=1)
        margins = json.loads(attributes["base_margins"]) if "base_margins" in attributes else [objectives.to_margin(objective, base)] * k if len(score) == 1 else [float(x) for x in score]
        params = _objective_params(own["objective"]) | json.loads(attributes.get("parameters", "{}"))
        categories = json.loads(attributes["categories"]) if "categories" in attributes else _cats_of(names, own.get("cats") or {})
        out = cls(objective, names, trees, base, margins, params, categories, [t == "c" for t in own.get("feature_types") or ["float"] * n])
        if "best_iteration" in attributes:
            out.best_iteration, out.best_score = int(attributes["best_iteration"]), float(attributes.get("best_score", "nan"))
        return out


#: The block that a model file keeps an objective's parameters in.
OBJECTIVE_BLOCKS = {
    "reg_loss_param": (("reg:squarederror", "binary:logistic", "reg:logistic", "binary:logitraw", "reg:squaredlogerror", "reg:gamma"), ("scale_pos_weight",)),
    "poisson_regression_param": (("count:poisson",), ("max_delta_step",)),
    "tweedie_regression_param": (("reg:tweedie",), ("tweedie_variance_power",)),
    "pseudo_huber_param": (("reg:pseudohubererror",), ("huber_slope",)),
    "quantile_loss_param": (("reg:quantileerror",), ("quantile_alpha",)),
    "expectile_loss_param": (("reg:expectileerror",), ("expectile_alpha",)),
    "softmax_multiclass_param": (("multi:softprob", "multi:softmax"), ("num_class",)),
    "aft_loss_param": (("survival:aft",), ("aft_loss_distribution", "aft_loss_distribution_scale")),
    "lambdarank_param": (("rank:ndcg", "rank:map", "rank:pairwise"), ("lambdarank_pair_method", "lambdarank_num_pair_per_sample", "lambdarank_normalization", "lambdarank_score_normalization", "ndcg_exp_gain")),
}


def _objective_dict(objective: str, params: dict[str, Any]) -> dict:
    for block, (names, keys) in OBJECTIVE_BLOCKS.items():
        if objective in names:
            return {block: {k: _as_text(params[k]) for k in keys if params.get(k) is not None}}
    return {}


def _as_text(value: Any) -> str:
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, list | tuple):
        return "[" + ",".join(str(x) for x in value) + "]"
    return str(value)


def _objective_params(block: dict) -> dict[str, Any]:
    """Parameters from the objective's block: numbers, lists of numbers or names."""
    out = {}
    for name, (objectives_, keys) in OBJECTIVE_BLOCKS.items():
        for k in keys if block.get("name") in objectives_ else ():
            text = block.get(name, {}).get(k)
            if text is None:
                continue
            if text.startswith("["):
                out[k] = [float(x) for x in text.strip("[]").split(",") if x]
                out[k] = out[k][0] if k == "expectile_alpha" and len(out[k]) == 1 else out[k]
            else:
                try:
                    out[k] = int(text) if text.lstrip("-").isdigit() else float(text)
                except ValueError:
                    out[k] = text
    return out


def _cats_dict(features: list[str], categories: dict[str, list]) -> dict:
    """Category names of each feature: their bytes, signed, end
    to end with offsets, features' ends, and their order by those bytes."""
    enc, ends, order = [], [0], []
    for f in features if categories else []:
        names = [str(c).encode() for c in categories.get(f, [])]
        offsets = np.append(0, np.cumsum([len(c) for c in names])).astype(int).tolist() if names else []
        signed = [[b if b < 128 else b - 256 for b in c] for c in names]
        enc.append({"offsets": offsets, "values": [b for c in signed for b in c]})
        order += sorted(range(len(names)), key=lambda i, signed=signed: signed[i])
        ends.append(ends[-1] + len(names))
    return {"enc": enc, "feature_segments": ends if enc else [], "sorted_idx": order}


def _cats_of(features: list[str], cats: dict) -> dict[str, list]:
    out: dict[str, list] = {}
    for f, own in zip(features, cats.get("enc", []), strict=bool(cats.get("enc"))):
        raw, at = bytes(b & 255 for b in own.get("values", [])), own.get("offsets")
        if at:
            out[f] = [raw[i:j].decode() for i, j in zip(at, at[1:], strict=False)]
        elif own.get("values"):
            out[f] = list(own["values"])
    return out


def _store(path: str) -> tuple:
    """The file system of a path, the path, and one beside it."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = make(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, make(f"{path}.{uuid.uuid4().hex}.part")


def _tree_dict(t: Tree, i: int, n_features: int) -> dict:
    cats = [(j, n.cats) for j, n in enumerate(t.nodes) if not n.leaf and n.cats is not None]
    flat = [c for _, x in cats for c in x]
    starts = np.cumsum([0, *(len(x) for _, x in cats)]).tolist()[:-1] if cats else []
    return {
        "base_weights": [n.base_weight for n in t.nodes],
        "categories": flat, "categories_nodes": [j for j, _ in cats], "categories_segments": starts, "categories_sizes": [len(x) for _, x in cats],
        "default_left": [int(n.default_left) for n in t.nodes],
        "id": i,
        "left_children": [n.left for n in t.nodes], "right_children": [n.right for n in t.nodes], "parents": [n.parent for n in t.nodes],
        "loss_changes": [n.gain for n in t.nodes], "sum_hessian": [n.cover for n in t.nodes],
        "split_conditions": [n.value if n.leaf else n.cond for n in t.nodes],
        "split_indices": [max(n.feat, 0) for n in t.nodes],
        "split_type": [int(not n.leaf and n.cats is not None) for n in t.nodes],
        "tree_param": {"num_nodes": str(len(t.nodes)), "num_feature": str(n_features), "size_leaf_vector": "1", "num_deleted": "0"},
    }


def _tree_of(d: dict) -> Tree:
    cats = {j: tuple(d["categories"][s : s + k]) for j, s, k in zip(d.get("categories_nodes", []), d.get("categories_segments", []), d.get("categories_sizes", []), strict=True)}
    nodes = []
    for j, left in enumerate(d["left_children"]):
        own = Node(cover=d["sum_hessian"][j], parent=d["parents"][j], base_weight=d["base_weights"][j])
        if left < 0:
            own.value = d["split_conditions"][j]
        else:
            own.feat, own.cond, own.default_left, own.gain = d["split_indices"][j], d["split_conditions"][j], bool(d["default_left"][j]), d["loss_changes"][j]
            own.left, own.right, own.cats = left, d["right_children"][j], cats.get(j)
        nodes.append(own)
    return Tree(nodes)
