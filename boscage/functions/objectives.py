"""Objectives as Column expressions: gradient, hessian, link and label rules.

``p`` is the raw margin and ``y`` the label, both double; results are double,
unweighted, and are cut to float by the caller where the model does so.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
FLOAT_MIN = 1.1754943508222875e-38


def sigmoid(p: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-p))


@dataclass(frozen=True)
class Objective:
    """grad and hess take (p, y, params); link maps margins to predictions."""

    name: str
    grad: Callable[[Column, Column, dict], Column]
    hess: Callable[[Column, Column, dict], Column]
    link: str = "identity"
    metric: str = "rmse"
    label: str = "any"
    intercept: str = "mean"
    weighs_positives: bool = False


def _sqlog_p(p: Column) -> Column:
    return F.greatest(p, F.lit(-1.0 + EPS))


def _expectile_w(p: Column, y: Column, q: dict) -> Column:
    a = q.get("expectile_alpha") or 0.5
    return F.when(p - y >= 0, F.lit(1.0 - a)).otherwise(F.lit(float(a)))


def _huber_root(p: Column, y: Column, q: dict) -> Column:
    return F.sqrt(1.0 + F.pow((p - y) / float(q["huber_slope"]), F.lit(2.0)))


def _tweedie(p: Column, y: Column, q: dict, order: int) -> Column:
    r = q["tweedie_variance_power"]
    a, b = y * F.exp((1.0 - r) * p), F.exp((2.0 - r) * p)
    return b - a if order == 1 else (2.0 - r) * b - (1.0 - r) * a


def _absolute(p: Column, y: Column, q: dict) -> Column:
    norm = F.hypot(F.lit(float(q["scale"])), p - y)
    return F.when(norm > 0, q["scale"] / norm).otherwise(F.lit(1.0))


def _quantile_x(p: Column, y: Column, q: dict) -> Column:
    return (p - y) / (0.04 * q["scale"])


def _quantile_grad(p: Column, y: Column, q: dict) -> Column:
    s = float(q["scale"])
    return 0.5 * s * (F.tanh(_quantile_x(p, y, q)) + 1.0 - 2.0 * q["level"]) if s > 0 else F.lit(0.0)


def _quantile_hess(p: Column, y: Column, q: dict) -> Column:
    if not q["scale"] > 0:
        return F.lit(0.0)
    x = _quantile_x(p, y, q)
    return 12.5 * F.greatest(F.when(x == 0, F.lit(1.0)).otherwise(F.tanh(x) / x), F.lit(3e-4))


def _logistic(name: str, link: str, metric: str) -> Objective:
    return Objective(name, lambda p, y, q: sigmoid(p) - y, lambda p, y, q: F.greatest(sigmoid(p) * (1.0 - sigmoid(p)), F.lit(1e-16)), link, metric, "unit", weighs_positives=True)


_ALL = [
    Objective("reg:squarederror", lambda p, y, q: p - y, lambda p, y, q: F.lit(1.0), weighs_positives=True),
    _logistic("binary:logistic", "sigmoid", "logloss"),
    _logistic("reg:logistic", "sigmoid", "rmse"),
    _logistic("binary:logitraw", "identity", "logloss"),
    Objective(
        "reg:squaredlogerror",
        lambda p, y, q: (F.log1p(_sqlog_p(p)) - F.log1p(y)) / (_sqlog_p(p) + 1.0),
        lambda p, y, q: F.greatest((1.0 - (F.log1p(_sqlog_p(p)) - F.log1p(y))) / F.pow(_sqlog_p(p) + 1.0, F.lit(2.0)), F.lit(1e-6)),
        metric="rmsle", label="over -1", weighs_positives=True,
    ),
    Objective(
        "binary:hinge",
        lambda p, y, q: F.when(p * (2.0 * y - 1.0) < 1.0, -(2.0 * y - 1.0)).otherwise(F.lit(0.0)),
        lambda p, y, q: F.when(p * (2.0 * y - 1.0) < 1.0, F.lit(1.0)).otherwise(F.lit(FLOAT_MIN)),
        "step", "error", "binary", "newton",
    ),
    Objective("count:poisson", lambda p, y, q: F.exp(p) - y, lambda p, y, q: F.exp(p + float(q["max_delta_step"])), "exp", "poisson-nloglik", "not negative"),
    Objective("reg:gamma", lambda p, y, q: 1.0 - y / F.exp(p), lambda p, y, q: y / F.exp(p), "exp", "gamma-nloglik", "positive", weighs_positives=True),
    Objective("reg:tweedie", lambda p, y, q: _tweedie(p, y, q, 1), lambda p, y, q: _tweedie(p, y, q, 2), "exp", "tweedie-nloglik", "not negative"),
    Objective(
        "reg:pseudohubererror",
        lambda p, y, q: (p - y) / _huber_root(p, y, q),
        lambda p, y, q: float(q["huber_slope"]) ** 2 / ((float(q["huber_slope"]) ** 2 + F.pow(p - y, F.lit(2.0))) * _huber_root(p, y, q)),
        metric="mphe", intercept="newton",
    ),
    Objective("reg:expectileerror", lambda p, y, q: _expectile_w(p, y, q) * (p - y), _expectile_w, metric="expectile", intercept="corrected"),
    Objective("reg:absoluteerror", lambda p, y, q: (p - y) * _absolute(p, y, q), _absolute, metric="mae", intercept="corrected"),
    Objective("reg:quantileerror", _quantile_grad, _quantile_hess, metric="quantile", intercept="quantile"),
]
SCALAR = {o.name: o for o in _ALL}
#: Objectives whose rows depend on other rows or outputs; their gradients are elsewhere.
JOINT = {
    "multi:softprob": "mlogloss", "multi:softmax": "merror", "rank:ndcg": "ndcg", "rank:map": "map", "rank:pairwise": "ndcg",
    "survival:cox": "cox-nloglik", "survival:aft": "aft-nloglik",
}
SCALED = ("reg:absoluteerror", "reg:quantileerror")


def check(name: str) -> None:
    if name not in SCALAR and name not in JOINT:
        raise ValueError(f"unknown objective {name!r}")


def link_of(name: str) -> str:
    if name in SCALAR:
        return SCALAR[name].link
    return {"multi:softprob": "softmax", "multi:softmax": "argmax", "survival:cox": "exp", "survival:aft": "exp"}.get(name, "identity")


def default_metric(name: str) -> str:
    return SCALAR[name].metric if name in SCALAR else JOINT[name]


def apply_link(margin: Column, link: str) -> Column:
    """Predictions (float) of a single margin."""
    p = margin.cast("double")
    out = {"identity": lambda: p, "sigmoid": lambda: sigmoid(p), "exp": lambda: F.exp(p), "step": lambda: F.when(p > 0, F.lit(1.0)).otherwise(F.lit(0.0))}[link]()
    return out.cast("float")


def softmax(margins: Column) -> Column:
    """An array of class probabilities; the largest margin is taken off first."""
    top = F.array_max(margins)
    e = F.transform(margins, lambda m: F.exp(m.cast("double") - top))
    return F.transform(e, lambda x: (x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)).cast("float"))


def argmax(margins: Column) -> Column:
    """The first class of the largest margin."""
    return (F.array_position(margins, F.array_max(margins)) - 1).cast("float")


def softmax_gradients(margins: Column, y: Column, k: int) -> tuple[Column, Column]:
    p = F.get(softmax(margins), F.lit(k)).cast("double")
    return p - F.when(y == k, F.lit(1.0)).otherwise(F.lit(0.0)), F.greatest(2.0 * p * (1.0 - p), F.lit(1e-16))


def label_rule(name: str, y: Column, num_class: int | None = None) -> Column:
    """Whether a label is allowed."""
    finite = y.isNotNull() & ~F.isnan(y.cast("double")) & (F.abs(y.cast("double")) < math.inf)
    if name.startswith("multi:"):
        return finite & (y == F.floor(y)) & (y >= 0) & (y < num_class)
    rule = SCALAR[name].label if name in SCALAR else "any"
    own = {"unit": (y >= 0) & (y <= 1), "binary": y.isin(0, 1), "over -1": y > -1, "not negative": y >= 0, "positive": y > 0, "any": F.lit(True)}[rule]
    return finite & own


def to_margin(name: str, base_score: float) -> float:
    """A base score as a margin."""
    link = link_of(name)
    if name in ("binary:logistic", "reg:logistic"):
        if not 0 <= base_score <= 1:
            raise ValueError("base_score must be a probability")
        x = min(max(base_score, EPS), 1 - EPS)
        return -math.log(1 / x - 1)
    if link == "exp":
        if base_score <= 0:
            raise ValueError("base_score must be positive")
        return math.log(base_score)
    return base_score


def from_margin(name: str, margin: float) -> float:
    link = link_of(name)
    if link == "sigmoid":
        return 1 / (1 + math.exp(-margin))
    return math.exp(margin) if link == "exp" else float(margin > 0) if link == "step" else margin


def residual_scale(p: Column, y: Column, w: Column) -> Column:
    """(weighted mean of the root of the absolute residual) squared; an aggregate."""
    total = F.sum(w)
    return F.when(F.abs(total) < EPS, F.lit(0.0)).otherwise(F.pow(F.sum(w * F.sqrt(F.abs(p - y))) / total, F.lit(2.0)))


def base_score(df: Any, name: str, y: str, w: str, q: dict) -> float:
    """The intercept estimated from labels: column names y and w (double)."""
    if name.startswith("survival:"):
        return 1.0 if name == "survival:cox" else 0.5
    yc, wc = F.col(y), F.col(w)
    o = SCALAR.get(name)
    positives = o is not None and o.weighs_positives and abs(q["scale_pos_weight"] - 1) > EPS
    if o is not None and (o.intercept == "newton" or positives):
        gw = wc * F.when(yc == 1, F.lit(float(q["scale_pos_weight"]))).otherwise(F.lit(1.0)) if positives else wc
        r = df.agg(F.sum(gw * o.grad(F.lit(0.0), yc, q)).alias("g"), F.sum(gw * o.hess(F.lit(0.0), yc, q)).alias("h")).first()
        return from_margin(name, -r["g"] / max(r["h"], EPS)) if r["h"] is not None else 0.5
    r = df.agg((F.sum(wc * yc) / F.sum(wc)).alias("m")).first()
    mean = 0.5 if r["m"] is None else r["m"]
    if o is None or o.intercept != "corrected":
        return mean
    scale = df.agg(residual_scale(F.lit(mean), yc, wc).alias("s")).first()["s"] if name in SCALED else 0.0
    q = q | {"scale": scale or 0.0}
    r = df.agg(F.sum(wc * o.grad(F.lit(mean), yc, q)).alias("g"), F.sum(wc * o.hess(F.lit(mean), yc, q)).alias("h")).first()
    return mean - r["g"] / max(r["h"], EPS) if r["h"] is not None else mean


def class_margins(df: Any, y: str, w: str, num_class: int) -> list[float]:
    """Centred log frequencies of the classes; a row for each class is read."""
    found = {int(r[0]): r[1] for r in df.groupBy(F.col(y).cast("int")).agg(F.sum(w)).collect()}
    total = sum(found.values())
    logs = [math.log(max(found.get(k, 0.0) / total, 1e-16)) if total else 0.0 for k in range(num_class)]
    mean = sum(logs) / num_class
    return [x - mean for x in logs]
