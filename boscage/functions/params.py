"""Training parameters: defaults, aliases and validation."""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import Any

#: Names and defaults of the training interface.
DEFAULTS: dict[str, Any] = {
    "objective": "binary:logistic", "max_depth": 6, "max_leaves": 0, "grow_policy": "depthwise", "max_bin": 255, "eta": 0.3,
    "lambda": 1.0, "gamma": 0.0, "alpha": 0.0, "max_delta_step": None, "min_child_weight": 1.0, "tweedie_variance_power": 1.5,
    "huber_slope": 1.0, "aft_loss_distribution": "normal", "aft_loss_distribution_scale": 1.0, "quantile_alpha": None,
    "expectile_alpha": None, "num_class": None, "scale_pos_weight": 1.0, "subsample": 1.0, "sampling_method": "uniform",
    "colsample_bytree": 1.0, "colsample_bylevel": 1.0, "colsample_bynode": 1.0, "seed": 0, "base_score": None, "eval_metric": None,
    "monotone_constraints": None, "interaction_constraints": None, "feature_weights": None, "enable_categorical": False,
    "missing": math.nan, "max_cat_to_onehot": 4, "max_cat_threshold": 64, "lambdarank_pair_method": "topk",
    "lambdarank_num_pair_per_sample": None, "lambdarank_normalization": True, "lambdarank_score_normalization": True,
    "lambdarank_unbiased": False, "lambdarank_bias_norm": 1.0, "ndcg_exp_gain": True, "cache_path": None,
}
ALIASES = {"learning_rate": "eta", "reg_lambda": "lambda", "reg_alpha": "alpha", "min_split_loss": "gamma", "random_state": "seed"}
#: Resources that Spark manages: accepted and without effect.
RESOURCES = frozenset(("nthread", "n_jobs", "device", "gpu_math", "gpu_memory_budget", "hist_streams", "resident_blocks", "device_quantize", "hist_nodes_per_batch", "cols_per_block", "cache_budget_bytes", "verbosity"))
REJECTED = {"tree_method": "only histogram training exists", "num_parallel_tree": "random forests are not supported"}
GROWTH = ("depthwise", "lossguide", "symmetric")


def normalise(params: Mapping[str, Any]) -> dict[str, Any]:
    """All parameters with defaults; unknown names and bad values raise ValueError."""
    out = dict(DEFAULTS)
    seen = set()
    for name, value in params.items():
        if name in REJECTED:
            raise ValueError(f"{name}: {REJECTED[name]}")
        if name in RESOURCES:
            continue
        own = ALIASES.get(name, name)
        if own not in out:
            raise ValueError(f"unknown parameter {name!r}")
        if own in seen:
            raise ValueError(f"{own} is given twice")
        seen.add(own)
        out[own] = value
    _range(out, "max_depth", 0, 14)
    _range(out, "max_bin", 1, 65535)
    _range(out, "max_leaves", 0, 1 << 14)
    for name in ("eta", "lambda", "gamma", "alpha", "min_child_weight", "scale_pos_weight"):
        _range(out, name, 0, math.inf)
    for name in ("subsample", "colsample_bytree", "colsample_bylevel", "colsample_bynode"):
        _range(out, name, 0, 1)
        if out[name] == 0:
            raise ValueError(f"{name} must be over 0")
    if out["grow_policy"] not in GROWTH:
        raise ValueError(f"grow_policy must be one of {', '.join(GROWTH)}")
    if out["sampling_method"] not in ("uniform", "gradient_based"):
        raise ValueError("sampling_method must be uniform or gradient_based")
    if out["grow_policy"] == "lossguide" and not out["max_leaves"] and not out["max_depth"]:
        raise ValueError("lossguide needs max_leaves or max_depth")
    if out["grow_policy"] == "symmetric" and (out["monotone_constraints"] or out["interaction_constraints"]):
        raise ValueError("symmetric growth takes no monotone or interaction constraints")
    if not math.isnan(out["missing"]) and abs(out["missing"]) >= 3.4028234663852886e38:
        raise ValueError("missing must be NaN or under the largest float")
    if out["lambdarank_unbiased"] or out["lambdarank_bias_norm"] != 1.0:
        raise ValueError("lambdarank_unbiased and lambdarank_bias_norm are not supported")
    out["quantile_alpha"] = quantile_alpha(out["quantile_alpha"], out["objective"])
    if out["objective"].startswith("multi:") and (not out["num_class"] or out["num_class"] < 2):
        raise ValueError("num_class of at least 2 is needed")
    if out["max_delta_step"] is None:
        out["max_delta_step"] = 0.7 if out["objective"] == "count:poisson" else 0.0
    if not 1 < out["tweedie_variance_power"] < 2:
        raise ValueError("tweedie_variance_power must be between 1 and 2")
    return out


def _range(p: dict[str, Any], name: str, low: float, high: float) -> None:
    value = p[name]
    if isinstance(value, bool) or not isinstance(value, int | float) or not low <= value <= high or math.isnan(value):
        raise ValueError(f"{name} must be a number from {low} to {high}, not {value!r}")


def quantile_alpha(value: Any, objective: str) -> list[float] | None:
    if objective != "reg:quantileerror":
        if value is not None:
            raise ValueError("quantile_alpha belongs to reg:quantileerror")
        return None
    levels = [0.5] if value is None else [float(x) for x in (value if isinstance(value, list | tuple) else [value])]
    if not levels or len(levels) > 64 or any(not 0 < x < 1 for x in levels) or levels != sorted(set(levels)):
        raise ValueError("quantile_alpha must be ascending, between 0 and 1, and 64 at most")
    return levels


def per_feature(value: Any, features: list[str], what: str) -> list[float]:
    """A number per feature from a list, a '(1,0,-1)' string or a dict by name."""
    if value is None:
        return [0.0] * len(features)
    if isinstance(value, str):
        value = [float(x) for x in value.strip("() ").split(",") if x.strip()]
    if isinstance(value, Mapping):
        if unknown := set(value) - set(features):
            raise ValueError(f"{what}: unknown features {sorted(unknown)}")
        value = [value.get(f, 0) for f in features]
    value = list(value)
    if len(value) > len(features) or any(isinstance(v, bool) or not isinstance(v, int | float) for v in value):
        raise ValueError(f"{what} must be a number for each feature")
    return [float(v) for v in value] + [0.0] * (len(features) - len(value))


def interactions(value: Any, features: list[str]) -> list[frozenset[int]] | None:
    """Groups of feature numbers; a feature outside all groups is one of its own."""
    if not value:
        return None
    groups = []
    for group in value:
        own = set()
        for f in group:
            if isinstance(f, str):
                if f not in features:
                    raise ValueError(f"interaction_constraints: unknown feature {f!r}")
                own.add(features.index(f))
            elif isinstance(f, int) and 0 <= f < len(features):
                own.add(f)
            else:
                raise ValueError(f"interaction_constraints: {f!r} is no feature")
        groups.append(frozenset(own))
    listed = frozenset().union(*groups)
    return groups + [frozenset((i,)) for i in range(len(features)) if i not in listed]
