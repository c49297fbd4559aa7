"""Estimators with fit, predict and score over DataFrames."""

from __future__ import annotations

import copy
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions import params as parameters
from ..functions.params import ALIASES, DEFAULTS, RESOURCES
from ..operators import scoring
from .model import Model
from .train import train


#: More classes than this are an error.
MOST_CLASSES = 65_535


class _Estimator:
    """Parameters by keyword; get_params and set_params as elsewhere."""

    default_objective = "reg:squarederror"

    def __init__(self, n_estimators: int = 100, features: Sequence[str] | None = None, label: str = "label", weight: str | None = None, early_stopping_rounds: int | None = None, **params: Any):
        for name in params:
            if name not in DEFAULTS and name not in ALIASES and name not in RESOURCES:
                raise ValueError(f"unknown parameter {name!r}")
        self.n_estimators, self.features, self.label, self.weight, self.early_stopping_rounds = n_estimators, features, label, weight, early_stopping_rounds
        self.params = params
        self.model: Model | None = None
        self.evals_result_: dict = {}

    _own = ("n_estimators", "features", "label", "weight", "early_stopping_rounds")

    def get_params(self, deep: bool = True) -> dict[str, Any]:
        return {k: getattr(self, k) for k in self._own} | copy.deepcopy(self.params)

    def set_params(self, **values: Any):
        for k, v in values.items():
            if k in self._own:
                setattr(self, k, v)
            else:
                self.params[k] = v
        return self

    def _options(self) -> dict[str, Any]:
        return {}

    def _data(self, df: DataFrame) -> DataFrame:
        return df

    def fit(self, df: DataFrame, eval_set: Sequence[tuple[DataFrame, str]] = (), **options: Any):
        p = {"objective": self.default_objective} | self.params | self._objective(df)
        sets = [(self._data(e), name) for e, name in eval_set]
        self.model = train(p, self._data(df), label=None if any(getattr(self, "bounds", ())) else self.label, num_boost_round=self.n_estimators, weight=self.weight, features=self.features, evals=sets, early_stopping_rounds=self.early_stopping_rounds, evals_result=self.evals_result_, **self._options() | options)
        return self

    def _objective(self, df: DataFrame) -> dict[str, Any]:
        return {}

    def _rounds(self) -> tuple[int, int] | None:
        """The best round is used where early stopping found one."""
        best = self.model.best_iteration
        return None if best is None else (0, best + 1)

    def predict(self, df: DataFrame, **options: Any) -> DataFrame:
        return scoring.predict(df, self.model, rounds=options.pop("rounds", self._rounds()), **options)

    def apply(self, df: DataFrame) -> DataFrame:
        r = self._rounds()
        return scoring.with_leaves(df, self.model.rounds(*r) if r else self.model)

    @property
    def feature_importances_(self) -> list[float]:
        gain = self.model.get_score("gain")
        total = sum(gain.values())
        return [gain.get(f, 0.0) / total if total else 0.0 for f in self.model.features]

    def save_model(self, path: str) -> None:
        self.model.save_model(path)

    def load_model(self, path: str):
        self.model = Model.load_model(path)
        return self

    @classmethod
    def from_file(cls, path: str, **params: Any):
        return cls(**params).load_model(path)

    def _weight(self):
        return F.col(self.weight).cast("double") if self.weight else F.lit(1.0)


class TreeRegressor(_Estimator):
    """bounds: the columns of the lower and upper bound of survival:aft."""

    def __init__(self, bounds: tuple[str | None, str | None] = (None, None), **params: Any):
        super().__init__(**params)
        self.bounds = bounds

    _own = (*_Estimator._own, "bounds")

    def _options(self) -> dict[str, Any]:
        return {"label_lower_bound": self.bounds[0], "label_upper_bound": self.bounds[1]} if any(self.bounds) else {}

    def fit(self, df: DataFrame, eval_set: Sequence[tuple[DataFrame, str]] = (), **options: Any):
        self.bounds = (options.get("label_lower_bound") or self.bounds[0], options.get("label_upper_bound") or self.bounds[1])
        return super().fit(df, eval_set, **options)

    def score(self, df: DataFrame) -> float:
        """R squared; for survival objectives the negative loss."""
        if self.model.objective.startswith("survival:"):
            own = scoring.predict(df, self.model, output_margin=True)
            if self.model.objective == "survival:cox":
                name, lower, upper = "cox-nloglik", self.label, None
            else:
                name, lower, upper = "aft-nloglik", self.bounds[0] or self.label, self.bounds[1] or self.label
                own = own.withColumn("y_upper", F.col(upper).cast("double"))
            own = own.withColumns({"m0": F.col("prediction"), "w": self._weight(), "y": F.col(lower).cast("double")})
            return -metrics.evaluate(own, [name], self.model.objective, ["m0"], "y", "w", parameters.normalise(self.model.params), upper="y_upper" if upper else None)[name]
        p, y, w = F.col("prediction").cast("double"), F.col(self.label).cast("double"), self._weight()
        scored = self.predict(df)
        mean = scored.agg(F.sum(w * y) / F.sum(w)).first()[0]
        r = scored.agg((1 - F.sum(w * F.pow(y - p, F.lit(2.0))) / F.sum(w * F.pow(y - mean, F.lit(2.0)))).alias("r")).first()
        return r["r"]


class TreeClassifier(_Estimator):
    default_objective = "binary:logistic"

    def __init__(self, **params: Any):
        super().__init__(**params)
        self.classes_: list = []

    def _objective(self, df: DataFrame) -> dict[str, Any]:
        found = df.select(self.label).where(F.col(self.label).isNotNull()).distinct().limit(MOST_CLASSES + 1).collect()
        if len(found) > MOST_CLASSES:
            raise ValueError(f"{self.label}: more than {MOST_CLASSES} classes")
        self.classes_ = sorted(r[0] for r in found)
        return {"objective": "multi:softprob", "num_class": len(self.classes_)} if len(self.classes_) > 2 else {}

    def _data(self, df: DataFrame) -> DataFrame:
        pairs = [x for i, c in enumerate(self.classes_) for x in (F.lit(c), F.lit(i))]
        return df.withColumn(self.label, F.element_at(F.create_map(*pairs), F.col(self.label)))

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Column probability: an array over classes_."""
        p = super().predict(df, column="_p")
        own = F.array((1 - F.col("_p")).cast("float"), F.col("_p")) if self.model.outputs == 1 else F.col("_p")
        return p.withColumn("probability", own).drop("_p")

    def predict(self, df: DataFrame, **options: Any) -> DataFrame:
        p = self.predict_proba(df)
        at = (F.array_position("probability", F.array_max("probability"))).cast("int")
        if self.model.outputs == 1:
            at = F.when(F.get("probability", F.lit(1)) > 0.5, 2).otherwise(1)
        return p.withColumn("prediction", F.get(F.array(*[F.lit(c) for c in self.classes_]), at - 1)).drop("probability")

    def score(self, df: DataFrame) -> float:
        w = self._weight()
        return self.predict(df).agg(F.sum(F.when(F.col("prediction") == F.col(self.label), w).otherwise(0.0)) / F.sum(w)).first()[0]


class TreeRanker(_Estimator):
    default_objective = "rank:ndcg"

    def __init__(self, qid: str = "qid", **params: Any):
        super().__init__(**params)
        self.qid = qid

    def _options(self) -> dict[str, Any]:
        return {"qid": self.qid}

    def score(self, df: DataFrame, metric: str | None = None) -> float:
        name = metric or (self.params.get("eval_metric") or "ndcg")
        name = name if isinstance(name, str) else name[-1]
        own = self.predict(df, output_margin=True).withColumns({"m0": F.col("prediction"), "y": F.col(self.label), "w": F.lit(1.0), "row": F.monotonically_increasing_id()})
        return metrics.evaluate(own, [name], self.model.objective, ["m0"], "y", "w", self.model.params, qid=self.qid, row="row")[name]
