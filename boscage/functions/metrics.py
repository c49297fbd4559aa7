"""Evaluation metrics: weighted aggregates over predictions or margins.

Row-wise metrics of a table share one aggregate; the rank-based ones share
the running counts over distinct scores.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranking
from ..operators.ordered import running
from . import objectives

RANKING = ("ndcg", "map", "pre")
CURVES = ("auc", "aucpr")
HIGHER = ("auc", "aucpr", "ndcg", "map", "pre", "interval-regression-accuracy")


def _clamped(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1.0 - 1e-15)), F.lit(1e-15))


def log_factorial(y: Column) -> Column:
    """ln y!: exact to 20, and by Stirling's series beyond or between integers."""
    x = y + 1.0
    # shift x up by 7 so that three terms of the series give 1e-10
    shift, z = F.lit(0.0), x
    for _ in range(7):
        shift, z = shift + F.log(z), z + 1.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1.0 / (12.0 * z) - 1.0 / (360.0 * z * z * z) + 1.0 / (1260.0 * F.pow(z, F.lit(5.0)))
    return series - shift


def row_loss(name: str, p: Column, y: Column, q: dict) -> Column | None:
    """The loss of a row whose weighted mean is the metric (before a root)."""
    base, _, arg = name.partition("@")
    p, y = p.cast("double"), y.cast("double")
    d = p - y
    if base == "rmse":
        return d * d
    if base == "rmsle":
        return F.pow(F.log1p(F.greatest(p, F.lit(-1.0 + 1e-6))) - F.log1p(y), F.lit(2.0))
    if base == "mae":
        return F.abs(d)
    if base == "mape":
        return F.abs(d / y)
    if base == "mphe":
        s = float(q.get("huber_slope", 1.0))
        return s * s * (F.sqrt(1.0 + d * d / (s * s)) - 1.0)
    if base == "logloss":
        return -(y * F.log(_clamped(p)) + (1.0 - y) * F.log(1.0 - _clamped(p)))
    if base == "error":
        t = float(arg) if arg else 0.5
        return F.when(p > t, 1.0 - y).otherwise(y)
    if base == "poisson-nloglik":
        return p - y * F.log(F.greatest(p, F.lit(1e-16))) + log_factorial(y)
    if base == "gamma-deviance":
        return 2.0 * (F.log(p / y) + y / p - 1.0)
    if base == "gamma-nloglik":
        return F.log(p) + y / p
    if base == "tweedie-nloglik":
        r = float(arg) if arg else float(q.get("tweedie_variance_power", 1.5))
        return -y * F.pow(p, F.lit(1.0 - r)) / (1.0 - r) + F.pow(p, F.lit(2.0 - r)) / (2.0 - r)
    if base == "quantile":
        a = float(q.get("level", (q.get("quantile_alpha") or [0.5])[0]))
        return F.when(y >= p, a * (y - p)).otherwise((1.0 - a) * (p - y))
    if base == "expectile":
        a = float(q.get("expectile_alpha") or 0.5)
        return F.when(d >= 0, 1.0 - a).otherwise(F.lit(a)) * d * d
    return None


ROOTED = ("rmse", "rmsle")


def mean_loss(name: str, p: Column, y: Column, w: Column, q: dict) -> Column:
    m = F.sum(w * row_loss(name, p, y, q)) / F.sum(w)
    return F.sqrt(m) if name.partition("@")[0] in ROOTED else m


def class_loss(name: str, margins: Column, y: Column) -> Column:
    """mlogloss and merror of a row from its margins."""
    if name == "mlogloss":
        p = F.get(objectives.softmax(margins), y.cast("int")).cast("double")
        return -F.log(F.greatest(p, F.lit(1e-16)))
    if name == "merror":
        return F.when(objectives.argmax(margins) == y, 0.0).otherwise(1.0)
    raise ValueError(f"{name} is no class metric")


def curve_points(df: DataFrame, score: str, label: str, weight: str) -> DataFrame:
    """Distinct scores with weights of positives and negatives and their running sums from the top."""
    y, w = F.col(label).cast("double"), F.col(weight).cast("double")
    s = df.groupBy(F.col(score).cast("float").alias("score")).agg(F.sum(y * w).alias("tp"), F.sum((1.0 - y) * w).alias("fp"))
    return running(s, "score", {"tps": F.col("tp"), "fps": F.col("fp")}, descending=True)


def auc(df: DataFrame, score: str, label: str, weight: str) -> DataFrame:
    """One row, column auc: trapezoids over tied scores; null for one class."""
    c = curve_points(df, score, label, weight)
    area = F.sum(F.col("fp") * (F.col("tps") - F.col("tp") / 2))
    total = F.sum("tp") * F.sum("fp")
    return c.agg(F.when(total > 0, area / total).alias("auc"))


def aucpr(df: DataFrame, score: str, label: str, weight: str) -> DataFrame:
    """One row, column aucpr: the area between score steps by the interpolation of true and false positives."""
    c = curve_points(df, score, label, weight)
    pos = c.agg(F.sum("tp").alias("p")).first()["p"] or 0.0
    return c.agg((F.sum(ranking.pr_step()) / F.lit(pos or 1.0)).alias("aucpr"))


def check(name: str, objective: str) -> None:
    """Reject metrics that don't fit the objective."""
    base = name.partition("@")[0].rstrip("-")
    multi = objective.startswith("multi:")
    if (base in ("mlogloss", "merror")) != multi:
        raise ValueError(f"{name} doesn't fit {objective}")
    if base in RANKING and not objective.startswith(("rank:", "binary:")):
        raise ValueError(f"{name} doesn't fit {objective}")
    if base.startswith(("cox-", "aft-", "interval-")) and not objective.startswith("survival:"):
        raise ValueError(f"{name} doesn't fit {objective}")
    known = (*RANKING, *CURVES, "mlogloss", "merror", "cox-nloglik", "aft-nloglik", "interval-regression-accuracy")
    if base not in known and row_loss(name, F.lit(0.0), F.lit(0.0), {}) is None:
        raise ValueError(f"unknown metric {name!r}")


def improves(name: str) -> bool:
    """Whether more is better."""
    return name.partition("@")[0].rstrip("-") in HIGHER


def evaluate(df: DataFrame, names: list[str], objective: str, margins: list[str], y: str, w: str, q: dict, qid: str | None = None, row: str | None = None, upper: str | None = None) -> dict[str, float]:
    """Values of metrics on a table that holds margins; simple ones in one job."""
    out: dict[str, float] = {}
    yc, wc = F.col(y).cast("double"), F.col(w).cast("double")
    link = objectives.link_of(objective)
    scalar = link not in ("softmax", "argmax")
    pred = objectives.apply_link(F.col(margins[0]), link) if scalar else None
    simple = []
    for i, name in enumerate(names):
        base = name.partition("@")[0].rstrip("-")
        if base in ("mlogloss", "merror"):
            simple.append((name, (F.sum(wc * class_loss(name, F.array(*margins), F.col(y))) / F.sum(wc)).alias(f"m{i}")))
        elif base == "quantile" and len(margins) > 1:
            levels = q["quantile_alpha"]
            each = [row_loss(name, F.col(m), yc, q | {"level": a}) for m, a in zip(margins, levels, strict=True)]
            simple.append((name, (F.sum(wc * sum(each[1:], each[0])) / F.sum(wc) / len(each)).alias(f"m{i}")))
        elif base == "aft-nloglik" and q["aft_loss_distribution"] == "normal":
            continue
        elif base == "aft-nloglik" or base == "interval-regression-accuracy":
            from ..operators import survival

            lo, hi, m = yc, F.col(upper).cast("double"), F.col(margins[0]).cast("double")
            kind = q["aft_loss_distribution"]
            own = F.when((F.exp(m) >= lo) & (F.exp(m) <= hi), 1.0).otherwise(0.0) if base[0] == "i" else survival.aft_nloglik(m, lo, hi, kind, q["aft_loss_distribution_scale"])
            simple.append((name, (F.sum(wc * own) / F.sum(wc)).alias(f"m{i}")))
        elif scalar and row_loss(name, F.lit(0.0), F.lit(0.0), q) is not None:
            p = objectives.sigmoid(F.col(margins[0]).cast("double")).cast("float") if objective == "binary:logitraw" and base in ("logloss", "error") else pred
            simple.append((name, mean_loss(name, p, yc, wc, q).alias(f"m{i}")))
    if simple:
        r = df.agg(*[c for _, c in simple]).first()
        out |= {name: float(v) if v is not None else math.nan for (name, _), v in zip(simple, r, strict=True)}
    for name in names:
        if name in out:
            continue
        base, k, empty = ranking.parse_metric(name)
        if base == "auc" and qid:
            v = ranking.group_auc(df, qid, margins[0], y, row).agg(F.avg("auc")).first()[0]
        elif base == "aucpr" and qid:
            v = ranking.group_aucpr(df, qid, margins[0], y).agg(F.avg("aucpr")).first()[0]
        elif base in CURVES:
            v = (auc if base == "auc" else aucpr)(df, margins[0], y, w).first()[0]
        elif base in RANKING:
            ranking.check_labels(df, y, base, q.get("ndcg_exp_gain", True))
            own = df
            if not qid:  # all rows are one group
                own, group = df.withColumn("_one", F.lit(0)), "_one"
            else:
                group = qid
            if base == "ndcg":
                per = ranking.ndcg(own, group, margins[0], y, row, k, q.get("ndcg_exp_gain", True), empty)
            elif base == "map":
                per = ranking.average_precision(own, group, margins[0], y, row, k, empty)
            else:
                per = ranking.precision(own, group, margins[0], y, row, k)
            v = ranking.weighted_mean(per, base, own, group, w)
        elif base == "cox-nloglik":
            from ..operators import survival

            v = survival.cox_nloglik(df, margins[0], y, w).first()[0]
        elif base == "aft-nloglik":
            from ..operators import survival

            v = survival.aft_normal_nloglik(df, margins[0], y, upper, w, q["aft_loss_distribution_scale"]).first()[0]
        else:
            raise ValueError(f"unknown metric {name!r}")
        out[name] = math.nan if v is None else float(v)
    return {n: out[n] for n in names}
