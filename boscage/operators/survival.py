"""Cox and accelerated failure time objectives."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running


def cox_sums(df: DataFrame, margin: str, time: str, weight: str) -> DataFrame:
    """df with risk (all with a time not before this one), and the running sums
    of event mass / risk and event mass / risk squared (grouped Breslow).

    Margins are shifted by the largest one.  Sums per distinct time come
    first; running sums over them are distributed by buckets of time.
    """
    shift = df.where(F.col(weight) > 0).agg(F.max(margin)).first()[0] or 0.0
    own = df.withColumns({"t_abs": F.abs(F.col(time)).cast("double"), "mass": F.col(weight) * F.exp(F.col(margin).cast("double") - shift)})
    times = own.groupBy("t_abs").agg(F.sum("mass").alias("m"), F.sum(F.when(F.col(time) > 0, F.col(weight)).otherwise(F.lit(0.0))).alias("e"))
    risk = running(times, "t_abs", {"risk": F.col("m")}, descending=True)
    step = lambda x: F.when(F.col("e") > 0, F.col("e") / x).otherwise(F.lit(0.0))
    steps = running(risk, "t_abs", {"a": step(F.col("risk")), "b": step(F.col("risk") * F.col("risk"))})
    return own.join(steps.select("t_abs", "risk", "a", "b"), "t_abs").withColumn("shift", F.lit(float(shift)))


def cox_gradients(df: DataFrame, margin: str, time: str, weight: str, keep: list[str]) -> DataFrame:
    """keep, g0, h0 (already weighted)."""
    s = cox_sums(df, margin, time, weight)
    first = F.col("mass") * F.col("a")
    g = first - F.when(F.col(time) > 0, F.col(weight)).otherwise(F.lit(0.0))
    h = F.greatest(first - F.col("mass") * F.col("mass") * F.col("b"), F.lit(0.0))
    return s.select(*keep, g.cast("float").alias("g0"), h.cast("float").alias("h0"))


def cox_nloglik(df: DataFrame, margin: str, time: str, weight: str) -> DataFrame:
    """One row: negative log partial likelihood per event weight."""
    s = cox_sums(df, margin, time, weight).where((F.col(time) > 0) & (F.col(weight) > 0))
    loss = F.col(weight) * (F.log("risk") + F.col("shift") - F.col(margin).cast("double"))
    return s.agg((F.sum(loss) / F.sum(weight)).alias("cox_nloglik"))


def _pdf_cdf(z: Column, kind: str) -> tuple[Column, Column, Column]:
    """Density, distribution and slope of the density at z, of logistic and extreme errors."""
    if kind == "logistic":
        e = F.exp(-F.abs(z))
        pdf = e / F.pow(1.0 + e, F.lit(2.0))
        cdf = F.when(z >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))
        return pdf, cdf, pdf * (1.0 - 2.0 * cdf)
    if kind == "extreme":
        w = F.exp(F.least(z, F.lit(700.0)))
        s = F.exp(-w)
        return w * s, 1.0 - s, (1.0 - w) * w * s
    raise ValueError("the normal distribution takes aft_normal()")


GRAD_LIMIT, HESS_LOW, HESS_HIGH = 15.0, 1e-16, 15.0


def aft_gradients(margin: Column, low: Column, high: Column, kind: str, sigma: float) -> tuple[Column, Column]:
    """Gradient and hessian of the negative log likelihood of [low, high], from log margins."""
    z = lambda t: (F.log(t) - margin) / sigma
    fl, cl, dl = _pdf_cdf(z(low), kind)
    inf = F.lit(float("inf"))
    fu0, cu0, du0 = _pdf_cdf(z(high), kind)
    right, left = high == inf, low <= 0
    fu, cu, du = F.when(right, 0.0).otherwise(fu0), F.when(right, 1.0).otherwise(cu0), F.when(right, 0.0).otherwise(du0)
    fl, cl, dl = (F.when(left, 0.0).otherwise(x) for x in (fl, cl, dl))
    floor = F.lit(1e-12)
    exact = low == high
    mass = F.greatest(cu - cl, floor)
    g = F.when(exact, dl / F.greatest(fl, F.lit(1e-300)) / sigma).otherwise((fu - fl) / mass / sigma)
    r = (fu - fl) / mass
    if kind == "logistic":
        _, c, _ = _pdf_cdf(z(low), kind)
        curve = 2.0 * c * (1.0 - c)
    else:
        curve = F.exp(F.least(z(low), F.lit(700.0)))
    h = F.when(exact, curve / sigma**2).otherwise((r * r - (du - dl) / mass) / sigma**2)
    clip = lambda x, a, b: F.greatest(F.least(x, F.lit(b)), F.lit(a))
    return clip(g, -GRAD_LIMIT, GRAD_LIMIT), clip(h, HESS_LOW, HESS_HIGH)


def aft_normal(z: float) -> tuple[float, float, float]:
    """Density, distribution and slope of the normal error; Spark has no erf."""
    pdf = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return pdf, math.erfc(-z / math.sqrt(2)) / 2, -z * pdf


def aft_normal_gradients(df: DataFrame, margin: str, low: str, high: str, sigma: float) -> DataFrame:
    """df with g0, h0 by an Arrow batch function."""
    import numpy as np

    erfc = np.vectorize(math.erfc, otypes=[float])

    def run(it):
        for pdf in it:
            m, lo, hi = (pdf[c].to_numpy(float) for c in (margin, low, high))
            with np.errstate(all="ignore"):
                zl, zu = (np.log(lo) - m) / sigma, (np.log(hi) - m) / sigma
            den = lambda z: np.where(np.isfinite(z), np.exp(-np.minimum(z * z, 1400) / 2) / math.sqrt(2 * math.pi), 0.0)
            fl, fu = den(zl), den(zu)
            cl, cu = erfc(-np.clip(zl, -40, 40) / math.sqrt(2)) / 2, erfc(-np.clip(zu, -40, 40) / math.sqrt(2)) / 2
            dl, du = np.where(fl > 0, -zl * fl, 0.0), np.where(fu > 0, -zu * fu, 0.0)
            mass = np.maximum(cu - cl, 1e-12)
            r = (fu - fl) / mass
            exact = lo == hi
            g = np.where(exact, -zl / sigma, r / sigma)
            h = np.where(exact, 1 / sigma**2, (r * r - (du - dl) / mass) / sigma**2)
            yield pdf.assign(g0=np.clip(g, -GRAD_LIMIT, GRAD_LIMIT).astype(np.float32), h0=np.clip(h, HESS_LOW, HESS_HIGH).astype(np.float32))

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", g0 float, h0 float"
    return df.mapInPandas(run, out)


def aft_nloglik(margin: Column, low: Column, high: Column, kind: str, sigma: float) -> Column:
    """Negative log likelihood of one row (logistic and extreme)."""
    z = lambda t: (F.log(t) - margin) / sigma
    fl, cl, _ = _pdf_cdf(z(low), kind)
    _, cu, _ = _pdf_cdf(z(high), kind)
    cu = F.when(high == F.lit(float("inf")), 1.0).otherwise(cu)
    cl = F.when(low <= 0, 0.0).otherwise(cl)
    p = F.when(low == high, fl / (sigma * low)).otherwise(cu - cl)
    return -F.log(F.greatest(p, F.lit(1e-12)))


def aft_normal_nloglik(df: DataFrame, margin: str, low: str, high: str, weight: str, sigma: float) -> DataFrame:
    """One row: the weighted mean negative log likelihood under normal errors; a sum per Arrow batch."""
    import numpy as np

    erfc = np.vectorize(math.erfc, otypes=[float])

    def run(it):
        for pdf in it:
            m, lo, hi, w = (pdf[c].to_numpy(float) for c in (margin, low, high, weight))
            with np.errstate(all="ignore"):
                zl, zu = (np.log(lo) - m) / sigma, (np.log(hi) - m) / sigma
            cdf = lambda z: erfc(-np.clip(z, -40, 40) / math.sqrt(2)) / 2
            exact = lo == hi
            pdf_ = np.exp(-np.minimum(zl * zl, 1400) / 2) / math.sqrt(2 * math.pi) / (sigma * np.where(lo > 0, lo, 1.0))
            p = np.where(exact, pdf_, cdf(zu) - cdf(zl))
            yield type(pdf)({"s": [float((w * -np.log(np.maximum(p, 1e-12))).sum())], "n": [float(w.sum())]})

    return df.select(margin, low, high, weight).mapInPandas(run, "s double, n double").agg((F.sum("s") / F.sum("n")).alias("aft_nloglik"))


def check_bounds(df: DataFrame, low: str, high: str) -> None:
    lo, hi = F.col(low).cast("double"), F.col(high).cast("double")
    ok = (lo >= 0) & (lo < float("inf")) & (lo <= hi) & (hi > 0) & ~F.isnan(lo) & ~F.isnan(hi)
    if df.where(~F.coalesce(ok, F.lit(False))).limit(1).count():
        raise ValueError("survival bounds must satisfy 0 <= lower <= upper, upper > 0, and only upper may be infinite")
