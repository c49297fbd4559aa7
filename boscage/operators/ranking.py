"""Query groups, ranks, LambdaMART gradients and ranking metrics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, qid: str, score: str, label: str, row: str) -> DataFrame:
    """Positions from 0 by falling score and by falling label, ties by row."""
    by_score = Window.partitionBy(qid).orderBy(F.col(score).desc(), F.col(row))
    by_label = Window.partitionBy(qid).orderBy(F.col(label).desc(), F.col(row))
    return df.withColumns({"pos": F.row_number().over(by_score) - 1, "ideal": F.row_number().over(by_label) - 1})


def with_sizes(df: DataFrame, sizes: list[int], row: str, qid: str = "qid") -> DataFrame:
    """df with a group number: the first sizes[0] rows by the row column are group 0, and so on.

    Rows are numbered by running counts, without a global sort in one task.
    """
    from .binning import search_bin
    from .ordered import running

    if not sizes or any(not isinstance(x, int) or x < 1 for x in sizes):
        raise ValueError("group sizes must be whole numbers from 1 on")
    counted = running(df, row, {"_upto": F.lit(1)})
    n, distinct = df.agg(F.count(F.lit(1)), F.countDistinct(row)).first()
    if n != sum(sizes):
        raise ValueError(f"group sizes sum to {sum(sizes)}, not to {n} rows")
    if distinct != n:
        raise ValueError(f"{row} must differ in all rows")
    if n >= 1 << 24:  # the borders are compared as floats
        raise ValueError("use a query column for tables of this size")
    edges = [float(x) for x in np.cumsum(sizes)[:-1]]
    return counted.withColumn(qid, search_bin((F.col("_upto") - 1).cast("float"), edges).cast("long")).drop("_upto")


def check_qid(df: DataFrame, qid: str) -> None:
    """Query numbers are whole and present."""
    q = F.col(qid).cast("double")
    if df.where(q.isNull() | F.isnan(q) | (q != F.floor(q))).limit(1).count():
        raise ValueError(f"{qid}: query numbers must be whole and present")


def rank_score(df: DataFrame, qid: str, score: str, label: str, row: str, metric: str = "ndcg", weight: str | None = None) -> float | None:
    """One ranking metric of scores that a table holds."""
    from ..functions import metrics

    own = df.withColumn("_w", F.col(weight).cast("double") if weight else F.lit(1.0))
    return metrics.evaluate(own, [metric], "rank:ndcg", [score], label, "_w", {}, qid, row)[metric]


def check_order(df: DataFrame, qid: str, row: str) -> None:
    """Each group's rows must be one run of row numbers: compared by sums, without a global sort."""
    runs = df.groupBy(qid).agg(F.min(row).alias("a"), F.max(row).alias("b"), F.count(F.lit(1)).alias("n")).where("b - a + 1 <> n")
    if bad := runs.first():
        raise ValueError(f"query {bad[0]!r} is not contiguous")


def _gain(label: Column, exponential: bool) -> Column:
    return F.pow(F.lit(2.0), label.cast("double")) - 1.0 if exponential else label.cast("double")


def ndcg(df: DataFrame, qid: str, score: str, label: str, row: str, k: int = 32, exponential: bool = True, empty: float = 1.0) -> DataFrame:
    """(qid, ndcg, relevant) at k; a group without relevant rows counts as `empty`."""
    r = ranked(df, qid, score, label, row)
    gain = _gain(F.col(label), exponential)
    own = F.sum(F.when(F.col("pos") < k, gain / F.log2(F.col("pos") + 2.0)).otherwise(0.0))
    best = F.sum(F.when(F.col("ideal") < k, gain / F.log2(F.col("ideal") + 2.0)).otherwise(0.0))
    return r.groupBy(qid).agg(own.alias("dcg"), best.alias("idcg")).select(qid, F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(F.lit(empty)).alias("ndcg"), (F.col("idcg") > 0).alias("relevant"))


def average_precision(df: DataFrame, qid: str, score: str, label: str, row: str, k: int = 32, empty: float = 1.0) -> DataFrame:
    """(qid, map) at k of binary labels."""
    r = ranked(df, qid, score, label, row).withColumn("hit", (F.col(label) > 0).cast("int"))
    upto = Window.partitionBy(qid).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("hits", F.sum("hit").over(upto))
    top = F.sum(F.when((F.col("pos") < k) & (F.col("hit") == 1), F.col("hits") / (F.col("pos") + 1.0)).otherwise(0.0))
    return r.groupBy(qid).agg(top.alias("s"), F.sum("hit").alias("n")).select(qid, F.when(F.col("n") > 0, F.col("s") / F.least(F.col("n"), F.lit(k))).otherwise(F.lit(empty)).alias("map"))


def precision(df: DataFrame, qid: str, score: str, label: str, row: str, k: int = 32) -> DataFrame:
    """(qid, pre) at k."""
    r = ranked(df, qid, score, label, row)
    hits = F.sum(F.when((F.col("pos") < k) & (F.col(label) > 0), 1).otherwise(0))
    return r.groupBy(qid).agg((hits / F.least(F.lit(k), F.count(F.lit(1)))).alias("pre"))


def ordered_share(s: np.ndarray, block: int = 1024) -> float:
    """Share of the pairs i < j with s[i] > s[j], ties count half: blocks against all before them, sorted."""
    good, seen = 0.0, s[:0]
    for at in range(0, len(s), block):
        x = s[at : at + block]
        low, high = np.searchsorted(seen, x, "left"), np.searchsorted(seen, x, "right")
        good += float((len(seen) - high).sum()) + float((high - low).sum()) / 2
        first, second = np.triu_indices(len(x), 1)
        good += float((x[first] > x[second]).sum()) + float((x[first] == x[second]).sum()) / 2
        seen = np.sort(np.concatenate([seen, x]), kind="stable")
    return good / (len(s) * (len(s) - 1) / 2)


def group_auc(df: DataFrame, qid: str, score: str, label: str, row: str) -> DataFrame:
    """(qid, auc): of all pairs of a group, in the order of falling labels and then of
    rows, the share whose scores fall too; groups under three rows are left out."""

    def run(key, pdf):
        own = pdf.sort_values([label, row], ascending=[False, True], kind="stable")[score].to_numpy()
        return type(pdf)({qid: [key[0]], "auc": [ordered_share(own)]}) if len(own) >= 3 else type(pdf)({qid: pdf[qid][:0], "auc": []})

    kind = df.schema[qid].dataType.simpleString()
    return df.select(qid, score, label, row).groupBy(qid).applyInPandas(run, f"`{qid}` {kind}, auc double")


def pr_step() -> Column:
    """The area under the precision of a score step, from tp, fp (its own) and tps, fps (down to it)."""
    a, b = F.col("tps") - F.col("tp"), F.col("tps")
    f0 = F.col("fps") - F.col("fp")
    slope = F.col("fp") / F.col("tp")
    # precision along a step is t / (t + f0 + slope * (t - a)); its integral over t has a logarithm
    k, m = 1.0 + slope, f0 - slope * a
    area = ((b - a) / k) - (m / (k * k)) * F.log((k * b + m) / F.when(k * a + m > 0, k * a + m).otherwise(F.lit(1.0)))
    flat = F.when(m == 0, (b - a) / k).otherwise(area)
    return F.when(F.col("tp") > 0, flat).otherwise(0.0)


def group_aucpr(df: DataFrame, qid: str, score: str, label: str) -> DataFrame:
    """(qid, aucpr) of each group; groups of one class are left out.  A weight of a
    whole group cancels.  Labels must be in [0, 1]."""
    y = F.col(label).cast("double")
    if bad := df.where(~F.coalesce((y >= 0) & (y <= 1), F.lit(False))).select(label).first():
        raise ValueError(f"aucpr needs labels in [0, 1], not {bad[0]!r}")
    s = df.groupBy(qid, F.col(score).cast("float").alias("score")).agg(F.sum(y).alias("tp"), F.sum(1.0 - y).alias("fp"))
    w = Window.partitionBy(qid).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    c = s.withColumns({"tps": F.sum("tp").over(w), "fps": F.sum("fp").over(w)})
    per = c.groupBy(qid).agg(F.sum(pr_step()).alias("area"), F.sum("tp").alias("p"), F.sum("fp").alias("n"))
    return per.where((F.col("p") > 0) & (F.col("n") > 0)).select(qid, (F.col("area") / F.col("p")).alias("aucpr"))


def lambda_arrays(score: np.ndarray, label: np.ndarray, kind: str, q: dict, seed: int | list[int] = 0) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of one group from its pairs (the top ones against all, or sampled partners)."""
    n = len(score)
    g, h = np.zeros(n), np.zeros(n)
    rank = np.argsort(-score, kind="stable")
    y, s = label[rank], score[rank].astype(np.float32)
    k = q.get("lambdarank_num_pair_per_sample")
    if q.get("lambdarank_pair_method", "topk") == "topk":
        top = min(k or 32, n)
        i, j = np.nonzero(np.arange(top)[:, None] < np.arange(n)[None, :])
    else:
        rng = np.random.default_rng(seed)
        i = np.repeat(np.arange(n), k or 1)
        j = rng.integers(0, n, len(i))
    use = y[i] != y[j]
    i, j = i[use], j[use]
    if not len(i):
        return g, h
    swap = y[i] < y[j]
    hi, lo = np.where(swap, j, i), np.where(swap, i, j)
    diff = (s[hi] - s[lo]).astype(float)
    sig = 1 / (1 + np.exp(-diff))
    if kind == "rank:ndcg":
        gain = 2.0**y - 1 if q.get("ndcg_exp_gain", True) else y.astype(float)
        disc = 1 / np.log2(np.arange(n) + 2)
        cut = min(k or 32, n) if q.get("lambdarank_pair_method", "topk") == "topk" else n
        ideal = float((np.sort(gain)[::-1][:cut] * disc[:cut]).sum())
        delta = np.abs((gain[hi] - gain[lo]) * (disc[hi] - disc[lo])) * (1 / ideal if ideal > 0 else 0.0)
    elif kind == "rank:map":
        rel = np.cumsum(y > 0)
        acc = np.cumsum((y > 0) / (np.arange(n) + 1.0))
        a, b = np.minimum(hi, lo), np.maximum(hi, lo)
        lower_first = y[a] < y[b]
        between = acc[np.maximum(b - 1, 0)] - acc[a]
        sign = np.where(lower_first, 1.0, -1.0)
        delta = np.abs(sign * between + np.where(lower_first, (rel[a] + 1) / (a + 1.0) - rel[b] / (b + 1.0), rel[a] / (a + 1.0) - rel[b] / (b + 1.0))) / max(rel[-1], 1)
    else:
        delta = np.ones(len(hi))
    if q.get("lambdarank_score_normalization", True) and s[0] != s[-1]:
        delta = delta / (np.abs(diff) + 0.01)
    lam = ((sig - 1) * delta).astype(np.float32).astype(float)
    hes = (np.maximum(sig * (1 - sig), 1e-16) * delta * 2).astype(np.float32).astype(float)
    for at, sign in ((hi, 1), (lo, -1)):
        g += np.bincount(rank[at], sign * lam, n)
        h += np.bincount(rank[at], hes, n)
    if q.get("lambdarank_normalization", True):
        total = -2 * lam.sum()
        if total > 0:
            norm = math.log2(1 + total) / total
            g, h = g * norm, h * norm
    return g, h


def lambda_gradients(df: DataFrame, qid: str, row: str, margin: str, label: str, kind: str, q: dict, seed: int = 0) -> DataFrame:
    """df with float columns g0, h0: one grouped task per query, whose pairs are bounded by the truncation."""
    schema = df.schema

    def run(pdf):
        pdf = pdf.sort_values(row, kind="stable")
        own = [abs(int(seed)), abs(int(pdf[qid].iloc[0]))]  # sampled pairs differ by round and by group
        g, h = lambda_arrays(pdf[margin].to_numpy(), pdf[label].to_numpy(), kind, q, own)
        return pdf.assign(g0=g.astype(np.float32), h0=h.astype(np.float32))

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", g0 float, h0 float"
    return df.groupBy(qid).applyInPandas(run, out)


def weighted_mean(per: DataFrame, value: str, df: DataFrame, qid: str, weight: str) -> float | None:
    """The mean of a group's values by the groups' weights (each row of a group has the
    group's).  ndcg of a group without relevant rows is added without its weight."""
    own = per.join(df.groupBy(qid).agg(F.max(weight).cast("double").alias("_gw")), qid)
    part = F.col(value) * F.col("_gw")
    if "relevant" in per.columns:
        part = F.when(F.col("relevant"), part).otherwise(F.col(value))
    r = own.agg(F.sum(part).alias("s"), F.sum("_gw").alias("w")).first()
    return None if r["s"] is None else min(r["s"] / r["w"] if r["w"] and r["w"] > 0 else r["s"], 1.0)


def check_labels(df: DataFrame, label: str, kind: str, exponential: bool = True) -> None:
    """ndcg needs whole grades from 0 to 31 with exponential gains, map and pre need 0 or 1."""
    y = F.col(label).cast("double")
    if kind == "ndcg":
        good = (y >= 0) & (F.abs(y - F.floor(y)) <= 1e-6) & (y < 32) if exponential else F.lit(True)
    else:
        good = (F.abs(y) < 1e-6) | (F.abs(y - 1) < 1e-6)
    if bad := df.where(~F.coalesce(good, F.lit(False))).select(label).first():
        raise ValueError(f"{kind} doesn't take label {bad[0]!r}")


def group_weights(df: DataFrame, qid: str, weight: str) -> DataFrame:
    """(qid, group_weight): one weight per group, scaled to a mean of 1; rows of a group must agree."""
    per = df.groupBy(qid).agg(F.min(weight).alias("w"), F.max(weight).alias("w1"))
    if bad := per.where("w <> w1").first():
        raise ValueError(f"weights differ inside query {bad[0]!r}")
    r = per.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("s")).first()
    return per.select(qid, (F.col("w") * (r["n"] / r["s"] if r["s"] else 0.0)).alias("group_weight"))


def parse_metric(name: str) -> tuple[str, int, float]:
    """'ndcg@5-' as (ndcg, 5, value of a group without relevant rows)."""
    empty = 0.0 if name.endswith("-") else 1.0
    base, _, k = name.rstrip("-").partition("@")
    return base, int(k) if k else 32, empty
