"""Row and column sampling that depends on keys only, never on partitioning."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_kept(row: Column, rate: float, seed: int, tree: int) -> Column:
    """An independent draw for each row from a hash of (seed, tree, row)."""
    if rate >= 1:
        return F.lit(True)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(tree), row), 11)
    return u < F.lit(int(rate * 2**53))


def importance(g: Column, h: Column) -> Column:
    return F.sqrt(g * g + 0.1 * h * h)


def threshold(df: DataFrame, score: str, rate: float, steps: int = 3) -> float:
    """tau with sum of min(1, score / tau) = rate * n.

    Scores under tau count in proportion and the others whole.  Sums over
    exponent buckets find the bucket that holds tau; the next aggregates cut
    that bucket into even parts, until no score lies between the two borders.
    The driver sees a row per bucket or part.
    """
    s = F.col(score)
    n, positive = df.agg(F.count(F.lit(1)), F.sum((s > 0).cast("long"))).first()
    target = rate * n
    if (positive or 0) <= target:
        return 0.0
    bucket = F.floor(F.log2(s) * 16).cast("int")
    found = df.where(s > 0).groupBy(bucket.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(s).alias("s"), F.min(s).alias("lo"), F.max(s).alias("hi")).orderBy("k").collect()
    above, below = positive, 0.0
    for step in range(steps):
        for r in found:  # tau is over a bucket if that bucket's scores, taken in proportion too, leave it there
            rest = target - (above - r["n"])
            if rest > 0 and (below + r["s"]) / rest <= r["hi"]:
                break
            above -= r["n"]
            below += r["s"]
        else:
            break
        low, high = r["lo"], r["hi"]
        if step + 1 == steps or low == high:
            break
        part = F.least(F.floor((s - low) * (4096 / (high - low))), F.lit(4095)).cast("int")
        found = df.where((s >= low) & (s <= high)).groupBy(part.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(s).alias("s"), F.min(s).alias("lo"), F.max(s).alias("hi")).orderBy("k").collect()
    return below / (target - above) if target > above else found[-1]["hi"]


def gradient_based(df: DataFrame, g: str, h: str, row: str, rate: float, seed: int, tree: int) -> DataFrame:
    """Rows drawn with probability min(1, score / tau), and g, h over it."""
    scored = df.withColumn("_score", importance(F.col(g), F.col(h)))
    tau = threshold(scored, "_score", rate)
    p = F.least(F.lit(1.0), F.col("_score") / tau) if tau > 0 else F.lit(1.0)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(tree), F.col(row)), 11) / 2.0**53
    return scored.withColumn("_p", p).where((F.col("_score") > 0) & (u < F.col("_p"))).withColumns({g: F.col(g) / F.col("_p"), h: F.col(h) / F.col("_p")}).drop("_score", "_p")


def gradient_based_outputs(df: DataFrame, outputs: int, row: str, rate: float, seed: int, round_: int) -> DataFrame:
    """gradient_based() for each output's own tree: g_i and h_i over the probability, or 0 where the output's draw misses the row."""
    score = {f"_score{i}": importance(F.col(f"g{i}").cast("double"), F.col(f"h{i}").cast("double")) for i in range(outputs)}
    scored, out = df.withColumns(score), {}
    for i, s in enumerate(score):
        tau = threshold(scored, s, rate)
        p = F.least(F.lit(1.0), F.col(s) / tau) if tau > 0 else F.lit(1.0)
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(round_ * outputs + i), F.col(row)), 11) / 2.0**53
        for x in (f"g{i}", f"h{i}"):
            out[x] = F.when((F.col(s) > 0) & (u < p), F.col(x).cast("double") / p).otherwise(F.lit(0.0))
    return scored.withColumns(out).drop(*score)


def _unit(*key) -> float:
    return (int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "big") + 1) / (2**64 + 2)


def columns(base: list[int], rate: float, weights: list[float] | None, *key) -> list[int]:
    """max(1, floor(rate n)) features with the smallest exponential clocks."""
    if rate >= 1:
        return base
    take = max(1, math.floor(rate * len(base)))
    w = weights or []
    clock = {f: (-math.log(_unit(*key, f)) / (w[f] if w else 1.0)) if not w or w[f] > 0 else math.inf for f in base}
    return sorted(sorted(base, key=lambda f: (clock[f], f))[:take])
