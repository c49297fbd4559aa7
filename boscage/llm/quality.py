"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Base statistics come from each whole text.  They are transformed to a vector,
and for each language and source a minimum-covariance-determinant estimate of
centre and scatter is made by concentration steps from two fixed starts.  A
document whose Mahalanobis distance is beyond the cut is rejected.

Sums are of fixed-point integers and ranks come from counts of fixed bins, so
each step is a map-side combined aggregate over all rows, a group that holds a
third of them is no hot task, and the results don't depend on partitioning.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Scratch
from .tables import table

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
DIMENSIONS = ("x_words", "x_length", "x_symbols", "x_lines", "x_repeats")
#: Least standard deviation of each dimension: what differs by less is no sign of bad text.
#: Those of lines and repeats are small against their ranges (1 and sqrt(0.2)), so that either can be beyond the cut alone.
FLOORS = (0.5, 0.12, 0.35, 0.1, 0.05)
FIXED = 1 << 12
BINS_PER_OCTAVE = 16
#: Groups up to which a table with a row or two per group (some hundred bytes each) is broadcast; beyond it both sides are salted.
FEW, SALT = 10_000, 32


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside windows of five words that occur twice or more in the text."""

    def at(array: Column, i: Column) -> Column:
        return F.get(array, i)

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda v, j: F.coalesce(F.least(at(p, j + 1) - v, F.lit(5)), F.lit(5)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    def positions(s: Column) -> Column:
        twice = F.filter(s, lambda e, j: F.coalesce(at(s, j - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(at(s, j + 1)["h"] == e["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda e: e["i"]))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[at(w, i + k) for k in range(5)]))

    def of(h: Column) -> Column:
        marked = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i")))
        some = _let(F.sort_array(marked), lambda s: _let(positions(s), covered))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(some)

    return F.when(F.size(words) < 6, F.lit(0).cast("long")).otherwise(_let(words, lambda w: _let(windows(w), of)))


def row_key(text: str, key: str) -> Column:
    """A hash of all that a verdict depends on and the id; rows with equal ones have one verdict."""
    return F.xxhash64(F.col(key).cast("long"), F.col("lang"), F.col("source"), F.col(text))


def statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, rk, lang, source and the base statistics of each whole text (null: none)."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, SPACES), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    own = docs.select(F.col(key).cast("long").alias("doc_id"), row_key(text, key).alias("rk"), F.col("lang"), F.col("source"), words.alias("w"), lines.alias("l"), (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    return own.select(
        "doc_id", "rk", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("w")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics, in fixed point."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    raw = (
        F.log(n),
        F.log(chars / n),
        F.log1p(100.0 * F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / lines),
        F.sqrt(F.col("n_repeat_words") / n),
    )
    return [F.round(x * FIXED).cast("long").alias(c) for x, c in zip(raw, DIMENSIONS, strict=True)]


def _whitened(scatter: list[Column], d: int) -> Column:
    """The lower triangle of a scatter, then its Cholesky factor, then that factor's
    inverse, each row by row, in one array; each value is made once from earlier ones."""
    order = [(i, j) for i in range(d) for j in range(i + 1)]
    size = len(order)
    numbers = lambda v: F.array(*[F.lit(x) for x in v])
    at_i, at_j, row = numbers([i for i, _ in order]), numbers([j for _, j in order]), numbers([i * (i + 1) // 2 for i in range(d)])
    least = numbers([f * f * 1e-3 for f in FLOORS])
    first = F.sequence(F.lit(0), F.lit(d))

    def place(i: Column, j: Column, block: int) -> Column:
        return F.get(row, i) + j + block * size

    def dot(a: Column, ks: Column, term) -> Column:
        return F.aggregate(ks, F.lit(0.0), lambda s, k: s + term(a, k))

    def factor(a: Column, n: Column) -> Column:
        i, j = F.get(at_i, n), F.get(at_j, n)
        rest = F.get(a, n) - dot(a, F.slice(first, F.lit(1), j), lambda a, k: F.get(a, place(i, k, 1)) * F.get(a, place(j, k, 1)))
        return F.when(i == j, F.sqrt(F.greatest(rest, F.get(least, i)))).otherwise(rest / F.get(a, place(j, j, 1)))

    def inverse(a: Column, n: Column) -> Column:
        i, j = F.get(at_i, n), F.get(at_j, n)
        rest = F.when(i == j, F.lit(1.0)).otherwise(-dot(a, F.slice(first, j + 1, i - j), lambda a, k: F.get(a, place(i, k, 1)) * F.get(a, place(k, j, 2))))
        return rest / F.get(a, place(i, i, 1))

    out = F.array(*scatter)
    for step in (factor, inverse):
        out = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), out, _appended(step))
    return out


def _appended(step):
    return lambda a, n: F.concat(a, F.array(step(a, n)))


def _estimate(rows: DataFrame, inflate: float) -> DataFrame:
    """group, n_half, mean (array), white (inverse factor, row by row), log_det.

    From exact integer sums over distinct vectors with their counts n.
    Variances get the floors as a ridge, so a dimension that is constant in
    the half doesn't make the determinant vanish.
    """
    d = len(DIMENSIONS)
    order = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(F.col("n") * F.col(c)).cast("double").alias(f"s{i}") for i, c in enumerate(DIMENSIONS)]
    products = [F.sum((F.col("n") * F.col(DIMENSIONS[i])).cast("decimal(19,0)") * F.col(DIMENSIONS[j]).cast("decimal(9,0)")).cast("double").alias(f"p{i}{j}") for i, j in order]
    agg = rows.groupBy("group").agg(F.sum("n").alias("n_half"), *sums, *products)
    n = F.col("n_half").cast("double")
    mean = [F.col(f"s{i}") / n / FIXED for i in range(d)]
    scatter = [inflate * (F.col(f"p{i}{j}") / n / FIXED**2 - mean[i] * mean[j]) + (FLOORS[i] ** 2 if i == j else 0.0) for i, j in order]
    low, inv = len(order), 2 * len(order)
    diagonal = [low + order.index((i, i)) for i in range(d)]
    out = agg.select("group", "n_half", F.array(*mean).alias("mean"), _whitened(scatter, d).alias("a"))
    det = functools.reduce(lambda s, k: s + 2 * F.log(F.get("a", F.lit(k))), diagonal, F.lit(0.0))
    return out.select("group", "n_half", "mean", F.slice("a", inv + 1, len(order)).alias("white"), det.alias("log_det"))


def _distance() -> Column:
    """Squared Mahalanobis distance from mean and white."""
    total, k = F.lit(0.0), 0
    for i in range(len(DIMENSIONS)):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.get("white", F.lit(k)) * (F.col(DIMENSIONS[j]) / FIXED - F.get("mean", F.lit(j)))
            k += 1
        total = total + F.pow(z, F.lit(2.0))
    return total


def _beside(rows: DataFrame, per_group: DataFrame, few: bool, key: str = "group", how: str = "inner") -> DataFrame:
    """rows joined with a table that has a row or two per group, without moving a hot group to one task."""
    other = per_group.withColumnRenamed(key, "__of")
    if few:
        return rows.join(F.broadcast(other), F.col(key) == F.col("__of"), how).drop("__of")
    own = rows.withColumn("__salt", F.pmod(F.xxhash64(*DIMENSIONS), F.lit(SALT)))
    other = other.withColumn("__with", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return own.join(other, (F.col(key) == F.col("__of")) & (F.col("__salt") == F.col("__with")), how).drop("__of", "__salt", "__with")


def _half(rows: DataFrame, share: float, few: bool) -> DataFrame:
    """The rows of each group up to the bin of d2 in which its share is reached."""
    binned = rows.withColumn("bin", F.floor(F.log2(F.col("d2") + 2.0**-20) * BINS_PER_OCTAVE).cast("int"))
    counts = binned.groupBy("group", "bin").agg(F.sum("n").alias("k"))
    order = Window.partitionBy("group").orderBy("bin")
    # a group has at most some hundred bins, however many rows it has
    upto = counts.select("group", "bin", F.sum("k").over(order).alias("upto"), F.sum("k").over(Window.partitionBy("group")).alias("all"))
    cut = upto.where(F.col("upto") >= share * F.col("all")).groupBy("group").agg(F.min("bin").alias("cut_bin"))
    return _beside(binned, cut, few).where(F.col("bin") <= F.col("cut_bin")).drop("bin", "cut_bin", "d2")


def _from_medians(rows: DataFrame, few: bool) -> DataFrame:
    """d2 as the squared distance from the coordinatewise medians in units of the floors."""
    # percentile() keeps counts of distinct values, and these are in coarse fixed point: a bounded number
    coarse = [(F.round(F.col(c) * (16.0 / FIXED)) * (FIXED / 16.0)).alias(c) for c in DIMENSIONS]
    med = rows.select("group", "n", *coarse).groupBy("group").agg(*[F.percentile(c, 0.5, F.col("n")).alias(f"med{i}") for i, c in enumerate(DIMENSIONS)])
    d2 = functools.reduce(lambda a, b: a + b, [F.pow((F.col(c) - F.col(f"med{i}")) / (FIXED * FLOORS[i]), F.lit(2.0)) for i, c in enumerate(DIMENSIONS)])
    return _beside(rows, med, few).select(*rows.columns, d2.alias("d2"))


def mcd(rows: DataFrame, scratch: Scratch, steps: int = 3, share: float = 0.75) -> DataFrame:
    """A minimum-covariance-determinant estimate of each group.

    rows: group, the dimensions in fixed point and n.  Two starts, all rows
    and the share next to the medians, each followed by ``steps``
    concentration steps; the smaller determinant wins.  Both starts run side
    by side as groups of their own.  The result is written, a row per group.
    """
    few = rows.groupBy("group").count().count() <= FEW
    inflate = 1.0 / _consistency(share, len(DIMENSIONS))
    wide = _estimate(rows, 1.0)
    near = _estimate(_half(_from_medians(rows, few), share, few), inflate)
    estimate = wide.withColumn("start", F.lit(0)).unionByName(near.withColumn("start", F.lit(1)))
    for step in range(steps):
        estimate = scratch.save(estimate, f"step{step}")
        joined = _beside(rows, estimate.select("group", "start", "mean", "white"), few)
        near = joined.select(F.concat_ws("/", F.col("start").cast("string"), "group").alias("group"), *DIMENSIONS, "n", _distance().alias("d2"))
        estimate = _estimate(_half(near, share, few), inflate)
        estimate = estimate.withColumn("start", F.substring("group", 1, 1).cast("int")).withColumn("group", F.expr("substring(group, 3)"))
    best = estimate.groupBy("group").agg(F.min_by(F.struct("n_half", "mean", "white"), F.struct("log_det", "start")).alias("e"))
    return scratch.save(best.select("group", "e.*"), "best")


def _consistency(share: float, d: int) -> float:
    """Share of the variance of a normal vector that its inner share keeps."""
    q = _chi2_quantile(share, d)
    return _chi2_cdf(q, d + 2) / share


def _chi2_cdf(x: float, d: int) -> float:
    a, x = d / 2, x / 2
    term = total = 1 / a
    for k in range(1, 500):
        term *= x / (a + k)
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0


def _chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, d) < p else (low, mid)
    return high


def _groups() -> list[Column]:
    """Keys from the finest group to the one of all rows; nulls are values of their own."""
    return [F.to_json(F.struct("lang", "source")), F.to_json(F.struct("lang")), F.lit("")]


def quality_rules(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 50, tail: float = 1e-5) -> DataFrame:
    """One row per input row: doc_id, rk, lang, source, the statistics, base_failed,
    used_level (0: language and source, 1: language, 2: all), distance2, kept.

    Rows that fail the base rules don't enter the estimates.  A group of fewer
    than ``least`` rows uses its language's estimate, and one of fewer than
    that the estimate of all.  ``tail`` is the share of a normal population
    beyond the cut.  Null languages and sources are groups of their own; null
    and empty texts have no words and fail.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.save(statistics(docs, text, key).withColumn("base_failed", base_failed()), "statistics")
    fine, coarse, whole = _groups()
    vectors = stats.select("*", *vector(), fine.alias("group0"), coarse.alias("group1"))
    passed = vectors.where(~F.col("base_failed")).groupBy("group0", "group1", *DIMENSIONS).agg(F.count(F.lit(1)).alias("n"))
    passed = scratch.save(passed, "passed")
    rows = scratch.save(passed.select(F.explode(F.array("group0", "group1", whole)).alias("group"), *DIMENSIONS, "n").groupBy("group", *DIMENSIONS).agg(F.sum("n").alias("n")), "vectors")
    big = rows.groupBy("group").agg(F.sum("n").alias("size")).where(F.col("size") >= least)
    estimates = mcd(rows, scratch).select("group", F.struct("mean", "white").alias("e"))
    best = scratch.save(estimates.join(big, "group", "left_semi"), "big")
    total = estimates.where(F.col("group") == whole).first()
    # a row per language and source: the finest level that has rows enough
    own = passed.select("group0", "group1").distinct()
    for i in (0, 1):
        own = own.join(best.select(F.col("group").alias(f"group{i}"), F.col("e").alias(f"e{i}")), f"group{i}", "left")
    last = F.struct(*[F.array(*[F.lit(float(x)) for x in total["e"][c]]).alias(c) for c in ("mean", "white")]) if total else F.lit(None).cast(best.schema["e"].dataType)
    level = F.when(F.col("e0").isNotNull(), 0).when(F.col("e1").isNotNull(), 1).otherwise(2)
    used = scratch.save(own.select("group0", level.alias("used_level"), F.coalesce("e0", "e1", last).alias("e")), "used")
    out = _beside(vectors, used, used.count() <= FEW, "group0", "left").select(*stats.columns, *DIMENSIONS, "used_level", "e.mean", "e.white")
    d2 = F.coalesce(_distance(), F.lit(0.0))
    out = out.select(*stats.columns, F.when(~F.col("base_failed"), F.col("used_level")).alias("used_level"), F.when(~F.col("base_failed"), d2).alias("distance2"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= _chi2_quantile(1 - tail, len(DIMENSIONS)), F.lit(True)))


def keep_good(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the rows that quality_rules() rejects, all columns as they were."""
    good = quality_rules(docs, text, key).where("kept").select(F.col("doc_id").alias("__of_id"), F.col("rk").alias("__of_rk"))
    own = docs.withColumn("__quality_rk", row_key(text, key)).withColumn("__quality_id", F.col(key).cast("long"))
    same = F.col("__quality_id").eqNullSafe(F.col("__of_id")) & (F.col("__quality_rk") == F.col("__of_rk"))
    return own.join(good, same, "left_semi").select(*docs.columns)


def op8_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
