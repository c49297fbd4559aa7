"""Cut points, bin numbers and category codes."""

from __future__ import annotations

import json
import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import BUCKET_ROWS, BUCKETS, MOST_BUCKETS, bucketed

FLOAT_MAX = 3.4028234663852886e38
NUMERIC = ("float", "double", "int", "bigint", "smallint", "tinyint")


def as_feature(column: str, missing: float = math.nan) -> Column:
    """A float with null for missing: null, NaN and the sentinel."""
    v = F.col(column).cast("float")
    gone = F.isnan(v) if math.isnan(missing) else F.isnan(v) | (v == F.lit(missing).cast("float"))
    return F.when(v.isNotNull() & ~gone, v)


def guard(df: DataFrame, features: list[str], allow_infinite: bool = False) -> None:
    """Reject infinite values and the largest float, which is reserved."""
    if not features:
        return
    limit = F.lit(FLOAT_MAX).cast("float")
    bad = lambda c: F.abs(F.col(c)) == limit if allow_infinite else F.abs(F.col(c)) >= limit
    r = df.agg(*[F.max(bad(c).cast("int")).alias(f"x{i}") for i, c in enumerate(features)]).first()
    for i, c in enumerate(features):
        if r[f"x{i}"]:
            raise ValueError(f"feature {c!r} holds an infinite or reserved value")


def unpivot(df: DataFrame, features: list[str], weight: Column | None = None) -> DataFrame:
    """(feat, value, w): a row per present value; features by number."""
    cells = F.array(*[F.struct(F.lit(i).alias("feat"), F.col(f).cast("float").alias("value")) for i, f in enumerate(features)])
    own = df.select(F.explode(cells).alias("c"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"))
    return own.select("c.feat", "c.value", "w").where("value is not null and not isnan(value) and w > 0")


def value_weights(df: DataFrame, features: list[str], weight: Column | None = None) -> DataFrame:
    """Weight of each distinct value of each feature, combined on the map side."""
    return unpivot(df, features, weight).groupBy("feat", "value").agg(F.sum("w").alias("w"))


def midpoint(a: Column, b: Column) -> Column:
    m = (a + (b - a) / F.lit(2.0).cast("float")).cast("float")
    return F.when(m > a, m).otherwise(b)


#: Distinct values of a feature beyond which its windows are cut into ranges, and values of a range.
WHOLE, RANGE = 1_000_000, 500_000


def cuts(weights: DataFrame, max_bin: int = 255, whole: int = WHOLE, range_: int = RANGE) -> DataFrame:
    """(feat, idx, cut) from value_weights().

    Up to max_bin - 1 distinct values: midpoints of neighbours.  More: for each
    k the first value whose mid-rank reaches k / max_bin of the weight.  A
    feature of more than ``whole`` distinct values is cut into ranges at
    approximate quantiles; sums run inside a range and start from the totals of
    the ranges before it, so no task holds all values of a feature.
    """
    totals = weights.groupBy("feat").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("total"))
    top = totals.agg(F.max("n")).first()[0] or 0
    if top <= whole:
        ranged = weights.withColumn("part", F.lit(0))
    else:
        parts = min(4096, -(-top // range_))
        levels = [i / parts for i in range(1, parts)]
        at = weights.groupBy("feat").agg(F.percentile_approx(F.col("value"), levels, max(10_000, 16 * parts)).alias("at"))
        # a row per feature, of at most 4,096 numbers
        ranged = weights.join(F.broadcast(at), "feat").withColumn("part", F.size(F.filter("at", lambda c: c < F.col("value")))).drop("at")
    by = Window.partitionBy("feat", "part").orderBy("value")
    sums = ranged.groupBy("feat", "part").agg(F.sum("w").alias("w"), F.min("value").alias("first"))
    order = Window.partitionBy("feat").orderBy("part")  # at most 4,096 rows of a feature
    starts = sums.select("feat", "part", (F.sum("w").over(order) - F.col("w")).alias("before"), F.lead("first").over(order).alias("after"), F.lag("w").over(order).alias("_"))
    starts = starts.drop("_").join(totals, "feat")
    ranked = ranged.join(starts if top > whole else F.broadcast(starts), ["feat", "part"]).select(
        "feat", "part", "value", "w", "n", "total",
        F.coalesce(F.lead("value").over(by), "after").alias("next"),
        (F.sum("w").over(by) + F.col("before") - F.col("w") / 2).alias("mid"),
    )
    low = ranked.where((F.col("n") <= max_bin - 1) & F.col("next").isNotNull()).select("feat", midpoint(F.col("value"), F.col("next")).alias("cut"))
    # the bin edges that a value's mid-rank passes: the first value of each is a cut
    step = F.least(F.floor(F.col("mid") * max_bin / F.col("total")), F.lit(max_bin - 1))
    # a step is first passed by its least value; steps that none stops at belong to the next value's
    high = ranked.where(F.col("n") > max_bin - 1).withColumn("k", step).where("k > 0").groupBy("feat", "k").agg(F.min("value").alias("cut")).select("feat", "cut")
    every = low.unionByName(high).distinct()
    return every.select("feat", (F.row_number().over(Window.partitionBy("feat").orderBy("cut")) - 1).alias("idx"), "cut")


def approximate_cuts(df: DataFrame, features: list[str], max_bin: int = 255, accuracy: int = 10_000) -> list[list[float]]:
    """Cuts of mergeable quantile sketches: one pass and no shuffle of values."""
    levels = [k / max_bin for k in range(1, max_bin)]
    row = df.agg(*[F.percentile_approx(F.col(f).cast("float"), levels, accuracy).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [sorted(set(row[f"q{i}"] or [])) for i in range(len(features))]


def collect_cuts(table: DataFrame, n_features: int) -> list[list[float]]:
    """At most max_bin numbers per feature."""
    out: list[list[float]] = [[] for _ in range(n_features)]
    for r in table.orderBy("feat", "idx").collect():
        out[r["feat"]].append(r["cut"])
    return out


#: Cuts up to which a bin is found by generated comparisons, and names up to which a code is found in one map.
COMPARED, MAPPED = 400, 200
#: More categories than this are an error: codes and a bin for missing fit in 16 bits.
MOST_CATEGORIES = 65_534


def bin_of(value: Column, edges: list[float]) -> Column:
    """Number of cuts not over the value; null for missing.  A balanced tree of
    comparisons, so a row costs the logarithm of the number of bins; beyond
    ``COMPARED`` cuts the same by halving steps over one array literal."""
    if len(edges) > COMPARED:
        return search_bin(value, edges)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(edges[mid]).cast("float"), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(value.isNotNull(), tree(0, len(edges))).cast("short")


def _floats(values: list[float]) -> Column:
    """An array literal from one string, so that a plan of 65,535 numbers stays small."""
    return F.split(F.lit(",".join(str(np.float32(v)) for v in values)), ",").cast("array<float>")


def search_bin(value: Column, edges: list[float]) -> Column:
    """The same for any number of cuts, as an int."""
    if not edges:
        return F.when(value.isNotNull(), F.lit(0))
    top = 1 << (len(edges).bit_length() - 1)
    steps = F.array(*[F.lit(top >> i) for i in range(top.bit_length())])
    at = _floats(edges)

    def onward(low: Column, step: Column) -> Column:
        return F.when((low + step <= len(edges)) & (F.get(at, low + step - 1) <= value), low + step).otherwise(low)

    return F.when(value.isNotNull(), F.aggregate(steps, F.lit(0), onward))


def _first_seen(df: DataFrame, column: str, order: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.min(order).alias("first"))


def _numbered(first: DataFrame, n: int) -> DataFrame:
    """(name, code) of n names; more than MOST_CATEGORIES are numbered inside buckets that start from the counts of those before."""
    if n <= MOST_CATEGORIES:
        return first.select("name", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first", "name")) - 1).alias("code"))
    own = bucketed(first, "first", min(MOST_BUCKETS, max(BUCKETS, n // BUCKET_ROWS)))
    before = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most MOST_BUCKETS rows
    starts = own.groupBy("bucket").count().select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("first", "name"))
    return own.withColumn("at", inside).join(F.broadcast(starts), "bucket").select("name", (F.col("start") + F.col("at") - 1).cast("int").alias("code"))


def learn_categories(df: DataFrame, column: str, order: str) -> DataFrame:
    """(name, code): codes by first appearance in the order column; more than MOST_CATEGORIES raise."""
    first = _first_seen(df, column, order)
    if (n := first.count()) > MOST_CATEGORIES:
        raise ValueError(f"{column}: {n} categories, more than {MOST_CATEGORIES}")
    return _numbered(first, n)


def with_codes(df: DataFrame, column: str, order: str, out: str = "code") -> DataFrame:
    """df with the code of each name by first appearance, null for null.  For any number of names:
    the maps of lookup() up to MOST_CATEGORIES, which only training needs as a limit, a join beyond."""
    first = _first_seen(df, column, order)
    n = first.count()
    learned = _numbered(first, n)
    if n <= MOST_CATEGORIES:
        return df.withColumn(out, known_code([r["name"] for r in learned.orderBy("code").collect()], column))
    joined = df.join(learned.select(F.col("name").alias("_name"), F.col("code").alias("_code")), F.col(column) == F.col("_name"), "left")
    return joined.withColumn(out, F.col("_code")).drop("_name", "_code")


def lookup(names: list, column: Column) -> Column:
    """The place of a value in a list of names, null if it isn't there: one map of few
    names, else small maps by a checksum of the name, in a literal made from one string."""
    if not names:
        return F.lit(None).cast("int")
    if len(names) <= MAPPED or not all(isinstance(c, str) for c in names):
        return F.element_at(F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(i))]), column)
    maps: list[dict[str, int]] = [{} for _ in range(1 << (len(names) // 8).bit_length())]
    for i, c in enumerate(names):
        maps[zlib.crc32(c.encode()) % len(maps)][c] = i
    held = F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")
    return F.element_at(F.get(held, F.pmod(F.crc32(column), F.lit(len(maps))).cast("int")), column)


def known_code(names: list, feature: str) -> Column:
    """The code of a category, null for null; a name that training didn't see fails the job."""
    c = F.col(feature)
    failed = F.raise_error(F.concat(F.lit(f"{feature}: unseen category "), c.cast("string"))).cast("int")
    return F.when(c.isNotNull(), F.coalesce(lookup(names, c), failed))


def check_known(df: DataFrame, categories: dict[str, list]) -> None:
    """Raise for a name that training didn't see; one job for all features."""
    unseen = {f: F.max(F.when(F.col(f).isNotNull() & lookup(names, F.col(f)).isNull(), F.col(f))).alias(f) for f, names in categories.items()}
    if unseen:
        found = df.agg(*unseen.values()).first()
        for f in unseen:
            if found[f] is not None:
                raise ValueError(f"{f}: unseen category {found[f]!r}")


def recode(df: DataFrame, column: str, categories: list, out: str, unseen: str = "error") -> DataFrame:
    """Codes of names as a literal lookup; unseen names raise or become null."""
    if len(categories) > MOST_CATEGORIES:
        raise ValueError(f"{column}: more than 65,534 categories")
    if unseen == "error":
        check_known(df, {column: categories})
    return df.withColumn(out, lookup(categories, F.col(column)))


#: The number grammar of CSV fields: an integer, or a decimal with an exponent or not.
NUMBER = r"^-?(\d+|(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?)$"


def is_numeric_text(df: DataFrame, column: str) -> bool:
    """Whether each field that isn't empty is a number; one other makes the column text."""
    filled = F.col(column).isNotNull() & (F.col(column) != "")
    return bool(df.agg(F.coalesce(F.bool_and(F.when(filled, F.col(column).rlike(NUMBER))), F.lit(True))).first()[0])
