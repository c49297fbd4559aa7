"""Running sums over a whole table without a single-task window.

The order column is cut at approximate quantiles; sums run inside each bucket
and start from the totals of the buckets before it, a table of at most
4,096 rows.  Equal values share a bucket, so a range frame sees all peers.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least buckets, most of them, and rows of one beyond the least.
BUCKETS, MOST_BUCKETS, BUCKET_ROWS = 64, 4096, 2_000_000


def bucketed(df: DataFrame, order: str, buckets: int | None = None) -> DataFrame:
    """df with column bucket, ascending with order; more buckets for more rows."""
    if buckets is None:
        n = df.count()
        buckets = min(MOST_BUCKETS, max(BUCKETS, n // BUCKET_ROWS))
    accuracy = max(10_000, 16 * buckets)
    cuts = df.select(F.percentile_approx(F.col(order).cast("double"), [i / buckets for i in range(1, buckets)], accuracy)).first()[0] or []
    cuts = sorted(set(cuts))
    if not cuts:
        return df.withColumn("bucket", F.lit(0))
    at = F.split(F.lit(",".join(repr(float(c)) for c in cuts)), ",").cast("array<double>")
    return df.withColumn("bucket", F.size(F.filter(at, lambda c: c < F.col(order).cast("double"))))


def running(df: DataFrame, order: str, sums: dict[str, Column], descending: bool = False, buckets: int | None = None) -> DataFrame:
    """df with each named sum over all rows up to and with the peers of this one."""
    own = bucketed(df.withColumns({f"v_{k}": v for k, v in sums.items()}), order, buckets)
    totals = own.groupBy("bucket").agg(*[F.sum(f"v_{k}").alias(f"t_{k}") for k in sums])
    bucket = F.col("bucket").desc() if descending else F.col("bucket")
    before = Window.partitionBy(F.lit(0)).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows
    starts = totals.select("bucket", *[F.coalesce(F.sum(f"t_{k}").over(before), F.lit(0)).alias(f"s_{k}") for k in sums])
    inside = Window.partitionBy("bucket").orderBy(F.col(order).desc() if descending else F.col(order)).rangeBetween(Window.unboundedPreceding, 0)
    out = own.withColumns({f"i_{k}": F.sum(f"v_{k}").over(inside) for k in sums}).join(F.broadcast(starts), "bucket")
    out = out.withColumns({k: F.col(f"i_{k}") + F.col(f"s_{k}") for k in sums})
    return out.drop("bucket", *functools.reduce(lambda a, k: [*a, f"v_{k}", f"i_{k}", f"s_{k}"], sums, []))
