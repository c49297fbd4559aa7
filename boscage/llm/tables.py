"""Reading the text tables by Spark, and putting rewritten texts back into a table."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: 64-bit words of a map of hashes at most: some megabytes to broadcast, whatever the input.
WORDS = 1 << 17


def parted(rows: DataFrame, name: str, found: DataFrame, other: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose hash ``name`` is in the column ``other`` of found, a written table, and
    a few more; and the rest.

    A bit map of the hashes is broadcast, so rows of the rest never move.  With more
    hashes than it has bits most rows are in the first part, and nothing is lost.
    """
    words = min(WORDS, 1 << (found.count() // 4).bit_length())
    word = lambda h: f"pmod(shiftrightunsigned({h}, 6), {words}L)"
    bits = found.select(F.expr(word(other)).alias("__word"), F.expr(f"shiftleft(1L, cast({other} & 63L as int))").alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    held = F.expr(f"{word(name)} = __word and bit_get(__bits, cast({name} & 63L as int)) = 1")
    return rows.join(F.broadcast(bits), held, "left_semi"), rows.join(F.broadcast(bits), held, "left_anti")


def rewritten(docs: DataFrame, found: DataFrame, what: str, cut: Callable[[pa.Array, pa.Array], pa.Array], text: str, key: str) -> DataFrame:
    """docs, of which those with a row of found (doc_id, rk, what; a written table) get the
    text that cut makes of their own and of what, and go if that leaves them blank.

    A row is named by its id and by a hash of id and text, so a hash that two
    documents share by chance mixes nothing up.  Only rows that may have one move, once;
    cut returns the texts for which what is null as they are.
    """
    own = docs.withColumn("__cut_id", F.col(key).cast("long")).withColumn("__cut_rk", F.xxhash64(F.col(key).cast("long"), F.col(text)))
    some, rest = parted(own, "__cut_rk", found, "rk")
    other = found.select(F.col("doc_id").alias("__of_id"), F.col("rk").alias("__of_rk"), F.col(what).alias("__cut_what"))
    both = some.join(other, F.col("__cut_id").eqNullSafe(F.col("__of_id")) & (F.col("__cut_rk") == F.col("__of_rk")), "left")
    # not deterministic: else it would be evaluated for the filter and again for the result
    new = F.arrow_udf(cut, "string").asNondeterministic()
    both = both.withColumn(text, new(F.col(text), F.col("__cut_what")))
    both = both.where(F.col("__cut_what").isNull() | F.col(text).rlike(r"[^\x20\x09-\x0D]"))
    return rest.select(*docs.columns).unionByName(both.select(*docs.columns))
