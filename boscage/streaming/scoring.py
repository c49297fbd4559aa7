"""Scoring of streams: the model is stateless, so batch expressions apply as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scoring
from ..plans.model import Model


def score_stream(stream: DataFrame, model: Model, **options) -> DataFrame:
    """Predictions of a streaming table, row by row, without state."""
    if not stream.isStreaming:
        raise ValueError("not a streaming DataFrame")
    return scoring.predict(stream, model, **options)


def drift(stream: DataFrame, model: Model, time: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean and spread of the predictions per window; rows later than the watermark are dropped."""
    scored = scoring.predict(stream.withWatermark(time, late), model)
    return scored.groupBy(F.window(time, every)).agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean"), F.stddev_pop("prediction").alias("spread"))


def write_scored(stream: DataFrame, model: Model, path: str, checkpoint: str, **options):
    """Append scored rows as Parquet, exactly once per checkpoint folder."""
    return score_stream(stream, model, **options).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
