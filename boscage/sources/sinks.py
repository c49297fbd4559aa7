"""Outputs: predictions as Parquet."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring
from ..plans.model import Model
from . import inputs


def predict_to_parquet(df: DataFrame, model: Model, path: str, ordered_by: str | None = None, **options) -> None:
    """Write predictions; an existing path is refused, and a failed job leaves no file.

    Several outputs become columns prediction_0, prediction_1, ...  With
    ordered_by the files are in that order by ranges, without a single task.
    """
    out = scoring.predict(df, model, **options)
    keep = [ordered_by] if ordered_by else []
    if dict(out.dtypes)["prediction"].startswith("array"):
        out = out.select(*keep, *[F.get("prediction", F.lit(k)).alias(f"prediction_{k}") for k in range(model.outputs)])
    else:
        out = out.select(*keep, "prediction")
    if ordered_by:
        out = out.orderBy(ordered_by).drop(ordered_by)
    out.write.mode("errorifexists").option("compression", "snappy").parquet(path)


def predict_files(spark: SparkSession, spec: Any, model: Model, path: str, header: bool = True, ordered_by: str | None = None, **options) -> None:
    """Predictions of files (a path, folder, pattern or list), written as predict_to_parquet() does."""
    text = [f for f in model.categories]
    predict_to_parquet(inputs.read(spark, spec, header, text), model, path, ordered_by, **options)
