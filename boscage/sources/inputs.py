"""Inputs: path specifications, Parquet and CSV tables, roles of columns."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.binning import NUMERIC, is_numeric_text

PARQUET, CSV = (".parquet", ".pq"), (".csv", ".csv.gz")


def format_of(path: str) -> str:
    low = path.lower().rstrip("/")
    if low.endswith(PARQUET):
        return "parquet"
    if low.endswith(CSV):
        return "csv"
    raise ValueError(f"{path}: neither Parquet nor CSV")


def _listing(spark: SparkSession, folder: str) -> list[tuple[str, bool]]:
    """(path, whether a folder) of what a folder holds, in any store."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise ValueError(f"{folder} doesn't exist")
    return [(s.getPath().toString(), s.isDirectory()) for s in fs.listStatus(path)]


def resolve(spark: SparkSession, spec: str | os.PathLike | Sequence) -> tuple[list[str], str]:
    """Sorted paths without repeats, and their one format.

    A path, a folder (not its subfolders), a pattern with * and ? in the last
    part, or a list of these.
    """
    specs = [os.fspath(s) for s in (spec if isinstance(spec, list | tuple) else [spec])]
    found: set[str] = set()
    for s in specs:
        folder, _, last = s.rstrip("/").rpartition("/")
        if "**" in s or any(c in folder for c in "*?"):
            raise ValueError(f"{s}: patterns are for the last part only")
        if any(c in last for c in "*?"):
            hits = [p for p, _ in _listing(spark, folder or ".") if fnmatch.fnmatchcase(p.rsplit("/", 1)[-1], last.replace("[", "[[]"))]
            if not hits:
                raise ValueError(f"{s}: nothing matches")
            found.update(hits)
        elif last.lower().endswith(PARQUET + CSV):
            found.add(s)
        else:
            found.update(p for p, folder_ in _listing(spark, s) if not folder_ and p.lower().endswith(PARQUET + CSV))
    formats = {format_of(p) for p in found}
    if len(formats) != 1:
        raise ValueError("inputs must be of one format" if formats else "no input files")
    return sorted(found), formats.pop()


def read(spark: SparkSession, spec: Any, header: bool = True, text_columns: Sequence[str] = ()) -> DataFrame:
    """A table of one or more files whose schemas agree; a DataFrame is passed through."""
    if isinstance(spec, DataFrame):
        return spec
    if not isinstance(spec, str | os.PathLike | list | tuple):
        return spark.createDataFrame(_plain(spec))
    paths, kind = resolve(spark, spec)
    if kind == "parquet":
        first = spark.read.parquet(paths[0]).schema
        for p in paths[1:]:
            if [(f.name, f.dataType) for f in spark.read.parquet(p).schema] != [(f.name, f.dataType) for f in first]:
                raise ValueError(f"{p}: another schema than {paths[0]}")
        return spark.read.schema(first).parquet(*paths)
    raw = spark.read.csv(paths, header=header, inferSchema=False, nullValue="", emptyValue="")
    return typed_csv(raw, text_columns)


def _plain(data: Any) -> Any:
    """pandas categories and Arrow dictionaries as their values; other data as they are."""
    import pandas as pd
    import pyarrow as pa

    if isinstance(data, pa.RecordBatchReader):
        data = data.read_all()
    if isinstance(data, pa.RecordBatch):
        data = pa.Table.from_batches([data])
    if isinstance(data, pa.Table):
        for i, f in enumerate(data.schema):
            if pa.types.is_dictionary(f.type):
                data = data.set_column(i, f.name, data.column(i).cast(f.type.value_type))
    elif isinstance(data, pd.DataFrame):
        data = data.assign(**{c: data[c].astype(object).where(data[c].notna(), None) for c in data.columns if isinstance(data[c].dtype, pd.CategoricalDtype)})
    return data


def typed_csv(raw: DataFrame, text_columns: Sequence[str] = ()) -> DataFrame:
    """Columns as double; text stays only where it was declared, and one field that isn't a number makes it so."""
    out = []
    for c in raw.columns:
        numeric = is_numeric_text(raw, c)
        if not numeric and c not in text_columns:
            raise ValueError(f"{c}: not numeric and not declared as a category")
        out.append(F.col(c).cast("double").alias(c) if numeric else F.col(c))
    return raw.select(*out)


@dataclass
class Roles:
    """Columns that aren't features."""

    label: str | None = None
    weight: str | None = None
    qid: str | None = None
    upper: str | None = None
    base_margin: list[str] = field(default_factory=list)
    row_id: str | None = None

    def excluded(self) -> set[str]:
        return {c for c in (self.label, self.weight, self.qid, self.upper, self.row_id, *self.base_margin) if c}


def features_of(df: DataFrame, roles: Roles, categorical: Sequence[str] = ()) -> list[str]:
    """All other columns, in order; each must be numeric or a declared category."""
    missing = roles.excluded() - set(df.columns)
    if missing:
        raise ValueError(f"no column {sorted(missing)[0]!r}")
    out = [c for c in df.columns if c not in roles.excluded()]
    kinds = dict(df.dtypes)
    for c in out:
        if kinds[c] not in NUMERIC and not (c in categorical and kinds[c] == "string"):
            raise ValueError(f"{c}: only numeric columns are supported, not {kinds[c]}")
    return out


def check_same_features(df: DataFrame, features: Sequence[str], roles: Roles) -> None:
    """An evaluation table has exactly the training features."""
    own = {c for c in df.columns if c not in roles.excluded()}
    if own != set(features):
        raise ValueError(f"features differ: {sorted(own ^ set(features))[:5]}")


def check_codes(df: DataFrame, feature: str, missing: float = float("nan")) -> None:
    """Category codes are whole numbers from 0 to 65,533; null, NaN and the sentinel are missing."""
    from ..operators.binning import MOST_CATEGORIES, as_feature

    v = as_feature(feature, missing).cast("double")
    if bad := df.where((v < 0) | (v != F.floor(v)) | (v >= MOST_CATEGORIES)).select(feature).first():
        raise ValueError(f"{feature}: {bad[0]!r} is no category code")


def check_weight(df: DataFrame, weight: str) -> None:
    w = F.col(weight).cast("double")
    if df.where(w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf"))).limit(1).count():
        raise ValueError(f"{weight}: weights must be finite and not negative")
