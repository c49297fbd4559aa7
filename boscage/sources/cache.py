"""Binned tables that stay beyond a run, in a folder that the user names.

A table is named by a hash of all that it depends on: the input files with
their lengths and times, the plan over them, features, cuts, categories and
roles.  It is written beside and moved, so readers see whole tables only, and
of two writers the first wins.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Any

from pyspark.sql import DataFrame

from . import shared


def _fs(df: DataFrame, path: str) -> tuple[Any, Any]:
    context = df.sparkSession.sparkContext
    own = context._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(context._jsc.hadoopConfiguration())


def name_of(df: DataFrame, what: dict[str, Any]) -> str:
    """A name for a table made of df and of what is done to it."""
    files = []
    for f in sorted(df.inputFiles()):
        path, fs = _fs(df, f)
        status = fs.getFileStatus(path)
        files.append([f, status.getLen(), status.getModificationTime()])
    if not files:
        raise ValueError("cache_path needs tables that are read from files")
    return hashlib.sha256(json.dumps([files, df.semanticHash(), what], sort_keys=True, default=str).encode()).hexdigest()


def held(binned: DataFrame, folder: str, name: str) -> DataFrame:
    """The table of that name in the folder, written first if there is none."""
    final = f"{folder.rstrip('/')}/{name}"
    path, fs = _fs(binned, final)
    if not fs.exists(path):
        staging = f"{folder.rstrip('/')}/.staging-{uuid.uuid4().hex}"
        binned.write.parquet(staging)
        if fs.exists(path) or not fs.rename(_fs(binned, staging)[0], path):
            shared.delete(binned.sparkSession, staging)
    return binned.sparkSession.read.schema(binned.schema).parquet(final)
