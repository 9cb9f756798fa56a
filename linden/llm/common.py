"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from linden.session import ensure_checkpoint_dir, write_once


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """From now on Arrow batches between Spark and Python hold at most about
    ``size`` bytes, however long the texts of a batch's rows are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` written once as Parquet under the shared folder (in ``folder``, if
    given) and read back: later branches scan it, and a lost executor costs no
    recomputation."""
    path = fresh_path(df.sparkSession, name) if folder is None else f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
    write_once(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of ``written`` tables that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tokenizer_path(name: str) -> str:
    """Default place of a public vocabulary file (never copied here)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def file_system(uri: str):
    """(pyarrow file system, path) of a folder given as URI or plain path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), os.path.abspath(uri)


def chunks(column, limit: int = 1 << 21) -> Iterator[tuple[int, int, list[str]]]:
    """(begin, end, texts) of stretches of an Arrow text column that hold
    about ``limit`` bytes each, so that scratch arrays stay bounded whatever
    the batch holds.  Nulls are empty texts."""
    import pyarrow.compute as pc

    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(upto):
        end = int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + limit)) + 1
        end = min(end, len(upto))
        yield begin, end, [t or "" for t in column.slice(begin, end - begin).to_pylist()]
        begin = end
