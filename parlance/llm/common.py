"""Helpers that the training-data operators share: shared-folder tables and Arrow batch slicing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


T = TypeVar("T")


_TABLES: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session (one machine) gets a temporary folder; any other is an error, as executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(spark, "_parlance_shared", None)
        if not found:
            found = f"file://{tempfile.mkdtemp(prefix='parlance-')}"
            spark._parlance_shared = found
    return found.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.

    The table stays until dropped() or clean(): a result that is still to be computed may read it.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    _TABLES.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._parlance_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by stored() that nothing reads any more."""
    _deleted(df.sparkSession, df._parlance_path)


def clean(spark: SparkSession) -> None:
    """Delete all tables that stored() has left; for when the results of the operators have been written."""
    for path in list(_TABLES):
        _deleted(spark, path)


def _deleted(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if name in _TABLES:
        _TABLES.remove(name)


_HELD: dict = {}


def worker_state(key: tuple, make: Callable[[], T]) -> T:
    """What a Python worker keeps between tasks: one object, so that operators that follow one another share no memory.

    key: compared by equality; an object in it is kept alive with it.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `limit` bytes of `column` (one longer row stays alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.maximum(np.cumsum(sizes) - sizes, 0) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def numbered_columns(df: DataFrame, *wanted: str) -> tuple:
    """df with its columns named c0, c1, ..., so that no name of theirs meets one of ours, and the new names of those wanted."""
    return (df.toDF(*(f"c{k}" for k in range(len(df.columns)))), *(f"c{df.columns.index(w)}" for w in wanted))


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
