"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share (``spark.checkpoint.dir``).

    Set to a temporary folder only where the setting is missing and all of
    Spark runs in one process (``local`` or ``local[n]``, not a local cluster);
    elsewhere a missing setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="granary-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Tables written since the innermost :func:`tables_dropped` began, one list per nesting.
_scopes: list[list[str]] = []


@contextmanager
def tables_dropped(spark: SparkSession) -> Iterator[None]:
    """Drops, at the end of the block, all tables that :func:`saved` wrote in it.

    Results are lazy and read these tables, so write or collect them inside.
    Tables written outside any such block stay until the session ends.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/granary/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    if _scopes:
        _scopes[-1].append(path)
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table that :func:`saved` wrote and that nothing reads any more."""
    path = getattr(df, "saved_path", None)
    if path:
        _delete(df.sparkSession, path)
