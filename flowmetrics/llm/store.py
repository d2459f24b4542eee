"""Shared intermediate tables.

Lineage is cut by writing Parquet to the shared folder that the cluster
names in ``spark.checkpoint.dir``; a lost executor then costs a reread, not
a recomputation.  Only a local session without that setting (tests) gets a
scratch folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyspark.sql.functions as F
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: a write then drops its shuffle files when it ends; they would stay until the driver happens to collect its garbage
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: paths of the tables of the ``scratch`` blocks that are open, innermost last
_open: ContextVar[tuple[list[str], ...]] = ContextVar("_open", default=())


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, from the session's settings."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING, None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {_SETTING} to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="llm-tables-")
    spark.conf.set(_SETTING, folder)
    return folder


def materialize(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back; ``stays``: beyond the innermost ``scratch`` block."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if inside := _open.get()[:-1] if stays else _open.get():
        inside[-1].append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written in the block go at its end, but for those that stay; what is read later may not come from the others."""
    paths: list[str] = []
    token = _open.set((*_open.get(), paths))
    try:
        yield
    finally:
        _open.reset(token)
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def set_aside(docs: DataFrame, needed: tuple[str, ...]) -> tuple[DataFrame, list]:
    """``docs`` with all columns but the needed ones under names that nothing else uses, and the columns that undo it."""
    mark = uuid.uuid4().hex
    names = {c: c if c in needed else f"_{mark}_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(n).alias(c) for c, n in names.items()]


def broadcast(spark: SparkSession, model) -> Broadcast:
    """Broadcast a fitted model of bounded size, classes by value: ``pickle.loads(x.value)`` gives it back."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))
