"""Cutting lineage through a written table in the shared checkpoint folder.

Python extraction and range-partitioned numbering must run once only.  Their
result goes to Parquet under ``spark.checkpoint.dir``, which every executor can
reach, so a lost executor costs a re-read and never a different answer.  There is
no other folder to fall back to: a machine's own disk is not shared.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


def staging_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return root.rstrip("/")


def stage(df: DataFrame, label: str = "stage", outlives: bool = False) -> DataFrame:
    """Write ``df`` once and return the written table; ``outlives`` the innermost scope it is made in."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/gridlake/{label}-{uuid.uuid4().hex}"
    for scope in _scopes[:-1] if outlives else _scopes:
        scope.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_stages(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark._jsc.hadoopConfiguration()
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(hadoop).delete(path, True)


@contextmanager
def stages_listed() -> Iterator[list[str]]:
    """The folders staged inside, for a caller that removes them once their readers are done."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)


@contextmanager
def stages_removed(spark: SparkSession) -> Iterator[None]:
    """Remove what was staged inside, at the end; results that read it must be written by then."""
    with stages_listed() as made:
        try:
            yield
        finally:
            remove_stages(spark, made)
