"""Cutting lineage: intermediate results as tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_own_roots: dict[str, str] = {}
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; on a cluster that
    would be a machine-local folder, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own_roots:
        _own_roots[context.applicationId] = tempfile.mkdtemp(prefix="servertide-")
    return _own_roots[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/servertide-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, *folders: str) -> DataFrame:
    """Write ``df`` once, in folders by the columns ``folders``, and read it back.

    Later steps start from files that outlive executors, and the planner sees the
    real size when it chooses between broadcast and shuffle joins.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _shuffles_freed(spark):
        df.write.partitionBy(*folders).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_folders = [path]
    return out


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write go when it has ended, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)


def reading(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df``, which is the last to read these tables: ``discard(df)`` deletes them."""
    df.scratch_folders = [path for table in tables for path in getattr(table, "scratch_folders", ())]
    return df


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` has made and that no step to come reads."""
    for table in tables:
        files = table.sparkSession._jvm.org.apache.hadoop.fs
        for path in getattr(table, "scratch_folders", ()):
            folder = files.Path(path)
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def written_with(df: DataFrame, label: str, **facts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``written``, and aggregates over the rows, which are taken while they are written."""
    observed = Observation()
    out = written(df.observe(observed, *(fact.alias(name) for name, fact in facts.items())), label)
    return out, observed.get
