"""Row numbers over a whole table in a global order, without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from servertide.operators.scratch import written


def row_numbers(df: DataFrame, order: Sequence[Column], scope: Sequence[str] = (), name: str = "row_no", slices: int | None = None) -> DataFrame:
    """``df`` with the number of each row in ``order``, from 1, overall or in each ``scope``.

    The rows are dealt to slices by range of scope and order and written once, so each keeps its
    slice. Its number is its place in the slice and the counts of the slices before. Overall, those are
    as many counts as slices, and the driver adds them up; per scope they meet in a window
    of the scope. ``order`` ends with a unique key, which also lets rows of equal value
    fall into several slices; else rows that tie may change places when a task is repeated.
    """
    spark = df.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*scope, "__slice"]
    sliced = written(
        df.repartitionByRange(slices, *[F.col(c).asc() for c in scope], *order).withColumn("__slice", F.spark_partition_id()), "slices"
    )
    counts = sliced.groupBy(*keys).agg(F.count("*").alias("__n"))
    if scope:
        earlier = Window.partitionBy(*scope).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(*keys, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    else:
        by_slice = sorted((r["__slice"], r["__n"]) for r in counts.collect())
        before = accumulate((n for _, n in by_slice), initial=0)
        offsets = F.broadcast(spark.createDataFrame([(s, b) for (s, _), b in zip(by_slice, before)], "__slice int, __offset long"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"o.{c}")) for c in keys]
    numbered = sliced.alias("s").join(offsets.alias("o"), same).select("s.*", "o.__offset")
    return numbered.withColumn(name, (F.col("__offset") + F.row_number().over(inside)).cast("long")).drop("__slice", "__offset")
