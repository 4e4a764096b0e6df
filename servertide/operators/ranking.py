"""Top-k, per key or overall, and several rankings of one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, order: Sequence[Column], scope: Sequence[str] = (), row_number: str | None = None) -> DataFrame:
    """First ``k`` rows in ``order``, for each value of the ``scope`` columns.

    Without a scope this is a sort with a limit, which keeps k rows per task. With one,
    the rank filter lets Spark drop all but k rows of a key before the shuffle, so a
    key with many rows does no harm.
    """
    name = row_number or "__row_number"
    if scope:
        ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*scope).orderBy(*order)))
        kept = ranked.where(F.col(name) <= k)
    else:
        kept = df.orderBy(*order).limit(k)
        if row_number:
            kept = kept.withColumn(name, F.row_number().over(Window.orderBy(*order)))
    return kept if row_number else kept.drop(name)


def rankings(
    df: DataFrame, k: int, measures: Mapping[str, Column], ties: Sequence[str], scope: Sequence[str] = (),
    name: str = "report_name", row_number: str = "row_no",
) -> DataFrame:
    """Several top-k lists of one table under each other: largest measure first, then by ``ties``.

    The table is read once. Each row stands once for each list with that list's measure, and
    the rank filter lets Spark drop all but k rows of a list in each task before the shuffle.
    """
    entries = F.array(*(F.struct(F.lit(report).alias("name"), measure.alias("measure")) for report, measure in measures.items()))
    listed = df.withColumn("__entry", F.explode(entries))
    order = Window.partitionBy(*scope, "__entry.name").orderBy(F.col("__entry.measure").desc(), *ties)
    return (
        listed.withColumn(row_number, F.row_number().over(order)).where(F.col(row_number) <= k)
        .withColumn(name, F.col("__entry.name")).drop("__entry")
    )
