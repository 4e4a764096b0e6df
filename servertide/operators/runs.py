"""Runs of rows that follow each other closely in time (gaps and islands)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, POINTS = "run_start", "run_end", "run_points"


def close_runs(
    points: DataFrame, key: Sequence[str], at: str, max_gap: int, most: dict[str, str], slice_seconds: int = 86_400
) -> DataFrame:
    """One row per run: the key, ``run_start``, ``run_end``, ``run_points`` and the largest of each column of ``most``.

    ``points`` has at most one row per key and time ``at``. Neighbours of a key are in one run
    if they are at most ``max_gap`` seconds apart. A key may hold any share of the points: they
    are first joined within slices of time, and only the runs of the slices meet in one task
    per key, so that task sees one row per slice and gap, not one per point. Rows without a
    time are in no run. ``most`` maps a column of ``points`` to its name in the result.
    """
    key = list(key)
    timed = points.where(F.col(at).isNotNull()).select(
        *key, F.col(at).alias(START), F.col(at).alias(END), F.lit(1).cast("long").alias(POINTS),
        *[F.col(c).alias(name) for c, name in most.items()],
        F.floor(_micros(F.col(at)) / (slice_seconds * 1_000_000)).alias("__slice"),
    )
    return _joined(_joined(timed, [*key, "__slice"], max_gap, most).drop("__slice"), key, max_gap, most)


def _joined(runs: DataFrame, key: list[str], max_gap: int, most: dict[str, str]) -> DataFrame:
    by_time = Window.partitionBy(*key).orderBy(START)
    gap = _micros(F.col(START)) - _micros(F.lag(END).over(by_time))
    numbered = (
        runs.withColumn("__first", F.coalesce((gap > max_gap * 1_000_000).cast("int"), F.lit(1)))
        .withColumn("__run", F.sum("__first").over(by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    return numbered.groupBy(*key, "__run").agg(
        F.min(START).alias(START), F.max(END).alias(END), F.sum(POINTS).alias(POINTS), *[F.max(n).alias(n) for n in most.values()]
    ).drop("__run")


def _micros(time: Column) -> Column:
    return F.unix_micros(F.to_timestamp_ltz(time))
