"""Joins of telemetry rows with tables that hold one row per key (texts, plans, names)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from servertide.operators.scratch import discard, written

#: Bytes of texts that a sort may move; beyond, they are read again for each slice of the order.
MOVED = 8_000_000_000
#: Bytes of texts and rows of such a slice, which one task joins and sorts: as many as fit its memory, and at most.
FITTING, SLICE_BYTES, SLICE_ROWS = 200_000_000, 2_500_000_000, 1_000_000
#: How many times the bytes that a sort would move may be read instead.
READS = 5


def lookup_join(left: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner", hot_rows: int | None = None) -> DataFrame:
    """Equi-join (``inner``, ``left`` or ``left_semi``) in which one key may hold a large share of ``left``.

    Each side is read once. Where a partition of ``left`` is far larger than the others,
    because of a frequent key, equal rows or rows without a key, adaptive execution splits it
    by the map tasks that wrote it and reads the lookup rows of the partition once for each part.

    It cannot do so if ``lookup`` is read in buckets (``sources.lookups``). With ``hot_rows``, keys of more rows than
    that are counted first (at most one in ``hot_rows`` rows is such a key); their lookup rows are
    written to a table of their own, and the rows of these keys meet that one.
    """
    on = list(on)
    if hot_rows is None:
        return left.join(lookup, on, how)
    hot = written(left.groupBy(*on).agg(F.count("*").alias("n")).where((F.col("n") > hot_rows) & _all_set(on)).select(*on), "hot")
    if hot.isEmpty():
        return left.join(lookup, on, how)
    few = written(attach(hot, lookup, on), "few")
    return left.join(hot, on, "left_anti").join(lookup, on, how).unionByName(left.join(hot, on, "left_semi").join(few, on, how))


def ordered_lookup(left: DataFrame, lookup: DataFrame, on: Sequence[str], order: Sequence[str], rows: int) -> DataFrame:
    """``lookup_join(left, lookup, on)``, sorted by ``order``; ``left``, a table made by ``written``, has ``rows`` rows.

    The sort moves a copy of the lookup row with each row: many times the lookup table, if many
    rows share one. Where that is much, only the rows of ``left`` are shuffled, into slices of the order.
    The task of a slice keeps its rows in memory, reads the lookup table through and sorts what it
    finds, so on disk is no more than the slices now being sorted. Where the table would be
    read too often for that, or the slices be too large, its rows are moved.
    """
    on = list(on)
    texts = [f.name for f in lookup.schema if f.name not in on and isinstance(f.dataType, (T.StringType, T.BinaryType))]
    slices, known = ceil(rows / SLICE_ROWS), lookup.count() if rows else 0
    moved = 0
    if 0 < slices * known <= READS * rows:
        length = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in texts), F.lit(0))
        moved = (lookup.agg(F.sum(length)).first()[0] or 0) * rows // known
        slices = max(slices, min(ceil(moved / FITTING), READS * rows // known))
    if moved <= MOVED or slices * SLICE_BYTES < moved:
        return lookup_join(left, lookup, on).orderBy(*order)
    sliced = written(left.repartitionByRange(slices, *order).withColumn("__slice", F.spark_partition_id()), "ordered", "__slice")
    discard(left)
    kept = written(lookup, "lookup").coalesce(1)
    # Else the planner shuffles a side that is one large partition. It plans when the result is used, so the setting stays.
    left.sparkSession.conf.set("spark.sql.maxSinglePartitionBytes", str(2**62))
    there = sorted(r[0] for r in sliced.select("__slice").distinct().collect())
    # One partition on either side: the join needs no shuffle. The hint keeps the rows from being broadcast.
    own = [sliced.where(F.col("__slice") == k).drop("__slice").coalesce(1).hint("shuffle_hash") for k in there]
    return reduce(DataFrame.unionByName, (lookup_join(part, kept, on).sortWithinPartitions(*order) for part in own))


def attach(few: DataFrame, lookup: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join of the rows left by a top-k with a big table; the planner sees that they are few."""
    return lookup.join(few, list(on))


def found_for(few: DataFrame, lookup: DataFrame, on: Sequence[str]) -> DataFrame:
    """The lookup rows that ``few`` refers to: what remains to be outer-joined to it."""
    keys = few.select(*on).where(_all_set(on)).distinct()
    return attach(keys, lookup, on)


def _all_set(columns: Sequence[str]):
    condition = F.lit(True)
    for name in columns:
        condition = condition & F.col(name).isNotNull()
    return condition
