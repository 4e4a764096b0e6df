"""Rows that share a key meet pairwise, in groups of bounded size.

A key may hold any share of the rows. A key with n rows is cut into ceil(n / cap) blocks
by a hash of the row id, and every two blocks (and each block with itself) form a group:
every two rows of a key meet in exactly one group, no group holds more than about
2 * cap rows, and nothing is dropped. Pairs are never written out; the caller reduces
each chunk of pairs in the task that makes them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY, LOW, HIGH, SIDE = "__key", "__low", "__high", "__side"


def crowded_keys(postings: DataFrame, cap: int) -> DataFrame:
    """(__key, __blocks) of the keys with more than ``cap`` rows."""
    return (
        postings.groupBy(KEY).count().where(F.col("count") > cap)
        .select(KEY, F.ceil(F.col("count") / cap).cast("int").alias("__blocks"))
    )


def grouped(postings: DataFrame, row_id: str, cap: int, crowded: DataFrame | None = None) -> DataFrame:
    """``postings`` (with a bigint column ``__key``) dealt to groups and sorted by group and side.

    ``crowded`` is the result of ``crowded_keys``. Where the caller has written it, the planner
    sees its size, and if it is small the rows are shuffled once and not twice.
    """
    crowded = crowded_keys(postings, cap) if crowded is None else crowded
    blocks = F.coalesce("__blocks", F.lit(1))
    placed = (
        postings.join(crowded, KEY, "left")
        .withColumn("__block", F.pmod(F.xxhash64(F.lit(7), row_id), blocks).cast("int"))
        .withColumn("__other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn(LOW, F.least("__block", "__other"))
        .withColumn(HIGH, F.greatest("__block", "__other"))
        .withColumn(SIDE, (F.col("__block") == F.col(HIGH)).cast("int") * (F.col(LOW) != F.col(HIGH)).cast("int"))
        .drop("__blocks", "__block", "__other")
    )
    return placed.repartition(KEY, LOW, HIGH).sortWithinPartitions(KEY, LOW, HIGH, SIDE)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups: the last, perhaps unfinished group of a batch waits for the next one."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.flatnonzero(group_starts(batch)[1:]) + 1
        if waiting and not _same_group(waiting[-1], batch):
            yield pa.Table.from_batches(waiting)
            waiting = []
        if len(changes):
            cut = int(changes[-1])
            yield pa.Table.from_batches([*waiting, batch.slice(0, cut)])
            waiting = [batch.slice(cut)]
        else:
            waiting.append(batch)
    if waiting:
        yield pa.Table.from_batches(waiting)


def _same_group(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
    return all(a.column(n)[a.num_rows - 1].as_py() == b.column(n)[0].as_py() for n in (KEY, LOW, HIGH))


def group_starts(rows) -> np.ndarray:
    """True at the first row of each group."""
    first = np.ones(rows.num_rows, bool)
    if rows.num_rows > 1:
        first[1:] = False
        for name in (KEY, LOW, HIGH):
            values = np.asarray(rows.column(name))
            first[1:] |= values[1:] != values[:-1]
    return first


def pairs(rows: pa.Table, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs that meet in the groups of ``rows``, at most about ``most`` at a time."""
    n = rows.num_rows
    starts = np.flatnonzero(group_starts(rows))
    ends = np.append(starts[1:], n)
    group = np.repeat(np.arange(len(starts)), ends - starts)
    side = np.asarray(rows.column(SIDE))
    within = (np.asarray(rows.column(LOW)) == np.asarray(rows.column(HIGH)))
    # The rows of side 1 come last in a group of two blocks.
    ones = np.concatenate([[0], np.cumsum(side)])
    second = ends - (ones[ends] - ones[starts])
    begin = np.where(within, np.arange(n) + 1, second[group])
    length = np.where(within | (side == 0), ends[group] - begin, 0)
    total = np.cumsum(length)
    at = 0
    while at < n:
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + most, "right")))
        count = length[at:to]
        if count.sum():
            left = np.repeat(np.arange(at, to), count)
            offset = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
            yield left, begin[left] + offset
        at = to


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) with the same components as the links a - b, one per node at most."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def compare(postings: DataFrame, row_id: str, cap: int, most: int, judge: Callable, schema: str) -> DataFrame:
    """``judge(table)`` gives a function that turns a chunk of pairs of its row numbers (left, right) into record batches."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            judged = judge(table)
            for left, right in pairs(table, most):
                yield from judged(left, right)

    return grouped(postings, row_id, cap).mapInArrow(work, schema)
