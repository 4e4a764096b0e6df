"""Embedding near-dedup with a pivot-permutation index.

Reference points (pivots) are taken from a bounded sample of the vectors; there are about
twice as many as the square root of the vectors. Every vector is described by its ``NEAREST`` nearest
pivots in order. An inverted list holds, for a label and a pivot, the vectors that have
the pivot among the first ``LISTED`` of theirs. Vectors of a list that share a further
pivot meet; the pivots they share are counted, and the pair is taken up in the list of the first
of those in number, so it counts once. Then the cosine is taken in double precision. The
index is approximate (vectors whose first pivots are disjoint, or that share only one pivot
at all, are not compared); the tests measure its recall against brute force.

Two vectors share two pivots by chance with a probability that falls with the square of the number of pivots, so the pairs that
meet grow with the vectors and not with their square, up to ``PIVOTS_MOST`` pivots.

Equal vectors of a label are one class with a weight, so copies are not expanded. A crowded
list is cut into blocks of which every two meet. Links are counted and reduced to stars in
the task that finds them; pairs are never written.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servertide.llm.components import components
from servertide.llm.meet import HIGH, KEY, LOW, SIDE, crowded_keys, group_starts, grouped, pairs, stars, whole_groups
from servertide.operators.scratch import written

COSINE = 0.93
#: Pivots at least and at most, and bytes that they may take.
PIVOTS, PIVOTS_MOST, PIVOT_BYTES = 256, 8192, 1 << 25
#: Vectors of the sample for each pivot that is asked for, at least so many.
SAMPLE, SAMPLE_LEAST = 4, 2048
#: Pivots that are nearer to each other than this say the same; one of them goes.
APART = 0.6
#: Pivots that describe a vector, and those of them in whose lists it stands.
NEAREST, LISTED = 10, 5
#: Rows of a block of a crowded list.
LIST_CAP = 4096
PAIRS_AT_A_TIME = 100_000

#: Numbers and unit vectors of the pivots, by the length of the vectors.
Pivots = dict[int, tuple[np.ndarray, np.ndarray]]


def _unit(rows: np.ndarray) -> np.ndarray:
    # Scaling by the largest component first keeps squares of huge and tiny numbers in range.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def pivots_for(vectors: int, size: int) -> int:
    """How many pivots to ask for."""
    return min(max(PIVOTS, 2 * isqrt(vectors)), max(PIVOTS, min(PIVOTS_MOST, PIVOT_BYTES // (8 * max(size, 1)))))


def choose_pivots(sample: list[np.ndarray], most: int) -> Pivots:
    """Unit vectors of the sample that are apart from each other, in its order."""
    chosen: dict[int, tuple[list[int], np.ndarray]] = {}
    number = 0
    for row in sample:
        if number == most:
            break
        if len(row) not in chosen:
            chosen[len(row)] = [], np.empty((most, len(row)))
        numbers, units = chosen[len(row)]
        unit = _unit(row[None].astype(float))[0]
        if not numbers or (units[: len(numbers)] @ unit).max() < APART:
            units[len(numbers)] = unit
            numbers.append(number)
            number += 1
    return {size: (np.array(numbers, np.int32), units[: len(numbers)].copy()) for size, (numbers, units) in chosen.items()}


def _described(pivots: Pivots):
    """The numbers of the vectors' nearest pivots, in order, as a column of their own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            sizes = np.asarray(vectors.value_lengths())
            nearest: list = [None] * batch.num_rows
            flat, offsets = np.asarray(vectors.flatten()), np.concatenate([[0], np.cumsum(sizes)])
            for size in np.unique(sizes):
                which = np.flatnonzero(sizes == size)
                # A size that the sample lacks has one list for all its vectors.
                numbers, units = pivots.get(int(size), (np.zeros(1, np.int32), np.zeros((1, size))))
                for some in np.array_split(which, max(1, len(which) * len(numbers) // 4_000_000)):
                    near = -(_unit(flat[offsets[some][:, None] + np.arange(size)].astype(float)) @ units.T)
                    for at, row in zip(some.tolist(), numbers[np.argsort(near, axis=1, kind="stable")[:, :NEAREST]]):
                        nearest[at] = row
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("class_id", "weight", "label", "vector")), pa.array(sizes, pa.int32()), pa.array(nearest, pa.list_(pa.int32()))],
                names=["class_id", "weight", "label", "vector", "size", "nearest"],
            )

    return work


def _rows(column: pa.ChunkedArray, fill) -> np.ndarray:
    """A list column as a matrix; shorter lists are filled up."""
    lists = column.combine_chunks()
    sizes = np.asarray(lists.value_lengths())
    out = np.full((len(sizes), sizes.max()), fill, np.asarray(lists.flatten()).dtype)
    out[np.arange(sizes.max()) < sizes[:, None]] = np.asarray(lists.flatten())
    return out


def met(lists: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs to be compared, each once over all lists; ``lists`` holds whole lists or blocks of them.

    Within a list the rows meet by the further pivots that they share, or all with all where that is less work.
    """
    near = _rows(lists.column("nearest"), -1)
    pivot, label, size = (np.asarray(lists.column(n)) for n in ("pivot", "label", "size"))
    alone = (near >= 0).sum(1) == 1  # described by one pivot, so there is no further one
    group = np.cumsum(group_starts(lists)) - 1
    row, place = np.nonzero((near >= 0) & (near != pivot[:, None]))
    wide = int(near.max(initial=0)) + 2
    key, count = np.unique(group[row] * wide + near[row, place] + 1, return_counts=True)
    rows_of = np.bincount(group)
    whole = np.bincount(key // wide, count.astype(float) ** 2, len(rows_of)) >= rows_of.astype(float) ** 2
    whole[group[alone]] = True
    listed = ~whole[group[row]]
    every = np.flatnonzero(whole[group])
    further = np.concatenate([near[row, place][listed], np.full(len(every), -1)])
    row = np.concatenate([row[listed], every])
    side = np.asarray(lists.column(SIDE))
    order = np.lexsort((side[row], further, group[row]))
    row, further = row[order], further[order]
    inner = pa.table({
        KEY: group[row] * wide + further + 1, SIDE: side[row],
        **{n: np.asarray(lists.column(n))[row] for n in (LOW, HIGH)},
    })
    none = np.iinfo(near.dtype).max
    for left, right in pairs(inner, PAIRS_AT_A_TIME):
        by = further[left]
        left, right = row[left], row[right]
        mine = near[left]
        same = (mine[:, :, None] == near[right][:, None, :]) & (mine >= 0)[:, :, None]
        shared = same.any(2)
        # The list of the first pivot that both stand in the lists of ...
        own = np.where(same[:, :LISTED, :LISTED].any(2), mine[:, :LISTED], none).min(1) == pivot[left]
        # ... and there the first further one.
        rest = np.where(shared & (mine != pivot[left][:, None]), mine, none).min(1)
        own &= np.where(by < 0, (rest != none) | alone[left], rest == by)
        # The lists' keys are hashes, which may coincide.
        own &= (pivot[left] == pivot[right]) & (size[left] == size[right]) & (label[left] == label[right])
        yield left[own], right[own]


def _links(threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in whole_groups(batches):
            units = _unit(_rows(lists.column("vector"), 0.0).astype(float))
            ids, weights = (np.asarray(lists.column(n)) for n in ("class_id", "weight"))
            for left, right in met(lists):
                hit = np.einsum("ij,ij->i", units[left], units[right]) >= threshold
                left, right = left[hit], right[hit]
                if not len(left):
                    continue
                rows, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
                count = np.bincount(ends, np.concatenate([weights[right], weights[left]])).astype(np.int64)
                to = dict(zip(*(x.tolist() for x in stars(ids[left], ids[right]))))
                a = ids[rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(count), pa.array([to.get(x, x) for x in a.tolist()], pa.int64())], names=["a", "n", "b"]
                )

    return work


def inverted_lists(classes: DataFrame) -> DataFrame:
    """The lists of all vectors of ``classes`` (class_id, weight, label, vector), cut into blocks and dealt to tasks whole."""
    spark = classes.sparkSession
    vectors, size = classes.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    most = pivots_for(vectors, size)
    # Ids are hashes, so those below a bound are a sample, whose expected size is the same for any table.
    share = min(1.0, max(SAMPLE_LEAST, SAMPLE * most) / max(vectors, 1))
    part = F.shiftrightunsigned("class_id", 32) < F.lit(int(share * (1 << 32)))
    sample = classes.where(part).select("class_id", "vector").toArrow().sort_by("class_id")
    pivots = spark.sparkContext.broadcast(
        choose_pivots([np.asarray(row.values) for chunk in sample.column("vector").chunks for row in chunk], most)
    )

    def describe(batches):
        return _described(pivots.value)(batches)

    fields = classes.schema
    # A table, so that the lists' sizes are counted without describing the vectors again.
    described = written(
        classes.select("class_id", "weight", "label", "vector").mapInArrow(
            describe,
            f"class_id long, weight long, label {fields['label'].dataType.simpleString()}, vector {fields['vector'].dataType.simpleString()}, "
            "size int, nearest array<int>",
        ),
        "described",
    )
    postings = described.withColumn("pivot", F.explode(F.slice("nearest", 1, LISTED))).withColumn(KEY, F.xxhash64("label", "size", "pivot"))
    return grouped(postings, "class_id", LIST_CAP, written(crowded_keys(postings, LIST_CAP), "crowded"))


def near_duplicates(
    embeddings: DataFrame, threshold: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``embeddings``.

    Vectors are compared if their labels are equal and not null and their lengths equal.
    Null, empty and zero vectors and vectors with null or non-finite components link with
    nothing. component_id is the smallest id reachable by links, itself included; kept says
    that it is the row's own. A row without an id counts as a link of others and has
    n_links, but no component_id of its own beyond that of the rows it links with. Rows
    that repeat an id are rows of their own. Other columns are not read.
    """
    # Single precision stays what it is until cosines are taken.
    kind = "float" if embeddings.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    vector = F.col(vector_col).cast(f"array<{kind}>")
    sound = (
        F.col(label_col).isNotNull() & vector.isNotNull()
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
        & F.exists(vector, lambda x: x != 0)
    )
    rows = embeddings.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"),
        F.when(F.coalesce(sound, F.lit(False)), F.transform(vector, lambda x: x + F.lit(0.0).cast(kind))).alias("vector"),
    ).withColumn("hash", F.when(F.col("vector").isNotNull(), F.sha2(F.concat_ws(",", F.col("vector").cast("array<string>")), 256)))
    rows = written(rows, "vectors")
    classes = written(
        rows.where("vector IS NOT NULL").groupBy("label", "hash")
        .agg(F.min("id").alias("first"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
        .withColumn("class_id", F.xxhash64("label", "hash")),
        "classes",
    )
    found = written(inverted_lists(classes).mapInArrow(_links(threshold), "a long, n long, b long"), "found")
    counts = found.groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("others"))
    roots = components(found.select("a", "b")).withColumnRenamed("node", "class_id")
    rooted = classes.drop("vector").join(roots, "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    facts = (
        rooted.join(smallest, "root").join(counts, "class_id", "left")
        .select("label", "hash", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    )
    return rows.drop("vector").join(facts, ["label", "hash"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
