"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Words and pairs of words of a text are hashed to ``BUCKETS`` buckets. The raw model counts
all documents; the target model counts documents that are labelled good, a bounded sample
of ``TARGETS`` ids with the smallest hashes (its ids are sent to the workers). A document's
log weight is the mean over its n-grams of the log ratio of the two models, for a document
of ``LENGTH`` n-grams, so that short and long ones compare. With Gumbel noise from a hash of
the id added, the largest ``keep`` share is a weighted sample without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servertide.operators.scratch import written

BUCKETS_LOG2 = 14
BUCKETS = 1 << BUCKETS_LOG2
TARGETS = 20_000
LENGTH = 100
KEEP = 0.85
SEED = 5
BINS = 1024
#: Words hashed at a time.
WORDS_AT_A_TIME = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def buckets(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all words and pairs of neighbouring words of a text, a stretch at a time."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    for at in range(0, len(words), WORDS_AT_A_TIME):
        part = words[at: at + WORDS_AT_A_TIME + 1]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        pairs = (hashes[:-1] * _MIX) ^ hashes[1:] * np.uint64(0xD1342543DE82EF95)
        own = hashes[:WORDS_AT_A_TIME]
        yield (np.concatenate([own, pairs * _MIX]) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a partition's n-grams per bucket, for all rows and for target rows."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, good in zip(batch.column("text"), batch.column("good").to_pylist()):
            for own in buckets(text.as_py()):
                counts = np.bincount(own, minlength=BUCKETS)
                raw += counts
                if good:
                    target += counts
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])


def log_ratio(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log of target over raw probability of each bucket, both with one added to every count."""
    targets = (
        labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGETS).withColumn("good", F.lit(True))
    )
    # At most TARGETS ids, whatever the data.
    marked = docs.join(F.broadcast(targets), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    counts = marked.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    table = np.ones((BUCKETS, 2))
    for bucket, raw, target in counts.collect():  # at most BUCKETS rows
        table[bucket] += (raw, target)
    logs = np.log(table / table.sum(0))
    return logs[:, 1] - logs[:, 0]


def largest(scores: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a column, by histograms of narrowing ranges."""
    rows = scores.where(F.col(column).isNotNull()).select(F.col(column).alias("x"))
    low, high, n = rows.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if not n or k <= 0:
        return None
    k = min(k, n)
    while low < high:
        width = (high - low) / BINS
        inside = rows.where(F.col("x").between(low, high))
        bin_of = F.least(F.floor((F.col("x") - low) / F.lit(width)), F.lit(BINS - 1)) if width else F.lit(0)
        bins = inside.groupBy(bin_of.alias("bin")).agg(F.min("x"), F.max("x"), F.count("*")).orderBy(F.desc("bin")).collect()
        for _, bin_low, bin_high, count in bins:
            if k <= count:
                if (bin_low, bin_high) == (low, high):  # as narrow as doubles get
                    return low
                low, high = bin_low, bin_high
                break
            k -= count
    return low


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """(doc_id, n_grams, log_weight, score, selected) for every row of ``docs``.

    ``selected`` marks the ``keep`` share (rounded up) of rows with the largest score; rows
    with equal scores (repeated rows) stay or go together. A null, empty or blank text has
    no n-grams and the log weight 0. Without labels all weights are near the raw model's.
    Rows without an id have the same noise. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratio(docs, labels))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, weights = [], []
            for text in batch.column("text"):
                n, total = 0, 0.0
                for own in buckets(text.as_py()):
                    n += len(own)
                    total += float(ratio.value[own].sum())
                counts.append(n)
                weights.append(LENGTH * total / n if n else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(weights, pa.float64())], names=["doc_id", "n_grams", "log_weight"]
            )

    weighed = docs.mapInArrow(weigh, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_grams long, log_weight double")
    # A number between 0 and 1, neither included, from 52 bits of a hash.
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 12) + 0.5) / F.lit(float(1 << 52))
    scored = written(weighed.withColumn("score", F.col("log_weight") - F.log(-F.log(uniform))), "scored")
    k = -int(-scored.count() * keep // 1)
    least = largest(scored, "score", k)
    return scored.withColumn("selected", F.col("score") >= F.lit(least) if least is not None else F.lit(False))
