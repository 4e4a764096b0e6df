"""SimHash near-dedup with vantage-point trees.

Fingerprint: words are runs of anything but ASCII white space after A-Z are lower-cased;
each run of three words is hashed with XXH64 (seed 42); a bit of the fingerprint is set if
it is set in over half of the hashes. Null, empty and blank texts have fingerprint zero.

Search: two fingerprints that differ in at most 3 bits differ in at most 1 bit in one of
their halves. So there are two trees, one for each half with the Hamming distance of that
half. The first levels have the zero fingerprint, seen through one block of bits each, as
vantage point; the branch of a fingerprint is its distance to it. By the triangle inequality
the distances of two fingerprints within 1 bit differ by at most 1 over all blocks together:
at one block they may lie on two sides of a boundary between branches, and that spends the
radius. In all other blocks it is 0, so there partners are equally far from every vantage
point; further levels take the unit vectors of those blocks, whose distances determine the
bits, and need no more boundaries. A fingerprint therefore looks for partners in the shards
of the boundaries below and above its branch at each block, at most 16 in all, and those hold
only fingerprints with the same bits in the rest of the half. Of random fingerprints a shard
gets one more for every 40 million, so the comparisons stay below the postings up to some
tens of millions of rows and are about 12 a posting for a billion. In a shard all pairs are
compared over the 64 bits, exactly; crowded shards are cut into blocks of which every two
meet. Nothing is approximate.

Equal fingerprints are one class, so thousands of copies are one row in the search. A
task reports the links it finds as stars (at most one link per fingerprint), which keeps
the components and not the square of a group's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servertide.llm.components import components
from servertide.llm.meet import KEY, compare, stars
from servertide.operators.scratch import written

MAX_BITS = 3
SEED = 42
SHINGLE = 3
#: Blocks of bits of a half and their width: the levels of a tree that have boundaries.
BLOCKS, WIDTH = 4, 8
SHARD_CAP = 1024
PAIRS_AT_A_TIME = 2_000_000
HASHES_AT_A_TIME = 65_536


def fingerprint_of(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    counts = np.zeros(64, np.int64)
    shingles = max(1, len(words) - SHINGLE + 1)
    for at in range(0, shingles, HASHES_AT_A_TIME):
        part = words[at: at + HASHES_AT_A_TIME + SHINGLE - 1]
        if len(words) < SHINGLE:
            runs = [b" ".join(words)]
        else:
            runs = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE))))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.dtype(">u8"))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > shingles).view(">i8")[0])


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column, as bigint."""

    def prints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([fingerprint_of(t) for t in part], dtype="int64")

    prints.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(prints, "long")(text)


def _shards(fp: Column) -> Column:
    """Keys of the shards in which a fingerprint looks for partners: the boundaries on both sides of its branch, block by block."""
    keys: list[Column] = []
    for tree in range(2):
        half = F.shiftrightunsigned(fp, 32 * tree).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
        for k in range(BLOCKS):
            block = ((1 << WIDTH) - 1) << (k * WIDTH)
            far = F.bit_count(half.bitwiseAND(F.lit(block).cast("long"))).cast("long")
            rest = half.bitwiseAND(F.lit(0xFFFFFFFF ^ block).cast("long"))
            # The boundary between the distances d and d + 1 carries the number d.
            for inside, d in ((far < WIDTH, far), (far > 0, far - 1)):
                level = F.lit(tree * BLOCKS + k).cast("long") * WIDTH + d
                keys.append(F.when(inside, F.shiftleft(level, 32).bitwiseOR(rest)))
    return F.array_compact(F.array(*keys))


def _judge(max_bits: int):
    def judge(table: pa.Table):
        fps = np.asarray(table.column("fp"))

        def links(left: np.ndarray, right: np.ndarray) -> Iterator[pa.RecordBatch]:
            near = np.bitwise_count((fps[left] ^ fps[right]).view(np.uint64)) <= max_bits
            if near.any():
                a, b = stars(fps[left[near]], fps[right[near]])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        return links

    return judge


def linked(fingerprints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all ``fp`` (distinct, bigint) with partners within three bits."""
    postings = fingerprints.select("fp", F.explode(_shards(F.col("fp"))).alias(KEY))
    return compare(postings, "fp", SHARD_CAP, PAIRS_AT_A_TIME, _judge(MAX_BITS), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the smallest id reachable by links, itself included. Rows with a null id
    take part like others; their component is null only if no member has an id. Repeated
    rows give repeated results. Other columns of ``docs`` are not read, whatever their names.
    """
    prints, rooted = _rooted(docs, id_col, text_col)
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _rooted(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of every row, and (fp, first, root) of every fingerprint: its smallest id, and the same root all over a component."""
    prints = written(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp")), "prints")
    classes = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    roots = components(linked(classes.select("fp")))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return prints, written(rooted, "rooted")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest id stays.

    Rows without an id come last. Rows of one id are judged by their texts: those in different
    components stay apart, of those with equal fingerprints one stays.
    """
    prints, rooted = _rooted(docs, "doc_id", "text")
    first = F.min(F.struct(F.col("first").isNull().alias("nameless"), "first", "fp")).alias("row")
    kept = written(rooted.groupBy("root").agg(first).select(F.col("row.first").alias("id"), F.col("row.fp").alias("fp")), "kept")
    # An id names a row, unless it is null or its rows differ in their fingerprints.
    vague = prints.groupBy("id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("id IS NULL OR low <> high").select("id")
    vague = written(vague, "vague")
    same = F.col("k.id").eqNullSafe(F.col("v.id"))
    clear = kept.alias("k").join(vague.alias("v"), same, "left_anti").select(F.col("id").alias("doc_id")).distinct()
    named = docs.join(clear, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    if vague.isEmpty():
        return named
    rows = docs.alias("d").join(vague.alias("v"), F.col("d.doc_id").eqNullSafe(F.col("v.id")), "left_semi").withColumn("__fp", fingerprint(F.col("text")))
    chosen = (F.col("d.__fp") == F.col("k.fp")) & F.col("d.doc_id").eqNullSafe(F.col("k.id"))
    rows = rows.alias("d").join(kept.alias("k"), chosen, "left_semi").dropDuplicates(["doc_id", "__fp"])
    return named.unionByName(rows.select(docs.columns))
