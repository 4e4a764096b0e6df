"""Connected components of a link table, by repeated contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servertide.operators.scratch import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): equal roots mean one component.

    Each round every node moves to the smallest node next to it, links between nodes that
    moved to the same place vanish, and the rest connect the new places. Round one goes by
    the numbers themselves, which finishes stars at once; later rounds go by a hash that
    changes each round, so that a chain in numeric order also shrinks by a constant factor.
    Links and parents are tables in the shared folder, so a lost executor repeats one round.
    Null ends and links of a node to itself say nothing and are left out.
    """
    links = written(_tidy(links), "links")
    parents: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        turn = len(parents)

        def rank(name: str):
            return F.struct(F.col(name).alias("by") if not turn else F.xxhash64(F.lit(turn), name).alias("by"), F.col(name).alias("id"))

        parent = written(
            both.groupBy("a").agg(F.min(rank("b")).alias("near"))
            .select(F.col("a").alias("node"), F.least(rank("a"), F.col("near"))["id"].alias("parent")),
            "parents",
        )
        parents.append(parent)
        links = written(
            _tidy(
                links.join(parent.withColumnsRenamed({"node": "a", "parent": "pa"}), "a")
                .join(parent.withColumnsRenamed({"node": "b", "parent": "pb"}), "b")
                .select(F.col("pa").alias("a"), F.col("pb").alias("b"))
            ),
            "links",
        )
    if not parents:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = parents[0].withColumnRenamed("parent", "root")
    for parent in parents[1:]:
        roots = (
            roots.join(parent.withColumnRenamed("node", "root"), "root", "left")
            .select("node", F.coalesce("parent", "root").alias("root"))
        )
    return roots


def _tidy(links: DataFrame) -> DataFrame:
    return (
        links.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
