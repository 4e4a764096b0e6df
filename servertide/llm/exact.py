"""Exact dedup: rows are grouped by a 128-bit hash of their text, and the bytes of a group are compared.

Texts are equal if they are identical once each run of ASCII white space is one space. Only
ids and hashes are shuffled to find the groups. Texts of groups with several rows are then
compared byte by byte, as keys of an aggregate that merges equal texts in every task before
anything is shuffled: a group of any size moves one text per task. A hash that stands for
several texts (a collision) is split by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servertide.operators.scratch import written

#: Hashes of groups that may be broadcast (16 bytes each); beyond it, all texts are compared.
BROADCAST_ROWS = 1_000_000


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def md5_hash(normal_text: Column) -> Column:
    return F.unhex(F.md5(normal_text))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = md5_hash,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    keep_id is the smallest id of the rows with an equal text, kept marks the one row that
    stays. A null text is empty; empty texts are equal to each other. Rows without an id come
    after all others, so keep_id is null only if no row of the group has an id. Of rows that
    repeat id and text one is kept. Other columns of ``docs`` are not read, whatever their names.
    """
    text = normal(F.col(text_col))
    prints = written(
        docs.select(
            F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), content_hash(text).alias("hash"),
            F.unhex(F.sha2(text, 256)).alias("sha"),
        ),
        "prints",
    )
    groups = written(prints.groupBy("hash").agg(*_group_facts()).where("n > 1"), "groups")
    texts = docs.select(content_hash(text).alias("hash"), text.alias("text"))
    crowded = groups.select("hash")
    clashes = written(_clashes(_of_hashes(texts, crowded, broadcast_rows)), "clashes")
    if clashes.isEmpty():
        return _judged(prints, groups, ["hash"])
    clear = _judged(prints.join(clashes, "hash", "left_anti"), groups, ["hash"])
    # Rows of one hash and several texts are told apart by the texts.
    rows = docs.select(F.col(id_col).alias("id"), content_hash(text).alias("hash"), text.alias("text"))
    rows = written(
        rows.join(clashes, "hash", "left_semi").withColumns(
            {"row": F.monotonically_increasing_id(), "sha": F.unhex(F.sha2("text", 256))}
        ),
        "clashing",
    )
    return clear.unionByName(_judged(rows, rows.groupBy("hash", "text").agg(*_group_facts()), ["hash", "text"]))


def _group_facts() -> list[Column]:
    return [F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row")).alias("first")]


def _of_hashes(texts: DataFrame, hashes: DataFrame, broadcast_rows: int) -> DataFrame:
    """The texts of the hashes, where those are few enough to be sent to all tasks; else all texts, which is as right."""
    if hashes.limit(broadcast_rows + 1).count() > broadcast_rows:
        return texts
    return texts.join(F.broadcast(hashes), "hash", "left_semi")


def _clashes(texts: DataFrame) -> DataFrame:
    """Hashes that stand for more than one text."""
    return texts.groupBy("hash", "text").agg(F.count("*")).groupBy("hash").agg(F.count("*").alias("texts")).where("texts > 1").select("hash")


def _judged(rows: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    """The output columns; rows without a group are alone."""
    first = F.col("first")
    alone = first.isNull()
    return rows.join(groups, key, "left").select(
        F.col("id").alias("doc_id"), F.when(alone, F.col("id")).otherwise(first["id"]).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (first["row"] == F.col("row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: that with the smallest id, its text as it is.

    Rows are named by id and hash, so one row stays where rows repeat id and text. Columns
    pass through, whatever their names.
    """
    kept = exact_groups(docs, id_col, text_col).where("kept").select(
        F.struct(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).alias("__name")
    )
    name = F.struct(F.col(id_col).alias("id"), F.sha2(normal(F.col(text_col)), 256).alias("sha"))
    own = docs.withColumn("__name", name)
    same = F.col("d.__name").eqNullSafe(F.col("k.__name"))
    return own.alias("d").join(kept.alias("k"), same, "left_semi").dropDuplicates(["__name"]).select(*(f"`{c}`" for c in docs.columns))
