"""Line dedup: lines that many documents share are dropped everywhere. DataFrame functions only.

Lines are parts of a text between newlines; a line's key is the line without ASCII white
space at both ends, A-Z lower-cased. Keys travel as 128-bit hashes. A key that occurs in at
least ``min_docs`` documents loses all its lines in every document; the empty key stays.

Only hashes, ids and positions are shuffled to find the lines; the texts move once, to
meet the positions their document loses. A text has only as many positions as lines, so no
group grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servertide.operators.scratch import written

MIN_DOCS = 10
#: Fixed: the ASCII white space of the definition.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    ascii_only = F.length(line) == F.octet_length(line)
    lowered = F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))
    return F.btrim(lowered, F.lit(BLANKS))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with two more columns and a new text: n_lines, n_dropped, and the kept lines joined by newline.

    A document is an id; rows that repeat an id count once. Rows without an id count by
    their text. A null or empty text is one empty line, which stays. Columns of ``docs``
    named n_lines or n_dropped are replaced; other columns pass through.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.col(id_col).cast("string")
    # Equal ids with equal texts lose equal positions, so this names a row. Its parts are told apart by the length of the id,
    # and rows without an id by their mark.
    row = F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("id "), F.length(name).cast("string"), F.lit(" "), name), F.lit("none")), F.lit(" "), text)))
    document = F.coalesce(F.concat(F.lit("id "), name), F.concat(F.lit("none "), F.md5(text)))
    lines = (
        docs.select(row.alias("row"), document.alias("document"), F.posexplode(split_lines(F.col(text_col))).alias("pos", "line"))
        .withColumn("line", line_key(F.col("line")))
        .where(F.col("line") != "")
        .select("row", "document", "pos", F.unhex(F.md5("line")).alias("key"))
    )
    lines = written(lines, "lines")
    common = (
        lines.select("key", "document").distinct()
        .groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("key")
    )
    # A table of its own, so that both sides of the join are shuffled for it and a frequent key's partition can be split.
    common = written(common, "common")
    lost = lines.join(common, "key").groupBy("row").agg(F.collect_set("pos").alias("__lost"))
    parts = split_lines(F.col(text_col))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), F.col("__lost"))
    return (
        docs.drop("n_lines", "n_dropped").withColumn("__row", row)
        .join(lost.withColumnRenamed("row", "__row"), "__row", "left")
        .withColumn("__parts", parts)
        .withColumn("n_lines", F.size("__parts").cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("__lost"), F.lit(0)).cast("long"))
        .withColumn(
            text_col,
            F.when(F.col("__lost").isNull(), text)
            .otherwise(F.array_join(F.transform(kept, lambda p: F.col("__parts")[p]), "\n")),
        )
        .drop("__row", "__lost", "__parts")
    )
