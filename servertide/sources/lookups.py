"""Texts and plans by handle, kept in buckets of their key, so that a join moves only the rows that ask.

A lookup table has one row per key (a handle, with the scope columns before it) and is the
largest table of a collection. Its files are bucketed and sorted by that key. Spark knows where a
key lies, so in a join or semi-join on the whole key it shuffles the other side into those
buckets and reads the lookup table where it is. Rows of a handle never change: adding
rows means adding those whose key is not there yet, which is found bucket by bucket, and
adding the same rows again adds nothing.

The files are plain Parquet; the catalog entry that tells Spark about the buckets belongs to
the session and is made anew by each reader.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from servertide.sources.schemas import schema

#: Enough that a bucket of a large table fits a task; written into the folder's name.
BUCKETS = 256
#: Key columns of the lookup tables; scope columns come before them.
KEYS = {
    "sql_text": ("sql_handle",),
    "query_plan": ("plan_handle",),
    "statement_plan": ("plan_handle", "statement_start_offset", "statement_end_offset"),
}


class Lookup:
    """The lookup table ``table`` below ``root``, in ``buckets`` buckets of its key."""

    def __init__(
        self, spark: SparkSession, root: str, table: str, *scope: str, buckets: int = BUCKETS, fields: T.StructType | None = None,
        key: Sequence[str] | None = None,
    ):
        self._spark, self._buckets = spark, buckets
        self.key = [*scope, *(key or KEYS[table])]
        self._fields = fields or schema(table, *scope)
        self._path = f"{root}/{table}_by_{'_'.join(self.key)}_{buckets}"
        self._name = f"servertide_{table}_{hashlib.md5(self._path.encode()).hexdigest()[:16]}"

    def _known(self) -> str:
        """The catalog's name of the table; its folder need not exist yet."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._fields)
        keys = ", ".join(f"`{c}`" for c in self.key)
        self._spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._name} ({columns}) USING parquet "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self._buckets} BUCKETS LOCATION '{self._path}'"
        )
        # Others may have added files.
        self._spark.catalog.refreshTable(self._name)
        return self._name

    def read(self) -> DataFrame:
        return self._spark.table(self._known())

    def add(self, rows: DataFrame) -> None:
        """Add the rows whose key is not there yet; of rows that repeat a key one is added, rows without a whole key are not.

        The rows are dealt to the buckets once, which serves the comparison, and leaves one new file in each bucket.
        """
        columns = [f.name for f in self._fields]
        whole = rows.select(*columns).dropna(subset=self.key).repartition(self._buckets, *self.key).dropDuplicates(self.key)
        new = whole.join(self.read().select(*self.key), self.key, "left_anti").select(*columns)
        # Tables of this kind are written by name and by position.
        new.sortWithinPartitions(*self.key).write.insertInto(self._name)
        self._spark.catalog.refreshTable(self._name)
