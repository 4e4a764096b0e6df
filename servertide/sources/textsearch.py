"""Substring search over statement texts by inverted lists of q-grams, built once.

The index has three tables of batches: the texts, in folders by a hash of their key and numbered
there; for each run of ``Q`` characters the numbers of the texts that have it, in folders by a hash of the run and
sorted by run; and the length of each list. A LIKE pattern is broken at its wildcards. Of the runs of
its pieces the rarest few are looked up, their lists are intersected, and the texts that
remain are compared with the pattern itself, so nothing is approximate. Where few texts
remain, only their folders are read. A pattern without a run of ``Q`` characters is compared with every text.

The runs are found in the workers' Python, many texts at a time, and leave it as arrays of numbers, one for
each run and stretch of texts. So a list is as many rows as there are stretches, and not one row for each text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from servertide.operators.lookup import lookup_join
from servertide.operators.scratch import discard, written
from servertide.sources.collected import BATCH, append_batch

Q = 3
#: Runs of a pattern whose lists are intersected.
RAREST = 3
#: Pairs of pattern and text up to which only the folders of those texts are read.
FEW = 1000
#: Folders of the lists and of the texts; an index keeps the numbers it was made with.
PARTS, SLOTS = 256, 1024
#: Characters of the texts whose runs are found together.
STRETCH = 1_000_000

# Wildcards, and characters behind the escape.
_BREAK = re.compile(r"\\.|[%_]", re.DOTALL)


def _listed(stretch: int):
    """For ``mapInArrow``: texts in lower case, with slot and number, to (gram, slot, numbers).

    A row has the numbers of the texts of one slot, next to each other in the input and together of at most
    ``stretch`` characters, that have a run of Q characters; a text that is longer than that has rows of its own.
    Everything it needs is inside, so that workers need no code of this package.
    """
    q = Q

    def points_of(text, np):
        return np.frombuffer(text.encode("utf-32-le"), np.uint32)

    def letters_of(points, np):
        there = np.zeros(int(points.max()) + 1, bool)
        there[points] = True
        return np.flatnonzero(there)

    def runs_of(points, letters, owners, owned, np):
        """The distinct (run, owner) in order of the run: a table of the runs' characters, where each run begins, and the owners."""
        code = np.zeros(int(letters[-1]) + 1, np.int64)
        code[letters] = np.arange(len(letters))
        codes = code[points]
        runs = codes[: 1 - q]
        for k in range(1, q):
            runs = runs * len(letters) + codes[k: len(codes) - q + 1 + k]
        found = np.sort((runs * owned + owners[: 1 - q])[owners[: 1 - q] == owners[q - 1:]])
        found = found[np.flatnonzero(np.diff(found, prepend=-1))]
        runs, owners = np.divmod(found, owned)
        starts = np.flatnonzero(np.diff(runs, prepend=-1))
        runs, digits = runs[starts], []
        for _ in range(q):
            runs, digit = np.divmod(runs, len(letters))
            digits.append(letters[digit].astype(np.uint32))
        return np.stack(digits[::-1], axis=1), starts, owners

    def names_of(table):
        joined = table.tobytes().decode("utf-32-le")
        return [joined[i: i + q] for i in range(0, len(joined), q)]

    def listed(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def lengths_of(texts):
            return pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)

        def rows(grams, slot, starts, numbers):
            lists = pa.ListArray.from_arrays(pa.array([*starts, len(numbers)], pa.int32()), pa.array(numbers, pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([slot] * len(grams), pa.int32()), lists], names=["gram", "slot", "numbers"])

        def together(texts, slot, numbers):
            points = points_of("".join(texts.to_pylist()), np)
            if len(points) < q:
                return
            letters, owned = letters_of(points, np), len(texts)
            # A run and its owner are one number of 63 bits; where the letters are too many for that, the texts are halved.
            if len(letters) ** q * owned >= 2 ** 63:
                half = owned // 2
                yield from together(texts[:half], slot, numbers[:half])
                yield from together(texts[half:], slot, numbers[half:])
                return
            owners = np.repeat(np.arange(owned), lengths_of(texts))
            table, starts, owners = runs_of(points, letters, owners, owned, np)
            if len(table):
                yield rows(names_of(table), slot, starts, numbers[owners])

        def alone(text, slot, number):
            grams = set()
            for at in range(0, len(text) - q + 1, stretch):
                points = points_of(text[at: at + stretch + q - 1], np)
                grams.update(names_of(runs_of(points, letters_of(points, np), np.zeros(len(points), np.int64), 1, np)[0]))
            grams = sorted(grams)
            for at in range(0, len(grams), stretch):
                part = grams[at: at + stretch]
                yield rows(part, slot, range(len(part)), [number] * len(part))

        for batch in batches:
            texts, slots, numbers = batch.column("low"), batch.column("slot").to_numpy(), batch.column("number").to_numpy()
            ends = np.cumsum(lengths_of(texts))
            # Where the slot changes, and the end.
            turns = np.append(np.flatnonzero(np.diff(slots)) + 1, len(slots))
            at = 0
            while at < len(slots):
                to = np.searchsorted(ends, (ends[at - 1] if at else 0) + stretch, "right")
                to = int(min(to, turns[np.searchsorted(turns, at, "right")]))
                if to > at:
                    yield from together(texts[at:to], int(slots[at]), numbers[at:to])
                else:
                    yield from alone(texts[at].as_py(), int(slots[at]), int(numbers[at]))
                at = max(to, at + 1)

    return listed


def pieces(pattern: str) -> list[str]:
    """All runs of Q characters that every match of a lower-case LIKE pattern has."""
    found = (piece[i: i + Q] for piece in _BREAK.split(pattern) for i in range(len(piece) - Q + 1))
    return list(dict.fromkeys(found))


class TextIndex:
    """Texts with the columns ``fields``, found by parts of their column ``text``; ``key`` names a text."""

    def __init__(
        self, spark: SparkSession, root: str, key: Sequence[str], fields: T.StructType, text: str = "text",
        parts: int = PARTS, slots: int = SLOTS,
    ):
        self._spark, self._root, self._fields, self._text = spark, root, fields, text
        self._parts, self._slots = parts, slots
        self._key = list(key)
        part, gram = T.StructField("part", T.IntegerType()), T.StructField("gram", T.StringType())
        slot, number = (T.StructField(n, T.IntegerType()) for n in ("slot", "number"))
        self._tables = {
            "texts": [*fields, number, slot],
            "lists": [gram, slot, T.StructField("numbers", T.ArrayType(T.IntegerType())), part],
            "counts": [gram, T.StructField("texts", T.LongType()), part],
        }

    def _read(self, name: str) -> DataFrame:
        return self._spark.read.schema(T.StructType([*self._tables[name], T.StructField(BATCH, T.StringType())])).parquet(f"{self._root}/{name}")

    def _there(self) -> bool:
        folder = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._root}/texts")
        return folder.getFileSystem(self._spark._jsc.hadoopConfiguration()).exists(folder)

    def add(self, rows: DataFrame, batch_id: str) -> None:
        """Add the texts whose key is not there yet, under a batch id; a call that was cut off is finished by repeating it.

        Of rows that repeat a key one is added; rows without a whole key are not. Rows without
        a text are kept and match nothing.
        """
        rows = rows.select(*self._fields.names).dropna(subset=self._key).withColumns({"slot": self._slot(), "__known": F.lit(False)})
        if self._there():
            there = self._read("texts").where(F.col(BATCH) != batch_id).select(*self._key, "slot", F.lit(True).alias("__known"))
            rows = rows.unionByName(there, allowMissingColumns=True)
        # The texts are shuffled once, to their slots; there repeated keys meet, and those that are there already.
        of_key = Window.partitionBy("slot", *self._key).orderBy(F.col("__known").desc())
        new = rows.repartition("slot").withColumn("__nth", F.row_number().over(of_key)).where((F.col("__nth") == 1) & ~F.col("__known"))
        # A slot is in one task, sorted by key; the lower bits of the id count the rows of a task.
        number = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).cast("int").alias("number")
        placed = written(new.select(*self._fields.names, number, "slot"), "texts")
        low = placed.where(F.col(self._text).isNotNull()).select(F.lower(self._text).alias("low"), "slot", "number")
        own = low.mapInArrow(_listed(STRETCH), "gram string, slot int, numbers array<int>").withColumn("part", self._part())
        # By run and slot, so that the list of a run that most texts have is written by many tasks.
        tasks = int(self._spark.conf.get("spark.sql.shuffle.partitions"))
        spread = F.pmod(F.xxhash64("gram", "slot"), F.lit(max(1, tasks // self._parts)))
        append_batch(own.repartition("part", spread).sortWithinPartitions("part", "gram"), f"{self._root}/lists", batch_id, "part")
        counts = self._read("lists").where(F.col(BATCH) == batch_id).groupBy("part", "gram").agg(F.sum(F.size("numbers")).alias("texts"))
        append_batch(counts.repartition("part").sortWithinPartitions("part", "gram"), f"{self._root}/counts", batch_id, "part")
        # Last, so that no text is there before it can be found.
        append_batch(placed.sortWithinPartitions("slot", *self._key), f"{self._root}/texts", batch_id, "slot")
        discard(placed)

    def texts_like(self, pattern: str) -> DataFrame:
        """The texts that match a LIKE pattern in any case."""
        return self.search([pattern]).drop("pattern")

    def search(self, patterns: Sequence[str]) -> DataFrame:
        """(pattern, columns of the texts) for every text that matches one of the given patterns in any case."""
        found = self.candidates(patterns)
        return found.where(F.ilike(F.col(self._text), F.col("pattern"))).select("pattern", *self._fields.names)

    def candidates(self, patterns: Sequence[str]) -> DataFrame:
        """(pattern, columns of the texts) of the texts that are compared with a pattern."""
        texts = self._read("texts") if self._there() else self._spark.createDataFrame([], T.StructType(self._tables["texts"]))
        patterns = list(dict.fromkeys(patterns))
        runs = dict(zip(patterns, map(pieces, self._lower(patterns))))
        chosen = self._rarest({p: r for p, r in runs.items() if r})
        plain = F.array(*[F.lit(p) for p, r in runs.items() if not r]).cast("array<string>")
        parts = [texts.withColumn("pattern", F.explode(plain))] if not all(runs.values()) else []
        if chosen:
            parts.append(self._looked_up(texts, chosen))
        if not parts:
            return texts.withColumn("pattern", F.lit("")).where(F.lit(False))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)

    def _lower(self, patterns: list[str]) -> list[str]:
        """The patterns in lower case, as Spark has it."""
        rows = self._spark.createDataFrame(list(enumerate(patterns)), "n int, pattern string").select("n", F.lower("pattern").alias("low")).collect()
        return [r.low for r in sorted(rows, key=lambda r: r.n)]

    def _of_runs(self, name: str, runs: set[str]) -> DataFrame:
        """Rows of some runs; their folders are found by the runs' hashes."""
        one = self._spark.createDataFrame([(r,) for r in sorted(runs)], "gram string").select(self._part().alias("part")).distinct()
        folders = [r.part for r in one.collect()]
        return self._read(name).where(F.col("part").isin(folders) & F.col("gram").isin(sorted(runs)))

    def _rarest(self, runs: dict[str, list[str]]) -> dict[str, list[str]]:
        """The rarest runs of each pattern; patterns with a run that no text has are left out."""
        asked = {run for own in runs.values() for run in own}
        if not asked or not self._there():
            return {}
        counted = self._of_runs("counts", asked).groupBy("gram").agg(F.sum("texts").alias("texts")).collect()
        known = {r.gram: r.texts for r in counted}
        return {p: sorted(own, key=lambda r: (known[r], r))[:RAREST] for p, own in runs.items() if all(r in known for r in own)}

    def _looked_up(self, texts: DataFrame, chosen: dict[str, list[str]]) -> DataFrame:
        wanted = self._spark.createDataFrame([(p, r, len(own)) for p, own in chosen.items() for r in own], "pattern string, gram string, needed int")
        place = [BATCH, "slot", "number"]
        lists = self._of_runs("lists", {r for own in chosen.values() for r in own}).select(BATCH, "slot", "gram", F.explode("numbers").alias("number"))
        found = (
            lists.join(wanted, "gram").groupBy("pattern", "needed", *place).agg(F.count_distinct("gram").alias("had"))
            .where(F.col("had") == F.col("needed")).select("pattern", *place)
        )
        few = found.limit(FEW + 1).collect()
        if len(few) > FEW:
            # The keys first, which are short, so that the texts are dealt by key, as reports join them.
            keys = lookup_join(found, texts.select(*place, *self._key), place).select("pattern", *self._key).distinct()
            return lookup_join(keys, texts, self._key)
        named = self._spark.createDataFrame(few, found.schema)
        return texts.where(F.col("slot").isin(sorted({r.slot for r in few}))).join(F.broadcast(named), place)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("gram"), F.lit(self._parts)).cast("int")

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64(*self._key), F.lit(self._slots)).cast("int")
