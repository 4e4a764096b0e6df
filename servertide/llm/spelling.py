"""Spelling variants: words one edit apart, found by search schemes over sharded FM-indexes.

Vocabulary: runs of Latin letters are counted with DataFrame functions, merged in every task
before they are shuffled.

Search: one edit leaves either the first or the second half of a word as it is. So a word of
length l is indexed twice, in a forward shard of (l, its first letters) and, reversed, in a
backward shard of (l, its last letters); the letters of the key are at most half of any word
that can be near. A word asks the shards of its own length and of those one longer or
shorter, so all words near to it are in six shards that it knows. A task packs whole shards
of one kind and length into FM-indexes of bounded size (``fm_index.py``) and asks them for
all words of those shards; a crowded shard is cut into blocks and its words ask each. A pair
that both directions can find counts in the forward one, so each is counted exactly once, and
a task returns for each word only the number of near words and the best of them.

Forms: a word's form has at least twice its count, so chains of forms are short; the root is
found by doubling the distance, one join a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servertide.llm.fm_index import FmIndex
from servertide.operators.scratch import written

MIN_LETTERS = 5
MIN_COUNT = 3
#: The form of a word occurs at least so many times as often.
FACTOR = 2
#: Letters of a shard's key at most, words of an index and of a block of a crowded shard, and questions held at a time.
KEY_LETTERS = 4
INDEX_WORDS = 65_536
QUESTIONS = 200_000
#: Fixed: the runs, and the letters that are lower-cased.
RUNS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FORWARD, BACKWARD = 0, 1
INDEXED, ASKING = 0, 1


def lowered(run: Column) -> Column:
    return F.when(F.length(run) == F.octet_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage_every: int = 97) -> DataFrame:
    """(word, n): lower-cased runs of letters of all texts, of at least five code points and three occurrences.

    A run loses one code point where crc32 of ``<id>:<run>`` is divisible by ``damage_every``
    (0: never): the one numbered by that value modulo the run's length. A null text has no
    runs; a null id counts as empty. Repeated rows count again.
    """
    # Damage only shortens a run.
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(RUNS), F.lit(0))).alias("run")
    ).where(F.length("run") >= MIN_LETTERS).select("id", lowered(F.col("run")).alias("word"))
    if damage_every:
        h = F.crc32(F.concat("id", F.lit(":"), F.col("word")).cast("binary"))
        at = (h % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        runs = runs.select(F.when(h % damage_every == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= MIN_LETTERS)
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def _shards(word: Column) -> Column:
    """(side, length, key, role) of the shards in which a word is indexed or asks."""
    size = F.length(word)
    entries = []
    for side, written_so in ((FORWARD, word), (BACKWARD, F.reverse(word))):
        for longer in (0, -1, 1):
            length = size + longer
            # Half of the shortest word that can be near to words of this length.
            letters = F.least(F.lit(KEY_LETTERS), F.floor((length - 1) / 2).cast("int"))
            key = F.xxhash64(F.lit(side), length, F.substring(written_so, F.lit(1), letters))
            for role in (INDEXED, ASKING) if not longer else (ASKING,):
                entry = F.struct(F.lit(side).alias("side"), length.alias("length"), key.alias("key"), F.lit(role).alias("role"))
                entries.append(entry if not longer else F.when(length >= MIN_LETTERS, entry))
    return F.array_compact(F.array(*entries))


def _dealt(words: DataFrame, index_words: int) -> DataFrame:
    """Rows (side, length, key, block, role, word, n), whole shards or blocks of shards to a task, indexed words first."""
    rows = words.select("word", "n", F.explode(_shards(F.col("word"))).alias("at")).select("at.*", "word", "n")
    crowded = (
        words.select(F.explode(_shards(F.col("word"))).alias("at")).where(F.col("at.role") == INDEXED)
        .groupBy(F.col("at.key").alias("key")).count().where(F.col("count") > index_words)
        .select("key", F.ceil(F.col("count") / index_words).cast("int").alias("blocks"))
    )
    # A table, so that the planner knows that it is small.
    crowded = written(crowded, "crowded")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64(F.lit(7), "word"), blocks).cast("int")
    asked = F.when(F.col("role") == INDEXED, F.array(own)).otherwise(F.sequence(F.lit(0), blocks - 1))
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A number of its own, or adaptive execution would put this little data, and all the work on it, into a task or two.
    return (
        rows.join(crowded, "key", "left").withColumn("block", F.explode(asked)).drop("blocks")
        .repartition(tasks, "side", "length", "key", "block").sortWithinPartitions("side", "length", "key", "block", "role")
    )


class _Batch:
    """Whole shards of one side and length: an index, and the words that ask it."""

    def __init__(self, side: int):
        self.side, self.words, self.counts, self.index = side, [], [], None
        self.asking: list[str] = []

    def indexed(self, words: list[str], counts: list[int]) -> None:
        self.words += words
        self.counts += counts

    def _built(self) -> None:
        order = sorted(range(len(self.words)), key=self.words.__getitem__)
        counts = np.array(self.counts, np.int64)[order]
        words = [self.words[k] for k in order]
        plain = words if self.side == FORWARD else [w[::-1] for w in words]
        self.index, self.plain = FmIndex(words), plain
        # Best first: the largest count, then the smallest word.
        by_word = sorted(range(len(plain)), key=plain.__getitem__)
        place = np.empty(len(plain), np.int64)
        place[by_word] = np.arange(len(plain))
        best = np.lexsort((place, -counts))
        self.counts = counts
        self.rank = np.empty(len(plain), np.int64)
        self.rank[best] = np.arange(len(plain))
        self.best = best

    def answers(self) -> Iterator[pa.RecordBatch]:
        asking, self.asking = self.asking, []
        if not asking or not len(self.words):
            return
        if self.index is None:
            self._built()
        half = [len(w) // 2 if self.side == FORWARD else len(w) - len(w) // 2 for w in asking]
        query, word = self.index.near(asking, half)
        plain = asking if self.side == FORWARD else [w[::-1] for w in asking]
        if self.side == BACKWARD and len(query):
            # Words whose first halves agree too are counted in the forward shards.
            other = [self.plain[w][: len(plain[q]) // 2] != plain[q][: len(plain[q]) // 2] for q, w in zip(query.tolist(), word.tolist())]
            query, word = query[other], word[other]
        if not len(query):
            return
        rows, first, number = np.unique(query, return_index=True, return_counts=True)
        top = self.best[np.minimum.reduceat(self.rank[word], first)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([plain[q] for q in rows]), pa.array(number.astype(np.int64)), pa.array(self.counts[top]), pa.array([self.plain[w] for w in top])],
            names=["word", "n_near", "form_n", "form"],
        )


def _search(index_words: int, questions: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, shard, batch = None, None, None
        for rows in batches:
            side, length, key, block, role = (np.asarray(rows.column(n)) for n in ("side", "length", "key", "block", "role"))
            if not rows.num_rows:
                continue
            words, counts = rows.column("word").to_pylist(), rows.column("n").to_pylist()
            change = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0) | (np.diff(role) != 0) | (np.diff(length) != 0) | (np.diff(side) != 0)) + 1
            for begin, end in zip([0, *change.tolist()], [*change.tolist(), rows.num_rows]):
                own, at = (int(side[begin]), int(length[begin])), (int(key[begin]), int(block[begin]))
                part = [w[::-1] for w in words[begin:end]] if own[0] == BACKWARD else words[begin:end]
                # A new index for another kind, and where a new shard finds this one full or already asked.
                if own != kind or (at != shard and (len(batch.words) >= index_words or batch.index is not None)):
                    if batch:
                        yield from batch.answers()
                    batch = _Batch(own[0])
                kind, shard = own, at
                if role[begin] == INDEXED:
                    batch.indexed(part, counts[begin:end])
                else:
                    batch.asking += part
                    # A shard's indexed words all come before its questions; further shards start a new index.
                    if len(batch.asking) >= questions:
                        yield from batch.answers()
        if batch:
            yield from batch.answers()

    return work


def near_words(words: DataFrame, index_words: int = INDEX_WORDS, questions: int = QUESTIONS) -> DataFrame:
    """(word, n_near, form_n, form) for each word of ``words`` (word, n; distinct) that has near words: how many, and the
    one of largest n, the smallest in code-point order of those that tie."""
    found = _dealt(words, index_words).mapInArrow(_search(index_words, questions), "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("best.minus")).alias("form_n"), F.col("best.form").alias("form")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form) without cycles: the last word of each chain. Words that are only forms have no row."""
    chains = written(forms.select("word", F.col("form").alias("root")), "chains")
    while True:
        further = chains.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if chains.join(further, "root", "left_semi").isEmpty():
            return chains
        chains = written(chains.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "chains")


def spelling_groups(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``words`` (word, n; distinct, of at least five code points).

    A word's form is its near word (one code point inserted, deleted or replaced) of largest n, ties to the smallest
    in code-point order, if that n is at least twice the word's own; else null. root follows the forms to the last.
    """
    near = words.join(near_words(words), "word", "left")
    fits = F.col("form_n") >= FACTOR * F.col("n")
    judged = written(
        near.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("form")).alias("form"),
            F.when(fits, F.col("form_n")).alias("form_n"),
        ),
        "judged",
    )
    last = roots(judged.where("form IS NOT NULL"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``spelling_groups`` of the vocabulary of ``docs``, which is written once. Empty tables and tables without texts have no words."""
    return spelling_groups(written(vocabulary(docs, id_col, text_col), "vocabulary"))
