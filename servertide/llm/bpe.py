"""BPE encoding and decoding with a word-end vocabulary.

The text goes through the steps that the vocabulary file states: special tokens are cut
out, the rest is brought to NFC and lower-cased, words are found by the file's pattern
(white space, which matches nothing, is dropped), and the UTF-8 bytes of a word become the
symbols of the vocabulary, the last one with the word-end mark.

A word is then a contiguous array of parts with an array of the ranks of adjacent pairs
beside it: find the smallest rank (the leftmost if equal), delete the boundary, refresh the
ranks on both sides; all new words of one length do a step together. That is quadratic in the word, so words over ``LONG`` symbols take a
heap over the same parts, which merges in the same order. Each task remembers the chunks
between white space that it met lately; forgetting them changes no result.

The vocabulary is read on the driver from a path that is a parameter and sent to the
executors once; its size is that of the file (under 2 MB here).
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words with more symbols are merged with a heap.
LONG = 48
#: White-space separated chunks that a task remembers at most, twice.
MEMORY = 60_000
#: Letters whose words are merged together.
LETTERS = 1_000_000
#: Vocabulary files are broadcast; a larger one is refused.
MAX_VOCABULARY_MB = 64

#: Fixed: white space as the vocabulary file's patterns see it.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Python's split() also cuts at these, which are no white space here.
SEPARATORS = re.compile("[\\x1c-\\x1f]")


def byte_symbols() -> list[str]:
    """The visible character of each byte: printable Latin-1 stands for itself, the rest follows from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


@lru_cache(maxsize=2)
def class_of(kind: str) -> str:
    """The characters of a Unicode main category as ranges of a character class."""
    inside = [unicodedata.category(chr(c))[0] == kind for c in range(0x110000)]
    edges = [c for c in range(0x110000) if inside[c] != (c > 0 and inside[c - 1])]
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2]))


class Vocabulary:
    """Ranks, ids and special tokens of a vocabulary file."""

    def __init__(self, content: str):
        data = json.loads(content)
        model = data["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.end = model["end_of_word_suffix"]
        # A pair of parts has the rank of its merge.
        self.ranks = {tuple(m): r for r, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for name, characters in (("\\p{L}", class_of("L")), ("\\p{N}", class_of("N")), ("\\s", SPACE)):
            # Inside brackets the name is replaced, alone it becomes a class of its own.
            pattern = pattern.replace(f"[{name}]", f"[{characters}]").replace(name, characters)
        self.words = re.compile(pattern)
        self.chunks = re.compile(f"[^{SPACE}]+")
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.symbols = byte_symbols()
        size = max(self.tokens) + 1
        lefts, rights, wholes = (np.array(x, np.int64) for x in zip(*((self.ids[a], self.ids[b], self.ids[a + b]) for a, b in model["merges"])))
        order = np.argsort(lefts * size + rights, kind="stable")
        self.size, self.none = size, len(order)
        self.pair_keys, self.pair_ranks, self.wholes = (lefts * size + rights)[order], order.astype(np.int32), wholes.astype(np.int32)
        self.inner = np.array([self.ids[s] for s in self.symbols], np.int32)
        self.last = np.array([self.ids[s + self.end] for s in self.symbols], np.int32)
        self.id_text = {i: str(i) for i in self.tokens}
        self.recent: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Lower case goes letter by letter, so a final sigma is like any other.
        return text.replace("Σ", "σ").lower()

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of adjacent parts; pairs without a merge have the number of merges."""
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), self.none - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], np.int32(self.none))

    def merge_equal(self, words: list[bytes]) -> np.ndarray:
        """Token ids of words of one length, a row each, filled up with -1.

        All words take a step at once: each scans its array of adjacent ranks for the least
        (the leftmost if equal), deletes that boundary and refreshes the ranks beside it.
        """
        n, length = len(words), len(words[0])
        symbols = np.frombuffer(b"".join(words), np.uint8).reshape(n, length)
        parts = np.append(self.inner[symbols[:, :-1]], self.last[symbols[:, -1:]], axis=1)
        done = np.full((n, length), -1, np.int32)
        rows = np.arange(n)
        ranks = self.ranks_of(parts[:, :-1], parts[:, 1:])
        while ranks.shape[1]:
            at = ranks.argmin(1)
            least = ranks[np.arange(len(at)), at]
            over = least == self.none
            if over.any():
                done[rows[over], : parts.shape[1]] = parts[over]
                rows, parts, ranks, at, least = (x[~over] for x in (rows, parts, ranks, at, least))
            every = np.arange(len(at))
            parts[every, at] = self.wholes[least]
            parts = _without(parts, at + 1)
            ranks = _without(ranks, at)
            for place, inside in ((at - 1, at > 0), (at, at < ranks.shape[1])):
                here, column = every[inside], place[inside]
                ranks[here, column] = self.ranks_of(parts[here, column], parts[here, column + 1])
        done[rows, : parts.shape[1]] = parts
        return done

    def merge_words(self, words: set[str]) -> dict[str, list[int]]:
        """Token ids of distinct words."""
        found: dict[str, list[int]] = {}
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            symbols = word.encode("utf-8", "surrogatepass")
            if len(symbols) > LONG:
                parts = [self.symbols[b] for b in symbols]
                parts[-1] += self.end
                found[word] = [self.ids[p] for p in merge_long(parts, self.ranks)]
            else:
                by_length.setdefault(len(symbols), []).append((word, symbols))
        for group in by_length.values():
            for (word, _), row in zip(group, self.merge_equal([s for _, s in group]).tolist()):
                found[word] = row[: row.index(-1)] if row[-1] < 0 else row
        return found

    def learn(self, chunks: set[str]) -> dict[str, tuple[str, str]]:
        """Ids joined by blanks and tokens joined by blanks, for each of the chunks."""
        words = {c: self.words.findall(c) for c in chunks}
        ids = self.merge_words({w for ws in words.values() for w in ws})
        found = {}
        for chunk, ws in words.items():
            own = ids[ws[0]] if len(ws) == 1 else [i for w in ws for i in ids[w]]
            found[chunk] = (" ".join([self.id_text[i] for i in own]), " ".join([self.tokens[i] for i in own]))
        return found

    def chunks_of(self, text: str) -> list[str | tuple[str]]:
        """Chunks between white space, and special tokens as tuples. No word of the pattern holds white space."""
        found: list[str | tuple[str]] = []
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.special:
                found.append((piece,))
            elif piece:
                piece = self.normal(piece)
                found += self.chunks.findall(piece) if SEPARATORS.search(piece) else piece.split()
        return found

    def encoded(self, texts: list[str]) -> list[list[tuple[str, str]]]:
        """(ids, tokens) of the chunks of each text."""
        chunks = [self.chunks_of(t) for t in texts]
        known: dict[str | tuple[str], tuple[str, str]] = {(c,): (str(i), c) for c, i in self.special.items()}
        new = set()
        for chunk in set().union(*chunks) - known.keys():
            entry = self.recent.get(chunk) or self.older.get(chunk)
            if entry:
                known[chunk] = entry
            else:
                new.add(chunk)
        known |= self.learn(new)
        if len(self.recent) >= MEMORY:
            self.older, self.recent = self.recent, {}
        self.recent |= {c: e for c, e in known.items() if isinstance(c, str) and len(c) <= LONG}
        return [[known[c] for c in own] for own in chunks]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks, as a file without a decoder has it; unknown ids are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def _without(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each row without its entry ``at``."""
    keep = np.ones(rows.shape, bool)
    keep[np.arange(len(at)), at] = False
    return rows[keep].reshape(len(at), rows.shape[1] - 1)


def merge_long(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The same merges for a long word: a heap of (rank, position) over linked parts."""
    after = [*range(1, len(parts)), -1]
    before = [*range(-1, len(parts) - 1)]
    open_pairs = [(ranks[pair], i) for i, pair in enumerate(zip(parts, parts[1:])) if pair in ranks]
    heapq.heapify(open_pairs)
    while open_pairs:
        rank, at = heapq.heappop(open_pairs)
        right = after[at]
        # A pair that has changed since is out of date.
        if not parts[at] or right < 0 or ranks.get((parts[at], parts[right])) != rank:
            continue
        parts[at] += parts[right]
        parts[right] = ""
        after[at] = after[right]
        if after[at] >= 0:
            before[after[at]] = at
        for left in (before[at], at):
            if left >= 0 and after[left] >= 0 and (new := ranks.get((parts[left], parts[after[left]]))) is not None:
                heapq.heappush(open_pairs, (new, left))
    return [p for p in parts if p]


def some_at_a_time(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a column (null: empty) in lists of bounded length; a very long text has its own."""
    texts, letters = [], 0
    for value in column:
        text = value.as_py() or ""
        if texts and letters + len(text) > LETTERS:
            yield texts
            texts, letters = [], 0
        texts.append(text)
        letters += len(text)
    if texts:
        yield texts


@lru_cache(maxsize=2)
def _vocabulary(content: str) -> Vocabulary:
    return Vocabulary(content)


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        content = file.read()
    if len(content) > MAX_VOCABULARY_MB * 1_000_000:
        raise ValueError(f"{path} is over {MAX_VOCABULARY_MB} MB; it is sent to every executor")
    return content


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """Whole texts as tokens: (doc_id, n_tokens, ids, ids_sha256, decoded_sha256).

    ``ids`` is an array of token ids (left out if not asked for); the digests are of the
    decimal ids joined by one blank, and of the decoded text. A null or empty text has no
    tokens. Rows are independent: repeated rows give repeated results, and other columns
    are not read.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = [kept.schema["doc_id"], T.StructField("n_tokens", T.LongType())]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def digest(value: str) -> str:
        return hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(content.value)
        gc.disable()  # millions of short-lived strings and no cycles
        try:
            for batch in batches:
                at = 0
                for texts in some_at_a_time(batch.column("text")):
                    counts, arrays, id_digests, text_digests = [], [], [], []
                    for chunks in vocabulary.encoded(texts):
                        joined = " ".join([c[0] for c in chunks])
                        counts.append(joined.count(" ") + 1 if joined else 0)
                        id_digests.append(digest(joined))
                        text_digests.append(digest(" ".join([c[1] for c in chunks])))
                        if ids:
                            arrays.append(np.array(joined.split(), np.int32))
                    columns = [batch.column("doc_id").slice(at, len(texts)), pa.array(counts, pa.int64())]
                    if ids:
                        columns.append(pa.array(arrays, pa.list_(pa.int32())))
                    columns += [pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
                    at += len(texts)
                    yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
        finally:
            # The worker may live on for other work.
            vocabulary.recent, vocabulary.older = {}, {}
            gc.enable()

    return kept.mapInArrow(work, T.StructType(fields))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: the text of its ids. Null ids give a null text."""
    spark: SparkSession = encoded.sparkSession
    content = spark.sparkContext.broadcast(read_vocabulary(path))

    @F.udf("string", useArrow=True)
    def text_of(ids):
        return None if ids is None else _vocabulary(content.value).decode([int(i) for i in ids if i is not None])

    return encoded.withColumn("decoded", text_of(F.col(ids_col)))
