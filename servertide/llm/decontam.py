"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are lower-cased and runs of anything but letters and digits
become one blank. An occurrence of an item of m characters with at most e edits keeps at
least m - q + 1 - e * q of its q-grams, on diagonals (place in the text minus place in the
item) that lie within e of each other. So the shared q-grams are counted per item in bands
of 2 * (e + 1) diagonals that overlap by half; every such occurrence fills one band to that
number. Bands that reach it are verified by a banded alignment of the whole item with the
text around the band. Nothing that the bound admits is missed.

The budget e is ``EDITS`` of the item's length; q is at most ``GRAM`` and small enough that
the bound is at least 1. Benchmark items are the query set: they are read in blocks of
``BLOCK`` characters, each indexed and sent to the workers; one block is bounded, all of them
grow with the benchmark. Texts are searched whole, in overlapping stretches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDITS = 0.1
GRAM = 8
BLOCK = 1_000_000
#: Characters of a text that are searched at a time.
STRETCH = 65_536
#: Lengths of the q-grams that candidates are held to, and how many times as long as the longest of them a piece of text may be for that.
SHORT_GRAMS = (3, 4, 5)
SHORT = 3
#: Places of q-grams that are looked at without further ado.
FEW = 20_000
#: Cells of the bands that are aligned at a time.
CELLS = 2_000_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS, _SHORT_BITS = 22, 16
MATCHES = "array<struct<item_id:bigint,edits:int,start:int,end:int>>"


@lru_cache(maxsize=1)
def _is_word() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)])


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised text, and the place of each in the text."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case has several characters keeps the first
        low = "".join([c.lower()[0] for c in text])
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = _is_word()[points]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first of a run of others
    places = np.flatnonzero(keep)
    return np.where(word, points, 32)[places].astype(np.uint32), places


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams, built from those of half the length."""
    if len(points) < q:
        return np.zeros(0, np.uint64)
    if q == 1:
        return (points.astype(np.uint64) + np.uint64(1)) * _PRIME
    half = q // 2
    left = grams(points, half)
    right = left if q - half == half else grams(points, q - half)
    n = len(points) - q + 1
    mixed = left[:n] * np.uint64(0xD1342543DE82EF95) + right[half: half + n]
    return mixed ^ (mixed >> np.uint64(29))


class Index:
    """The q-grams of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, points) for i, text in items if len(points := trimmed(normal(text)[0]))]
        self.size = np.array([len(p) for _, p in self.items], np.int64)
        self.budget = (self.size * EDITS).astype(np.int64)
        self.gram = np.minimum(GRAM, self.size // (self.budget + 1))
        self.least = self.size - self.gram + 1 - self.budget * self.gram
        self.reach = int((self.size + 2 * self.budget).max(initial=1)) + 2
        self.tables = []
        for q in np.unique(self.gram):
            rows = [(grams(p, int(q)), k) for k, (_, p) in enumerate(self.items) if self.gram[k] == q]
            hashes = np.concatenate([h for h, _ in rows])
            owner = np.concatenate([np.full(len(h), k) for h, k in rows])
            place = np.concatenate([np.arange(len(h)) for h, _ in rows])
            order = np.argsort(hashes, kind="stable")
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[hashes >> np.uint64(64 - _FILTER_BITS)] = True
            self.tables.append((int(q), hashes[order], owner[order], place[order], seen))
        # Short q-grams of all items one after the other, by which candidates are compared with a small piece of text.
        self.short = []
        for q in SHORT_GRAMS:
            bins = [grams(p, q) >> np.uint64(64 - _SHORT_BITS) for _, p in self.items]
            ends = np.cumsum([len(b) for b in bins], dtype=np.int64)
            self.short.append((q, np.concatenate(bins or [np.zeros(0, np.uint64)]), ends, self.size - q + 1 - self.budget * q))

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, edits, start, end) of the best occurrence of each item in the text."""
        if not text or not self.items:
            return []
        points, places = normal(text)
        best: dict[int, tuple[int, int, int]] = {}
        for at in range(0, max(1, len(points) - self.reach), STRETCH):
            self._stretch(points, at, min(len(points), at + STRETCH + self.reach), best)
        return sorted(
            (self.items[k][0], edits, int(places[start]), int(places[end - 1]) + 1) for k, (edits, start, end) in best.items()
        )

    def _stretch(self, points: np.ndarray, begin: int, end: int, best: dict[int, tuple[int, int, int]], only: np.ndarray | None = None) -> None:
        """Occurrences that lie between ``begin`` and ``end``, of the items marked in ``only``.

        Items may share wording, and a text may repeat it. So the different q-grams of a stretch are
        counted first, each once. If the items that have enough are at many places, they are held to the bounds
        of shorter q-grams, and the halves of a long stretch are searched for the items left; then
        the places of their q-grams are looked at.
        """
        part = points[begin:end]
        found, candidates = [], np.zeros(len(self.items), bool)
        for q, hashes, owner, place, seen in self.tables:
            own = grams(part, q)
            at = np.flatnonzero(seen[own >> np.uint64(64 - _FILTER_BITS)])
            if not len(at):
                continue
            values, gram = np.unique(own[at], return_inverse=True)
            low = np.searchsorted(hashes, values, "left")
            count = np.searchsorted(hashes, values, "right") - low
            hits = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            enough = np.bincount(owner[hits], minlength=len(self.items)) >= self.least
            enough &= self.gram == q
            if only is not None:
                enough &= only
            if enough.any():
                candidates |= enough
                good = enough[owner[hits]]
                found.append((at, gram, np.repeat(np.arange(len(values)), count)[good], owner[hits[good]], place[hits[good]]))
        if not found:
            return
        # Few places are looked at as they are, which gives the same.
        if sum(int(np.bincount(gram)[of].sum()) for _, gram, of, _, _ in found) > FEW:
            candidates = self._alike(part, candidates)
            if not candidates.any():
                return
            reach = int((self.size + 2 * self.budget)[candidates].max()) + 2
            if end - begin > SHORT * reach:
                middle = (begin + end) // 2
                self._stretch(points, begin, middle + reach, best, candidates)
                self._stretch(points, middle, end, best, candidates)
                return
        for at, gram, of, item, spot in found:
            good = candidates[item]
            if not good.any():
                continue
            of, item, spot = of[good], item[good], spot[good]
            order = np.argsort(gram, kind="stable")
            start = np.searchsorted(gram[order], np.arange(gram.max() + 2))
            number = (start[1:] - start[:-1])[of]
            row = np.repeat(np.arange(len(of)), number)
            where = at[order][start[of][row] + np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)]
            item, spot = item[row], spot[row]
            width = self.budget[item] + 1
            # Places of an item start at 0, so diagonals above -reach stay positive.
            band = (where - spot + self.reach) // width
            self._verify(points, begin, item, np.concatenate([band, band - 1]), spot, best)

    def _alike(self, part: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Those of the candidates that share enough of their short q-grams, too, with a piece of text."""
        kept = candidates.copy()
        for q, bins, ends, least in self.short:
            items = np.flatnonzero(kept & (least > 0))
            if not len(items):
                continue
            there = np.zeros(1 << _SHORT_BITS, bool)
            there[grams(part, q) >> np.uint64(64 - _SHORT_BITS)] = True
            sizes = self.size[items] - q + 1
            places = np.repeat(ends[items] - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
            shared = np.add.reduceat(there[bins[places]].astype(np.int64), np.cumsum(sizes) - sizes)
            kept[items[shared < least[items]]] = False
        return kept

    def _verify(self, points, begin, item, bands, spot, best) -> None:
        # Numbered anew, and fields as wide as these hits need: the items of a block share its characters, so a key stays below 2**60.
        own, item = np.unique(item, return_inverse=True)
        item, spot = np.tile(item, 2), np.tile(spot, 2)
        # Each place of the item counts once in a band.
        wide, stride = bands.max() + 2, spot.max() + 1
        key = np.unique((item * wide + (bands + 1)) * stride + spot) // stride
        key, count = np.unique(key, return_counts=True)
        item, band = own[key // wide], key % wide - 1
        full = count >= self.least[item]
        item, band = item[full], band[full]
        first = np.flatnonzero(np.diff(item, prepend=-1))
        aligned = np.ones(len(item), bool)
        for k, begin_at, end_at in zip(item[first].tolist(), first.tolist(), np.append(first[1:], len(item)).tolist()):
            e, pattern = int(self.budget[k]), self.items[k][1]
            # A verbatim copy needs no alignment, and nothing beats it.
            low = max(0, int(band[begin_at]) * (e + 1) - self.reach + begin)
            same = verbatim(pattern, points[low: int(band[end_at - 1] + 2) * (e + 1) - self.reach + begin + len(pattern)])
            if same >= 0:
                best[k] = (0, low + same, low + same + len(pattern))
                aligned[begin_at:end_at] = False
            elif k in best and best[k][0] == 0:
                aligned[begin_at:end_at] = False
        # All bands of one budget together, as many at a time as memory allows.
        for e in np.unique(self.budget[item[aligned]]).tolist():
            rows = np.flatnonzero(aligned & (self.budget[item] == e))
            width = 4 * e + 3
            step = max(1, CELLS // width)
            for at in range(0, len(rows), step):
                some = rows[at: at + step]
                starts = band[some] * (e + 1) - self.reach + begin - e
                edits, ends = align([self.items[k][1] for k in item[some].tolist()], points, starts, width)
                for n in np.flatnonzero(edits <= e).tolist():
                    k = int(item[some[n]])
                    if k in best and edits[n] >= best[k][0]:
                        continue
                    finish, pattern = int(ends[n]), self.items[k][1]
                    _, lengths = align([pattern[::-1]], points[max(0, finish - len(pattern) - e): finish][::-1], np.array([-e]), 2 * e + 1, True)
                    best[k] = (int(edits[n]), max(0, finish - int(lengths[0])), finish)


def align(patterns: list[np.ndarray], text: np.ndarray, starts: np.ndarray, width: int, anchored: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each whole pattern against the text, in a band of ``width`` diagonals from its place in ``starts``.

    Returns the edits and the end in the text of the best occurrence. ``anchored``: the
    occurrence begins at place 0 of the text; otherwise anywhere in the band.
    """
    sizes = np.array([len(p) for p in patterns])
    # Longest first, so that those still to be read are the first rows.
    order = np.argsort(-sizes, kind="stable")
    letters = np.zeros((len(patterns), int(sizes.max())), text.dtype)
    letters[np.arange(letters.shape[1]) < sizes[order][:, None]] = np.concatenate([patterns[k] for k in order])
    far = int(sizes.max()) + len(text) + 1
    diagonals = np.arange(width)
    place = starts[order][:, None] + diagonals  # end in the text before the first character
    inside = (place >= 0) & (place <= len(text))
    cost = np.where(inside, place if anchored else 0, far)
    padded = np.append(text, text.dtype.type(0))
    edits, ends = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
    for at in range(letters.shape[1] + 1):
        live = int(np.searchsorted(-sizes[order], -at, "left"))
        done = order[live: len(cost)]
        if len(done):
            top = cost[live:].argmin(1)
            edits[done], ends[done] = cost[live:][np.arange(len(done)), top], place[live:][np.arange(len(done)), top]
            cost, place = cost[:live], place[:live]
        if not live:
            break
        place = place + 1
        inside = (place >= 0) & (place <= len(text))
        reached = inside & (place >= 1)
        same = padded[np.where(reached, place - 1, len(text))] == letters[:live, at: at + 1]
        step = np.where(reached, cost + ~same, far)
        dropped = np.append(cost[:, 1:], np.full((len(cost), 1), far), axis=1) + 1
        step = np.where(inside, np.minimum(step, dropped), far)
        # Characters of the text that the pattern lacks: along the row.
        cost = np.minimum.accumulate(step - diagonals, axis=1) + diagonals
        cost = np.where(inside, cost, far)
    return edits, ends


def verbatim(pattern: np.ndarray, text: np.ndarray) -> int:
    """Where the pattern first stands in the text as it is, or -1."""
    inner, outer = pattern.tobytes(), text.tobytes()
    at = outer.find(inner)
    while at >= 0 and at % pattern.itemsize:
        at = outer.find(inner, at + 1)
    return at // pattern.itemsize


def trimmed(points: np.ndarray) -> np.ndarray:
    """Without blanks at both ends."""
    inner = np.flatnonzero(points != 32)
    return points[inner[0]: inner[-1] + 1] if len(inner) else points[:0]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    items, letters = [], 0
    for row in benchmark.select(id_col, text_col).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).toLocalIterator():
        if items and letters + len(row[1]) > BLOCK:
            yield items
            items, letters = [], 0
        items.append((row[0], row[1]))
        letters += len(row[1])
    if items:
        yield items


def matches(text: Column, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Column:
    """An array column: benchmark items that occur in the text, with edits, start and end (code points).

    A null or empty text has none. Items without an id, without a text or without a letter
    or digit are not searched; of items that repeat an id each is searched.
    """
    found = []
    for items in _blocks(benchmark, id_col, text_col):
        index = benchmark.sparkSession.sparkContext.broadcast(Index(items))
        found.append(F.udf(lambda t, index=index: index.value.matches(t), MATCHES, useArrow=True)(text))
    return F.concat(*found) if found else F.array().cast(MATCHES)


def contaminations(docs: DataFrame, benchmark: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, start, end) for every benchmark item in every row of ``docs``."""
    return docs.select(F.col(doc_col).alias("doc_id"), F.explode(matches(F.col(text_col), benchmark)).alias("m")).select("doc_id", "m.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item occurs."""
    return docs.withColumn("__found", matches(F.col("text"), benchmark)).where(F.size("__found") == 0).drop("__found")
