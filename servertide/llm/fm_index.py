"""A bidirectional FM-index over a delimited vocabulary, searched by schemes with one error.

The indexed text is ``$word$word…$`` with the words in sorted order and ``$`` below all
letters. A pattern's occurrences are an interval of suffix ranks in the text and one in the
reversed text, of the same size; both are kept while the pattern grows at either end. The
rank of ``$word$`` among the suffixes that begin with ``$`` is the word's number, so no
positions are stored.

Search scheme: a query's first half is matched exactly, leftwards from its last letter to
the delimiter before it; then the search turns round and extends rightwards across the second
half, allowing one inserted, deleted or replaced letter, to the delimiter behind it. With
words and queries reversed the same search matches the second half and allows the error in
the first. All queries advance together, a letter at a time.
"""

from __future__ import annotations

import numpy as np

DELIMITER = 0
#: Letters packed into the first sort key, of 8 bits each; codes above 255 take the slow start.
PACKED = 8
QUERIES_AT_A_TIME = 20_000


def coded(words: list[str], letters: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of letter codes (1 …; ``extra`` for a letter not among ``letters``; filled up with -1), and their lengths."""
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    at = np.searchsorted(letters, points)
    known = (at < len(letters)) & (letters[np.minimum(at, len(letters) - 1)] == points)
    codes = np.full((len(words), int(sizes.max(initial=0)) + 1), -1, np.int64)
    codes[np.arange(codes.shape[1]) < sizes[:, None]] = np.where(known, at + 1, extra)
    return codes, sizes


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start of every suffix, in sorted order, by doubling of sorted prefixes."""
    n = len(text)
    step = PACKED if text.max(initial=0) < 255 else 1
    key = np.zeros(n, np.uint64)
    for k in range(step):
        # Letters are shifted by one, so that the end of the text is below all of them.
        key = key << np.uint64(8 if step > 1 else 32)
        key[: max(0, n - k)] |= text[k:].astype(np.uint64) + np.uint64(1)
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        later = np.zeros(n, np.int64)
        later[: max(0, n - step)] = rank[step:] + 1
        key = (rank * (n + 1) + later).astype(np.uint64)
        step *= 2


class Ranks:
    """How often each letter occurs before a place of a Burrows-Wheeler transform."""

    def __init__(self, text: np.ndarray, letters: int):
        order = suffix_order(text)
        last = text[order - 1]
        self.size, self.letters = len(text), letters
        # One more column for letters that the text lacks.
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=letters))])
        words = len(text) // 64 + 1
        self.bits = np.zeros((words, letters + 1), np.uint64)
        padded = np.full(words * 64, letters + 1, np.int64)
        padded[: len(last)] = last
        for c in range(letters):
            self.bits[:, c] = np.packbits(padded == c, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.bits).astype(np.int32)
        self.before = np.zeros((words, letters + 1), np.int32)
        np.cumsum(counts[:-1], axis=0, out=self.before[1:])
        # The same for all letters below a letter.
        self.bits_below, self.before_below = np.zeros_like(self.bits), np.zeros_like(self.before)
        np.bitwise_or.accumulate(self.bits[:, :-1], axis=1, out=self.bits_below[:, 1:])
        np.cumsum(self.before[:, :-1], axis=1, out=self.before_below[:, 1:])

    def of(self, letter: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often ``letter``, and how often any letter below it, occurs before ``place``."""
        at = (place >> 6) * (self.letters + 1) + letter
        mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        own = self.before.ravel()[at] + np.bitwise_count(self.bits.ravel()[at] & mask).astype(np.int64)
        below = self.before_below.ravel()[at] + np.bitwise_count(self.bits_below.ravel()[at] & mask).astype(np.int64)
        return own, below

    def of_all(self, place: np.ndarray) -> np.ndarray:
        """How often each letter occurs before ``place``, a row for each place."""
        word, mask = place >> 6, (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.bits[word] & mask[:, None]).astype(np.int64)


class Intervals:
    """Occurrences of patterns: suffix ranks from ``low`` in the text and from ``back`` in the reversed text."""

    def __init__(self, low: np.ndarray, back: np.ndarray, size: np.ndarray):
        self.low, self.back, self.size = low, back, size

    def __getitem__(self, at) -> Intervals:
        return Intervals(self.low[at], self.back[at], self.size[at])

    def turned(self) -> Intervals:
        return Intervals(self.back, self.low, self.size)

    @staticmethod
    def joined(parts: list[Intervals]) -> Intervals:
        return Intervals(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("low", "back", "size")))


class FmIndex:
    """Distinct sorted words, found by ``near`` from words one edit away."""

    def __init__(self, words: list[str]):
        self.words = words
        points = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32))
        self.alphabet = points
        codes, _ = coded(words, points, 0)
        # Each row ends with a -1, which becomes the delimiter behind the word.
        rows = np.concatenate([np.full((len(words), 1), DELIMITER), codes], axis=1)
        ends = np.array([len(w) for w in words]) + 1
        text = np.append(rows[np.arange(rows.shape[1]) < ends[:, None]], DELIMITER)
        self.letters = len(points) + 1
        self.forward, self.backward = Ranks(text, self.letters), Ranks(text[::-1].copy(), self.letters)

    def all(self, n: int) -> Intervals:
        zero = np.zeros(n, np.int64)
        return Intervals(zero, zero, np.full(n, self.forward.size, np.int64))

    @staticmethod
    def _before(ranks: Ranks, found: Intervals, letter: np.ndarray) -> Intervals:
        """``found`` with ``letter`` before it, where ``ranks`` are those of the text; ``letter`` may be a number for all."""
        low, below_low = ranks.of(letter, found.low)
        high, below_high = ranks.of(letter, found.low + found.size)
        return Intervals(ranks.first[letter] + low, found.back + below_high - below_low, high - low)

    def leftwards(self, found: Intervals, letter) -> Intervals:
        return self._before(self.forward, found, letter)

    def rightwards(self, found: Intervals, letter) -> Intervals:
        return self._before(self.backward, found.turned(), letter).turned()

    def branches(self, found: Intervals) -> tuple[np.ndarray, np.ndarray, Intervals]:
        """All extensions to the right by a letter other than the delimiter: (row of ``found``, letter, interval)."""
        # Queries with a common beginning are at the same interval, which is extended once.
        _, first, node = np.unique(found.back * (self.forward.size + 1) + found.size, return_index=True, return_inverse=True)
        nodes = found[first]
        start = self.backward.of_all(nodes.back)
        count = self.backward.of_all(nodes.back + nodes.size) - start
        smaller = np.cumsum(count, axis=1) - count
        where, letter = np.nonzero(count[:, 1: self.letters])
        letter += 1
        children = Intervals(nodes.low[where] + smaller[where, letter], self.backward.first[letter] + start[where, letter], count[where, letter])
        begin = np.searchsorted(where, np.arange(len(first) + 1))
        number = (begin[1:] - begin[:-1])[node]
        row = np.repeat(np.arange(len(node)), number)
        child = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number) + begin[:-1][node][row]
        return row, letter[child], children[child]

    def near(self, queries: list[str], exact: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers: words one edit away whose first ``exact`` letters are the query's; each pair once."""
        found = [self._near(queries[k: k + QUERIES_AT_A_TIME], exact[k: k + QUERIES_AT_A_TIME], k) for k in range(0, len(queries), QUERIES_AT_A_TIME)]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        query, word = np.divmod(np.unique(np.concatenate(found)), len(self.words))
        return query, word

    def _near(self, queries: list[str], exact: list[int], offset: int) -> np.ndarray:
        codes, sizes = coded(queries, self.alphabet, self.letters)
        half = np.array(exact, np.int64)
        query = np.flatnonzero(half <= sizes)
        state = self.all(len(query))
        for k in range(int(half.max(initial=0))):
            moving = half[query] > k
            grown = self.leftwards(state[moving], codes[query[moving], half[query[moving]] - 1 - k])
            state = Intervals.joined([state[~moving], grown])
            query = np.concatenate([query[~moving], query[moving]])
            query, state = query[state.size > 0], state[state.size > 0]
        state = self.leftwards(state, DELIMITER)
        query, state = query[state.size > 0], state[state.size > 0]
        place = half[query]
        erring = (np.zeros(0, np.int64), np.zeros(0, np.int64), self.all(0))
        pairs = [np.zeros(0, np.int64)]
        while len(query) or len(erring[0]):
            # States with their error behind them take the query's next letter, or its end.
            e_query, e_place, e_state = erring
            ended = e_place == sizes[e_query]
            e_state = self.rightwards(e_state, np.where(ended, DELIMITER, codes[e_query, e_place]))
            alive = e_state.size > 0
            done = alive & ended
            pairs.append((e_query[done] + offset) * len(self.words) + e_state.low[done] - 1)
            alive &= ~ended
            later = [(e_query[alive], e_place[alive] + 1, e_state[alive])]
            # States without an error: every error at this place, else the next letter. Of equal letters in a row the last
            # is deleted, and a letter is inserted behind its equals, so that few results come twice.
            row, letter, child = self.branches(state)
            own = codes[query[row], place[row]]
            other = letter != own
            inside = other & (place[row] < sizes[query[row]])
            later.append((query[row[inside]], place[row[inside]] + 1, child[inside]))
            later.append((query[row[other]], place[row[other]], child[other]))
            open_ = place < sizes[query]
            following = codes[query, np.minimum(place + 1, sizes[query])]
            last = open_ & (following != codes[query, place])
            later.append((query[last], place[last] + 1, state[last]))
            erring = tuple(np.concatenate([part[k] for part in later]) for k in range(2)) + (Intervals.joined([part[2] for part in later]),)
            query, place, state = query[open_], place[open_], state[open_]
            state = self.rightwards(state, codes[query, place])
            place = place + 1
            alive = state.size > 0
            query, place, state = query[alive], place[alive], state[alive]
        return np.concatenate(pairs)
