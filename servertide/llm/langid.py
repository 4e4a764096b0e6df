"""Language ID with a byte convolutional network, trained and applied in numpy.

A text is lower-cased; ASCII characters other than letters become blanks, runs of blanks
become one, and the UTF-8 bytes are cut into windows of a fixed length that overlap so that
every run of bytes a filter can see lies in a window. The network: filters of widths 2, 3
and 4 over bytes, the maximum of each over a window, a rectifier, and a softmax over the
languages. A text's score of a language is the mean over its windows.

Training: Adam on the cross-entropy of windows from a bounded sample, at most ``PER_LANGUAGE``
texts per language with the smallest hashes and ``SAMPLE`` in all, of each ``PIECES`` runs of
as many characters as a window has bytes, all of whose windows are learnt. Documents whose
crc32 of the id leaves ``HELD_OUT`` by ``FOLDS`` are never learnt from.

The sample: the rows of a language are counted, and only rows whose hash lies in the lowest
share that holds about ``SPARE * PER_LANGUAGE`` of them are ranked, by ids alone, so what a
task ranks does not grow with the corpus. The texts of the chosen rows are fetched afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
PER_LANGUAGE, SAMPLE, PIECES, SPARE = 400, 8000, 2, 2
FOLDS, HELD_OUT = 4, 2
EPOCHS, BATCH, RATE = 8, 64, 0.01
#: Windows that a worker holds as matrices at a time.
WINDOWS_AT_A_TIME = 512
#: Least score of the language that the corpus keeps.
SURE = 0.35

_TO_BLANK = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def normal(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_TO_BLANK).split())


def windows(data: bytes) -> np.ndarray:
    """Rows of WINDOW bytes, the last one filled up with zeros."""
    step = WINDOW - max(WIDTHS) + 1
    count = max(1, -(-(len(data) - max(WIDTHS) + 1) // step))
    padded = np.zeros((count - 1) * step + WINDOW, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::step]


class Network:
    """Filter weights per place and byte, and the softmax layer."""

    def __init__(self, languages: list[str], seed: int = 7):
        random = np.random.default_rng(seed)
        self.languages = languages
        self.filters = {w: random.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = random.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.base = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.filters.values(), self.bias, self.out, self.base]

    def responses(self, rows: np.ndarray, width: int) -> np.ndarray:
        """Filter values at every place: (window, place, filter)."""
        weights, places = self.filters[width], rows.shape[1] - width + 1
        total = weights[0][rows[:, :places]]
        for k in range(1, width):
            total += weights[k][rows[:, k: places + k]]
        return total

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        scores = np.maximum(pooled + self.bias, 0) @ self.out + self.base
        scores = np.exp(scores - scores.max(1, keepdims=True))
        return scores / scores.sum(1, keepdims=True)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        pooled = np.concatenate([self.responses(rows, w).max(1) for w in WIDTHS], axis=1)
        return self.softmax(pooled)

    def gradients(self, rows: np.ndarray, truth: np.ndarray) -> list[np.ndarray]:
        n = len(rows)
        values = {w: self.responses(rows, w) for w in WIDTHS}
        places = {w: v.argmax(1) for w, v in values.items()}
        pooled = np.concatenate([np.take_along_axis(values[w], places[w][:, None, :], 1)[:, 0] for w in WIDTHS], axis=1)
        hidden = np.maximum(pooled + self.bias, 0)
        error = self.softmax(pooled)
        error[np.arange(n), truth] -= 1
        error /= n
        back = (error @ self.out.T) * (hidden > 0)
        steps = []
        for at, w in enumerate(WIDTHS):
            own = back[:, at * FILTERS: (at + 1) * FILTERS]
            step = np.zeros_like(self.filters[w])
            for k in range(w):
                seen = np.take_along_axis(rows, places[w] + k, 1)
                np.add.at(step[k], (seen, np.arange(FILTERS)[None, :]), own)
            steps.append(step)
        return [*steps, back.sum(0), hidden.T @ error, error.sum(0)]

    def fit(self, rows: np.ndarray, truth: np.ndarray, seed: int = 11) -> None:
        random = np.random.default_rng(seed)
        means = [np.zeros_like(p) for p in self.parameters()]
        squares = [np.zeros_like(p) for p in self.parameters()]
        turn = 0
        for _ in range(EPOCHS):
            order = random.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                turn += 1
                part = order[at: at + BATCH]
                for p, g, m, s in zip(self.parameters(), self.gradients(rows[part], truth[part]), means, squares):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    p -= RATE * (m / (1 - 0.9**turn)) / (np.sqrt(s / (1 - 0.999**turn)) + 1e-8)


class Compiled:
    """The network for prediction: bytes as a few classes, filter weights as tables over pairs of classes."""

    def __init__(self, network: Network, seen: np.ndarray):
        self.network = network
        # Bytes that training never saw act alike only if their weights do, so they keep classes of their own rank 0.
        self.classes = np.zeros(256, np.int32)
        kept = np.union1d([0, 32], seen)
        self.classes[kept] = np.arange(1, len(kept) + 1)
        self.n = len(kept) + 1
        first = np.concatenate([[1], kept])  # class 0: an unseen byte, by the untrained weights of one such byte
        weights = {w: f[:, first] for w, f in network.filters.items()}
        self.tables = {
            w: [self._pair(f, k) if k + 1 < w else f[k] for k in range(0, w, 2)] for w, f in weights.items()
        }

    def _pair(self, weights: np.ndarray, k: int) -> np.ndarray:
        return (weights[k][:, None, :] + weights[k + 1][None, :, :]).reshape(self.n * self.n, FILTERS)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        one = self.classes[rows]
        two = one[:, :-1] * self.n + one[:, 1:]
        pooled = []
        for w in WIDTHS:
            places, total = WINDOW - w + 1, None
            for k, table in zip(range(0, w, 2), self.tables[w]):
                part = table.take((two if k + 1 < w else one)[:, k: places + k], axis=0)
                total = part if total is None else np.add(total, part, out=total)
            pooled.append(total.max(1))
        return self.network.softmax(np.concatenate(pooled, axis=1))


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[Row]:
    """Rows (lang, pieces) to learn from, at most SAMPLE; a repeated row counts once."""
    pieces = [
        F.substring(
            F.col("text"),
            (F.pmod(F.xxhash64(F.lit(k), "id"), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1) + 1).cast("int"),
            F.lit(WINDOW),
        )
        for k in range(PIECES)
    ]
    open_rows = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
        .where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull())
        .where(F.crc32(F.col("id").cast("string")) % FOLDS != HELD_OUT)
        .withColumn("order", F.xxhash64("id", "text"))
    )
    row = ["id", "lang", "order"]
    counts = open_rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE)
    low = (F.col("order") / 2.0**64 + 0.5) * F.col("n") < SPARE * PER_LANGUAGE
    by_hash = Window.partitionBy("lang").orderBy("order", "id")
    chosen = (
        open_rows.select(*row).join(F.broadcast(counts), "lang").where(low).select(*row).distinct()
        .withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= PER_LANGUAGE)
        .orderBy("rank", "lang").limit(SAMPLE)
    )
    texts = open_rows.join(F.broadcast(chosen), row).groupBy("rank", *row).agg(F.min(F.array(*pieces)).alias("pieces"))
    return texts.orderBy("rank", "lang").select("lang", "pieces").collect()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Compiled | None:
    """A network fitted on the sample, or None if no document has a language."""
    sample = _sample(docs, id_col, text_col, lang_col)
    if not sample:
        return None
    languages = sorted({r.lang for r in sample})
    rows, truth = [], []
    for r in sample:
        for piece in dict.fromkeys(r.pieces):
            data = normal(piece)
            if data:
                own = windows(data)
                rows.append(own)
                truth += [languages.index(r.lang)] * len(own)
    network = Network(languages)
    if rows:
        matrix = np.concatenate(rows)
        network.fit(matrix, np.array(truth))
        return Compiled(network, np.unique(matrix))
    return Compiled(network, np.array([], int))


def predict_texts(model: Compiled | None, texts: pd.Series) -> pd.DataFrame:
    """lang_pred and score of each text; a text without a letter is unknown with score 0."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model is None:
        return pd.DataFrame({"lang_pred": names, "score": scores})
    sums = np.zeros((len(texts), len(model.network.languages)))
    counts = np.zeros(len(texts))
    waiting: list[tuple[int, np.ndarray]] = []

    def settle() -> None:
        if waiting:
            owners = np.repeat([i for i, _ in waiting], [len(w) for _, w in waiting])
            found = model.predict(np.concatenate([w for _, w in waiting]))
            np.add.at(sums, owners, found)
            np.add.at(counts, owners, 1)
            waiting.clear()

    held = 0
    for at, text in enumerate(texts):
        if text is None or not any(c.isalpha() for c in text):
            continue
        own = windows(normal(text))
        for k in range(0, len(own), WINDOWS_AT_A_TIME):
            part = own[k: k + WINDOWS_AT_A_TIME]
            waiting.append((at, part))
            held += len(part)
            if held >= WINDOWS_AT_A_TIME:
                settle()
                held = 0
    settle()
    known = counts > 0
    means = sums[known] / counts[known, None]
    best = means.argmax(1)
    scores[known] = np.clip(means[np.arange(len(best)), best], 0, 1)
    for at, b in zip(np.flatnonzero(known), best):
        names[at] = model.network.languages[b]
    return pd.DataFrame({"lang_pred": names, "score": scores})


def predicted(docs: DataFrame, model: Compiled | None, text: Column) -> Column:
    """A struct column (lang_pred, score); the model (a few hundred kB) goes to each worker once."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def of_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield predict_texts(sent.value, batch)

    of_batches.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(of_batches, "lang_pred string, score double")(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``.

    A null text or one without a letter is ``und`` with score 0, and so is every text if no
    row may be learnt from. Rows without an id are not held out and not learnt from.
    Repeated rows give repeated results; other columns are not read.
    """
    model = train(docs, id_col, text_col, lang_col)
    found = docs.select(F.col(id_col).alias("doc_id"), predicted(docs, model, F.col(text_col)).alias("found"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "found.lang_pred", "found.score")


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in a language that the network knows with a score of at least SURE."""
    model = train(docs)
    found = docs.withColumn("__found", predicted(docs, model, F.col("text")))
    return found.where((F.col("__found.lang_pred") != UNKNOWN) & (F.col("__found.score") >= SURE)).drop("__found")
