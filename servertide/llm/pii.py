"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Candidates are the matches of strict patterns (the base spans, which always stay) and of
looser ones: e-mail addresses spelt with "at" and "dot", and telephone numbers without a
plus. Labelers of three kinds vote yes (1), no (-1) or nothing (0) on each candidate:
patterns, gazetteers (top-level domains, card issuers, dialling codes, reserved networks)
and the words just before it. Spark counts the vote patterns of all documents; there are at
most 4 * 3**6 of them, whatever the corpus, so the driver's expectation-maximisation of the
labelers' reliabilities (two classes, labelers independent given the class) sees every
candidate. The posteriors train a logistic classifier over the votes and the shape of the
span, again on counts of all candidates; it decides which loose candidates become spans.

The patterns below are matched in time linear in the text: an address is found from its
"@", and a number is only tried where its run of digits begins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servertide.operators.scratch import written

KINDS = ("email", "ip", "card", "phone")
LABELERS = 6
#: Characters before a span in which cue words are looked for.
CONTEXT = 40
ROUNDS = 50
#: Least probability with which a loose candidate becomes a span.
SURE = 0.9

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SPELT_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\s?[\[({]\s?at\s?[\])}]\s?|\sat\s)[A-Za-z0-9-]{1,63}(?:(?:\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s|\.)[A-Za-z0-9-]{1,63}){1,4}", re.I
)
LOCAL_PHONE = re.compile(r"(?<![0-9.+])(?:\([0-9]{2,5}\)[ .-]?|[0-9]{2,5}[ .-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9.])")

# Gazetteers and cue words.
TOP_DOMAINS = frozenset("com org net edu gov int mil info biz io eu de fr es uk us it nl ch at be pt br mx ar ca au jp cn in ru pl se no dk fi ie".split())
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "2221", "23", "24", "25", "26", "27", "6011", "65", "35", "36", "38", "30")
DIALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "86", "91")
CUES = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|reach|correo|contacto|courriel|kontakt)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|server|login|from|adresse|servidor)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|tarjeta|carte|karte|payment)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|tel[eé]fono|t[eé]l[eé]phone|telefon|handy)\b", re.I),
}
AGAINST = re.compile(r"\b(?:version|release|isbn|issn|order|invoice|section|chapter|page|serial|build|rev)\b\W*$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the strict matches, in order."""
    found = [(a, 0, b) for a, b in emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of looser candidates that touch no base span."""
    found = [(m.start(), 0, m.end()) for m in SPELT_EMAIL.finditer(text)]
    found += [(m.start(), 3, m.end()) for m in LOCAL_PHONE.finditer(text) if 7 <= len(_digits(m[0])) <= 15]
    free, at = [], 0
    for span in sorted(found):
        while at < len(base) and base[at][2] <= span[0]:
            at += 1
        if (at == len(base) or base[at][0] >= span[2]) and (not free or free[-1][2] <= span[0]):
            free.append(span)
    return free


def votes(text: str, span: tuple[int, int, int], strict: bool) -> list[int]:
    """The labelers' votes on a candidate."""
    start, kind, end = span
    own, before = text[start:end], text[max(0, start - CONTEXT): start]
    digits = _digits(own)
    pattern = 1 if strict else 0
    if kind == 0:
        last = re.split(r"[^A-Za-z0-9]+", own.strip())[-1].lower()
        gazetteer = 1 if last in TOP_DOMAINS else -1
        shape = 1 if strict or re.search(r"[\[({]\s?(?:at|dot)", own, re.I) else -1
    elif kind == 1:
        first = int(own.split(".")[0][-3:])
        gazetteer = -1 if first in (0, 255) or first >= 240 else 1
        shape = -1 if any(len(p) > 1 and p[0] == "0" for p in own.split(".")) else 1
    elif kind == 2:
        gazetteer = 1 if digits.startswith(ISSUERS) else -1
        shape = 1 if len(digits) in (15, 16) else 0
    else:
        gazetteer = (1 if digits.startswith(DIALLING) else -1) if strict else 0
        shape = 1 if strict or own[0] == "(" else (-1 if re.fullmatch(r"(?:19|20)[0-9]{2}[ .-][0-9]{2}[ .-][0-9]{2}", own) else 0)
    cue = 1 if CUES[KINDS[kind]].search(before) else 0
    against = -1 if AGAINST.search(before) else 0
    glued = -1 if (before[-1:].isalnum() or text[end: end + 1].isalnum()) else 0
    return [pattern, gazetteer, shape, cue, against, glued]


def code(kind: int, cast: list[int]) -> int:
    """A kind and its votes as one number."""
    number = kind
    for v in cast:
        number = number * 3 + v + 1
    return number


def decode(number: int) -> tuple[int, list[int]]:
    cast = []
    for _ in range(LABELERS):
        number, v = divmod(number, 3)
        cast.append(v - 1)
    return number, cast[::-1]


def weigh(counts: dict[int, int]) -> tuple[dict[int, float], np.ndarray]:
    """EM over vote patterns: the probability that a candidate of each pattern is personal data.

    Returns it by pattern, and the labelers' reliabilities: (class, labeler, vote) probabilities.
    """
    if not counts:
        return {}, np.zeros((2, LABELERS, 3))
    patterns = sorted(counts)
    cast = np.array([decode(p)[1] for p in patterns]) + 1
    weight = np.array([counts[p] for p in patterns], float)
    truth = 1 / (1 + np.exp(-(cast - 1).sum(1)))  # the votes' majority to begin with
    for _ in range(ROUNDS):
        prior = np.clip((weight * truth).sum() / weight.sum(), 0.01, 0.99)
        table = np.ones((2, LABELERS, 3))  # one vote of each sort for each labeler and class
        for c, share in enumerate((1 - truth, truth)):
            for k in range(LABELERS):
                table[c, k] += np.bincount(cast[:, k], weight * share, 3)
        # A labeler's yes counts for yes: without this the classes may change places.
        table[1, :, 2] += 1
        table[0, :, 0] += 1
        table /= table.sum(2, keepdims=True)
        logs = np.log(table)
        score = np.stack([logs[c][np.arange(LABELERS), cast].sum(1) for c in range(2)])
        score += np.log([[1 - prior], [prior]])
        truth = 1 / (1 + np.exp(score[0] - score[1]))
    return dict(zip(patterns, truth.tolist())), table


def _features(kind: np.ndarray, cast: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Votes as yes and no, kinds, and the length of the span in steps."""
    return np.hstack([cast == 1, cast == -1, kind[:, None] == np.arange(len(KINDS)), size[:, None] >= np.array([8, 12, 16, 24]), np.ones((len(kind), 1), bool)]).astype(float)


def fit_classifier(counts: dict[tuple[int, int], int], truth: dict[int, float], rounds: int = 400, rate: float = 0.5) -> dict[tuple[int, int], float]:
    """Logistic regression on (vote pattern, size step) counts with EM's posteriors; the probability of each such candidate."""
    if not counts:
        return {}
    keys = sorted(counts)
    decoded = [decode(p) for p, _ in keys]
    x = _features(np.array([k for k, _ in decoded]), np.array([v for _, v in decoded]), np.array([s for _, s in keys]))
    y, weight = np.array([truth[p] for p, _ in keys]), np.array([counts[k] for k in keys], float)
    # Strict matches outnumber loose candidates; both sorts weigh the same in the fit.
    strict = np.array([v[0] == 1 for _, v in decoded])
    for sort in (strict, ~strict):
        if sort.any():
            weight[sort] /= weight[sort].sum()
    weight /= weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        w -= rate * (x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - y)) + 1e-4 * w)
    return dict(zip(keys, (1 / (1 + np.exp(-x @ w))).tolist()))


def _size_step(start: int, end: int) -> int:
    return next((s for s in (24, 16, 12, 8) if end - start >= s), 0)


SPAN = "struct<start:int,kind:int,end:int,strict:boolean,votes:int,size:int>"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("strict", pa.bool_()), ("votes", pa.int32()), ("size", pa.int32())]))
    for batch in batches:
        rows = []
        for value in batch.column("text"):
            text = value.as_py() or ""
            base = base_spans(text)
            loose = loose_spans(text, base)
            rows.append([
                {"start": s[0], "kind": s[1], "end": s[2], "strict": strict, "votes": code(s[1], votes(text, s, strict)), "size": _size_step(s[0], s[2])}
                for s, strict in sorted([*((s, True) for s in base), *((s, False) for s in loose)])
            ])
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, kind)], names=["id", "spans"])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for every row of ``docs``: spans is an array of (start, kind, end, strict, votes, size) in order.

    ``strict`` spans are the base ones. A null or empty text has no spans. Repeated rows give
    repeated results and count as often; other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.mapInArrow(_found, f"id {texts.schema['id'].dataType.simpleString()}, spans array<{SPAN}>")
    found = written(found, "candidates")
    counted = found.select(F.explode("spans").alias("s")).groupBy("s.votes", "s.size").count().collect()  # at most 5 * 4 * 3**6 rows
    by_shape = {(r[0], r[1]): r[2] for r in counted}
    by_votes: dict[int, int] = {}
    for (pattern, _), n in by_shape.items():
        by_votes[pattern] = by_votes.get(pattern, 0) + n
    truth, _ = weigh(by_votes)
    sure = [f"{p}:{s}" for (p, s), x in sorted(fit_classifier(by_shape, truth).items()) if x >= SURE and decode(p)[1][0] != 1]
    accepted = F.array(*map(F.lit, sure)) if sure else F.array().cast("array<string>")
    kept = F.filter("spans", lambda s: s["strict"] | F.array_contains(accepted, F.concat_ws(":", s["votes"], s["size"])))
    return found.select(F.col("id").alias("doc_id"), kept.alias("spans"))
