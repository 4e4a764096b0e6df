"""Conversation structure repair: the cheapest edits that make the roles legal, by weighted interval parsing.

Legal are role initials ``(s?(ua)+)?``. The repair grammar is in Chomsky normal form: its
nonterminals [p q] stand for the role sequences that lead from state p to state q (nothing
yet, after s, after u, after a), with rules [p q] -> [p r] [r q] and [p q] -> row kept,
reroled or deleted. A cell holds the least (cost, audit) of each nonterminal over a span of
rows. Inserted turns belong to no row; their closure (the cheapest insertions from any state
to any other) is multiplied into the cells of single rows, on both sides.

Cells are combined bottom-up by span length: one row, then two, four, eight … Since every
derivation passes some state at every place, each split of a span gives the same cell, so
one split is taken and n rows need n - 1 combinations. Of two audits of a span with equal
cost neither is a prefix of the other, so the least audit of a span is made of least audits.

Scale: the rows are sorted by conversation and turn over all tasks by range, so a long
conversation spreads over many tasks; each reduces its rows to segments of bounded length, with
one cell each. The cells of a conversation are combined in order, and its edits go back to the
rows as one piece of audit a segment. Only ids, roles, hashes and flags are sorted for the
parse; texts are shuffled once, to the tasks that write the repaired rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servertide.operators.scratch import written

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. A conversation may end in 0 or 3.
STEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
STATES = range(4)
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Rows of a segment at most.
SEGMENT = 32_768
#: Fixed: the ASCII white space of the definition.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

Cell = dict[tuple[int, int], tuple[int, str]]


def least(options) -> Cell:
    cell: Cell = {}
    for at, value in options:
        if at not in cell or value < cell[at]:
            cell[at] = value
    return cell


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two spans side by side."""
    cell: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for q in STATES:
            after = right.get((r, q))
            if after is None:
                continue
            total, best = cost + after[0], cell.get((p, q))
            if best is None or total < best[0] or (total == best[0] and audit + after[1] < best[1]):
                cell[p, q] = (total, audit + after[1])
    return cell


@lru_cache(maxsize=None)
def insertions() -> Cell:
    """Closure of the insertions: nothing, or the cheapest turns that lead from one state to another."""
    one = [((p, q), (COST[INSERT], INSERT)) for (initial, p), q in STEPS.items() if initial in ROLES]
    cell = least([*(((p, p), (0, "")) for p in STATES), *one])
    while (longer := least([*cell.items(), *combined(cell, cell).items()])) != cell:
        cell = longer
    return cell


@lru_cache(maxsize=None)
def row_cell(initial: str, fault: int) -> Cell:
    """The cell of one row, insertions before and behind it included."""
    options = [((p, p), (COST[DELETE], DELETE)) for p in STATES]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        for (step, p), q in STEPS.items():
            if step == initial:
                options.append(((p, q), (COST[KEEP] + more, KEEP)))
            if step in ROLES:
                options.append(((p, q), (COST[REROLE] + more, REROLE)))
    return combined(combined(insertions(), least(options)), insertions())


class Spans:
    """Cells of a growing sequence of rows; two neighbours of one length become one of twice the length at once."""

    def __init__(self):
        self.stack: list[tuple[int, Cell]] = []

    def add(self, cell: Cell) -> None:
        length = 1
        while self.stack and self.stack[-1][0] == length:
            cell = combined(self.stack.pop()[1], cell)
            length *= 2
        self.stack.append((length, cell))

    def cell(self) -> Cell:
        cell = self.stack[-1][1]
        for _, earlier in reversed(self.stack[:-1]):
            cell = combined(earlier, cell)
        return cell


# --- Rows and their faults ---


def damaged(rows: DataFrame, every: int = 20) -> DataFrame:
    """Rows (conv_id, turn, role, text), some spoilt by crc32(``conv_id:turn``) % ``every``: 0 dropped, 1 emptied,
    2 without ``.!?``, 3 repeated, 4 given the role user. A null counts as one space, also in that key; conv_id
    and turn stay null."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    by = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % every
    text = blank("text")
    return (
        rows.select("conv_id", "turn", blank("role").alias("role"), text.alias("text"), by.alias("by")).where("by <> 0")
        .select(
            "conv_id", "turn", F.when(F.col("by") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("by") == 1, "").when(F.col("by") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("by") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


ORDER = ("turn", "role", "hash", "row")


def _prepared(rows: DataFrame) -> DataFrame:
    """Rows with a hash of their text and a number of their own, written, so that the numbers stay."""
    return written(
        rows.select(
            F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
            F.coalesce("text", F.lit(" ")).alias("text"),
        ).withColumn("hash", F.md5("text")).withColumn("row", F.monotonically_increasing_id()),
        "turns",
    )


def _faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, hash, row, initial, fault), without texts."""
    bare = F.btrim("text", F.lit(BLANKS))
    own = F.when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    # The length of the role keeps role and text apart; a row without a conversation has a mark that no number has.
    said = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit("-")), F.lit(":"), F.length("role"), F.lit(":"), "role", F.col("hash"))
    light = rows.select("conv", "turn", "role", "hash", "row", own.alias("own"), F.unhex(F.md5(F.concat(F.col("conv").isNull().cast("string"), said))).alias("said"))
    first = light.groupBy("said").agg(F.min(F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "row")).alias("first"))
    again = F.col("first.row") != F.col("row")
    fault = F.when(F.col("own") == BLANK, BLANK).when(again, DUPLICATE).otherwise(F.col("own"))
    return light.join(first, "said").select("conv", *ORDER, F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


# --- Segments ---

_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_KINDS = {
    "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(),
    "array<struct<p:int,q:int,cost:bigint,audit:string>>": pa.list_(
        pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    ),
    "array<struct<turn:bigint,role:string,hash:string,row:bigint,state:int,audit:string>>": pa.list_(
        pa.struct([("turn", pa.int64()), ("role", pa.string()), ("hash", pa.string()), ("row", pa.int64()), ("state", pa.int32()), ("audit", pa.string())])
    ),
}
_CELL, _PIECES = list(_KINDS)[3:]
_KEY = {"turn": "bigint", "role": "string", "hash": "string", "row": "bigint"}
_SEGMENT = {
    "part": "int", "number": "int", **_KEY, "first": "string", "last": "string", "low": "bigint", "high": "bigint",
    **dict.fromkeys(_COUNTS, "bigint"), "cell": _CELL,
}
_CONVERSATION = {**dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), "bigint"), "audit": "string", "pieces": _PIECES}
_TURN = {"place": "bigint", "role": "string", "text": "string", "edit": "string"}
_DIGEST = {"sha": "string"}


def _mapped(dealt: DataFrame, fields: dict[str, str], work) -> DataFrame:
    """``work(batches)`` gives lists of dicts with ``conv`` and ``fields``."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal schema
            for batch in batches:
                schema = pa.schema([("conv", batch.schema.field("conv").type), *((n, _KINDS[k]) for n, k in fields.items())])
                yield batch

        for rows in work(seen()):
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    conv = dealt.schema["conv"].dataType.simpleString()
    return dealt.mapInArrow(batches_of, ", ".join([f"conv {conv}", *(f"{n} {k}" for n, k in fields.items())]))


class _Segment:
    def __init__(self, key: dict, number: int):
        self.key, self.number, self.size = key, number, 0
        self.spans, self.counts = Spans(), dict.fromkeys(_COUNTS, 0)
        self.first = self.last = None
        self.low = self.high = None

    def add(self, turn, initial, fault) -> None:
        self.size += 1
        self.spans.add(row_cell(initial, fault))
        if fault:
            self.counts[("", "blank", "duplicate", "truncated")[fault]] += 1
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL_PAIRS:
            self.counts["illegal"] += 1
        self.last = initial
        if turn is not None and turn != self.high:
            self.counts["turns"] += 1
            self.low = turn if self.low is None else self.low
            self.high = turn

    def row(self) -> dict:
        cell = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in self.spans.cell().items()]
        return {**self.key, "number": self.number, "first": self.first, "last": self.last, "low": self.low, "high": self.high, **self.counts, "cell": cell}


def _segments(faults: DataFrame, segment: int) -> DataFrame:
    """One row for each run of a conversation's rows in a task, at most ``segment`` of them."""
    tasks = int(faults.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in ("conv", *ORDER)]
    dealt = faults.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    names = ("conv", "turn", "role", "hash", "row", "part", "initial", "fault")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        open_: _Segment | None = None
        for batch in batches:
            done = []
            for conv, turn, role, hash_, row, part, initial, fault in zip(*(batch.column(n).to_pylist() for n in names)):
                if open_ is None or open_.key["conv"] != conv or open_.size == segment:
                    if open_:
                        done.append(open_.row())
                    key = {"conv": conv, "part": part, "turn": turn, "role": role, "hash": hash_, "row": row}
                    open_ = _Segment(key, open_.number + 1 if open_ else 0)
                open_.add(turn, initial, fault)
            yield done
        if open_:
            yield [open_.row()]

    return _mapped(dealt, _SEGMENT, work)


# --- Whole conversations ---

def _conversations(segments: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, pieces): segments of a conversation combined in order.

    A piece is a segment's part of the audit, with the state before it and the key of its first row.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        waiting: list[dict] = []
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if waiting and waiting[0]["conv"] != row["conv"]:
                    done.append(_whole(waiting))
                    waiting = []
                waiting.append(row)
            yield done
        if waiting:
            yield [_whole(waiting)]

    tasks = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _mapped(segments.repartition(tasks, "conv").sortWithinPartitions("conv", "part", "number"), _CONVERSATION, work)


def _whole(segments: list[dict]) -> dict:
    counts = {n: sum(s[n] for s in segments) for n in _COUNTS}
    high = None
    for before, after in zip(segments, segments[1:]):
        counts["illegal"] += before["last"] + after["first"] not in LEGAL_PAIRS
    for s in segments:
        # A turn number that two segments share is one.
        counts["turns"] -= high is not None and s["low"] == high
        high = high if s["high"] is None else s["high"]
    low = next((s["low"] for s in segments if s["low"] is not None), None)
    best, came = {0: (0, "")}, []
    for s in segments:
        options = [(c["q"], (best[c["p"]][0] + c["cost"], best[c["p"]][1] + c["audit"], c["p"], c["audit"])) for c in s["cell"] if c["p"] in best]
        chosen: dict[int, tuple] = {}
        for q, option in options:
            if q not in chosen or option[:2] < chosen[q][:2]:
                chosen[q] = option
        came.append({q: option[2:] for q, option in chosen.items()})
        best = {q: option[:2] for q, option in chosen.items()}
    state = min((q for q in FINAL if q in best), key=best.__getitem__)
    cost, audit = best[state]
    pieces = []
    for s, back in zip(reversed(segments), reversed(came)):
        state, part = back[state]
        pieces.append({**{n: s[n] for n in ORDER}, "state": state, "audit": part})
    return {
        "conv": segments[0]["conv"], "gaps": 0 if low is None else high - low + 1 - counts.pop("turns"), **counts,
        "cost": cost, "audit": audit, "pieces": pieces[::-1],
    }


# --- Repaired rows ---


class _Editor:
    """Carries a piece of audit out on the rows that follow it."""

    def __init__(self):
        self.piece(0, "")

    def piece(self, state: int, letters: str) -> None:
        self.state, self.letters, self.at = state, letters, 0
        self.body = len(letters.rstrip(INSERT))

    def _take(self, role: str, text: str, edit: str) -> tuple[str, str, str]:
        self.state = STEPS[role[:1], self.state]
        return role, text, edit

    def _due(self) -> str:
        """The role that a turn at this place must have if it is not kept."""
        return next(role for initial, role in ROLES.items() if (initial, self.state) in STEPS)

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.letters) and self.letters[self.at] == INSERT:
            self.at += 1
            yield self._take(self._due(), "", INSERT)

    def edited(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """Turns that come of a row, insertions before it and, at the end of the piece, behind it included."""
        yield from self.inserted()
        letter = self.letters[self.at]
        self.at += 1
        if letter != DELETE:
            yield self._take(role if letter == KEEP else self._due(), text, letter)
        if self.at == self.body:
            yield from self.inserted()


def _edited(rows: DataFrame, conversations: DataFrame, fields: dict[str, str], fold) -> DataFrame:
    """What ``fold()`` gives for the repaired turns, one after the other, and for the end of each conversation."""
    said = rows.select("conv", *ORDER, F.lit(1).alias("kind"), "text", F.lit(0).alias("state"))
    pieces = conversations.select("conv", F.explode("pieces").alias("x")).select(
        "conv", *(F.col(f"x.{c}").alias(c) for c in ORDER), F.lit(0).alias("kind"), F.col("x.audit").alias("text"), F.col("x.state").alias("state")
    )
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in ("conv", *ORDER, "kind")]
    dealt = said.unionByName(pieces).repartition(tasks, "conv").sortWithinPartitions(*order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        editor, turns, now, begun = _Editor(), fold(), None, False
        for batch in batches:
            out = []
            for conv, kind, role, text, state in zip(*(batch.column(n).to_pylist() for n in ("conv", "kind", "role", "text", "state"))):
                if begun and conv != now:
                    out += turns.end(now)
                now, begun = conv, True
                if not kind:
                    editor.piece(state, text)
                    continue
                for turn in editor.edited(role, text):
                    out += turns.turn(conv, *turn)
            yield out
        if begun:
            yield turns.end(now)

    return _mapped(dealt, fields, work)


class _Turns:
    """Every repaired turn with its place."""

    def __init__(self):
        self.place = 0

    def turn(self, conv, role, text, edit) -> list[dict]:
        self.place += 1
        return [{"conv": conv, "place": self.place - 1, "role": role, "text": text, "edit": edit}]

    def end(self, conv) -> list[dict]:
        self.place = 0
        return []


class _Digest:
    """SHA-256 of ``role:text`` of all turns, joined by newlines."""

    def __init__(self):
        self.hash, self.first = hashlib.sha256(), True

    def turn(self, conv, role, text, edit) -> list[dict]:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False
        return []

    def end(self, conv) -> list[dict]:
        row = {"conv": conv, "sha": self.hash.hexdigest()}
        self.__init__()
        return [row]


class Repair:
    """The repair of rows (conv_id, turn, role, text); other columns are not read, whatever their names.

    Rows go by turn, nulls first; rows of one turn by role, then by the MD5 of the text. A null
    role or text is one space. A row's first fault counts: blank, duplicate (its role and text
    occurred earlier in the conversation), truncated (it does not end with ``.!?``). An empty
    role fits nowhere. Rows without a conversation form one.
    """

    def __init__(self, rows: DataFrame, segment: int = SEGMENT):
        self._rows = _prepared(rows)
        segments = written(_segments(_faults(self._rows), segment), "segments")
        self._conversations = written(_conversations(segments), "conversations")

    def summary(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows."""
        return self._conversations.drop("pieces").withColumnRenamed("conv", "conv_id")

    def turns(self) -> DataFrame:
        """(conv_id, place, role, text, edit): the repaired conversations, edit being K, R or I."""
        return _edited(self._rows, self._conversations, _TURN, _Turns).withColumnRenamed("conv", "conv_id")

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256): SHA-256 of the repaired turns, each ``role:text``, joined by newlines."""
        digests = _edited(self._rows, self._conversations, _DIGEST, _Digest)
        return digests.select(F.col("conv").alias("conv_id"), F.col("sha").alias("repaired_sha256"))


def repair_report(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Summary and digest for every conv_id of ``conversations``; those without ``rows`` have zeros and empty texts."""
    repair = Repair(rows)
    found = repair.summary().alias("s").join(repair.digests().alias("d"), F.col("s.conv_id").eqNullSafe(F.col("d.conv_id"))).drop(F.col("d.conv_id"))
    every = conversations.select("conv_id").distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    same = F.col("e.conv_id").eqNullSafe(F.col("f.conv_id"))
    return every.alias("e").join(found.alias("f"), same, "left").select(
        F.col("e.conv_id").alias("conv_id"), *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
