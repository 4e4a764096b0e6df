"""Conversation repair against all edits tried out, and against plain Python on whole tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from servertide.llm.repair import (
    BLANK, DUPLICATE, FINAL, SOUND, TRUNCATED, Repair, Spans, _segments, _faults, _prepared, damaged, repair_report, row_cell,
)

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
SCHEMA = "conv_id long, turn long, role string, text string"


def every_repair(rows):
    """(cost, audit) of the best of all repairs, and its turns; rows are (role, text, fault)."""
    inserts = ["", "u", "a", "ua", "au"]
    best = None
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product(("K", "Ru", "Ra", "D"), repeat=len(rows)):
            cost, audit, turns = 0, "", []
            for k, gap in enumerate(gaps):
                cost, audit = cost + 3 * len(gap), audit + "I" * len(gap)
                turns += [({"u": "user", "a": "assistant"}[x], "") for x in gap]
                if k == len(rows):
                    break
                (role, text, fault), edit = rows[k], edits[k]
                audit += edit[0]
                if edit == "D":
                    cost += 4
                    continue
                if fault in (BLANK, DUPLICATE):
                    cost += 10**6
                cost += 3 * (edit[0] == "R") + 3 * (fault == TRUNCATED)
                turns.append(({"u": "user", "a": "assistant"}[edit[1]] if edit[0] == "R" else role, text))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)) and (best is None or (cost, audit) < best[0]):
                best = (cost, audit), turns
    return best


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.sampled_from([SOUND, BLANK, DUPLICATE, TRUNCATED])), max_size=3))
def test_cells_against_all_edits(rows):
    spans = Spans()
    for initial, fault in rows:
        spans.add(row_cell(initial, fault))
    cell = spans.cell() if rows else {(0, 0): (0, "")}
    assert min(cell[0, q] for q in FINAL if (0, q) in cell) == every_repair([(i, "t", f) for i, f in rows])[0]


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        by = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if by == 1:
            text = ""
        if by == 2:
            text = re.sub("[.!?]", "", text)
        if by == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(by, 1)
    return out


def plain_report(rows, every):
    """One left-to-right pass over each conversation."""
    steps = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    names = {"u": "user", "a": "assistant"}
    result = {}
    for conv in every:
        own = [r[1:] for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(WHITE)
            faults.append(BLANK if not bare else DUPLICATE if (role, text) in seen else TRUNCATED if bare[-1] not in ".!?" else SOUND)
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))

        def grown(best):
            while True:
                more = dict(best)
                for p, (cost, audit, made) in best.items():
                    for (initial, q), to in steps.items():
                        if initial in names and q == p:
                            option = (cost + 3, audit + "I", made + [f"{names[initial]}:"])
                            if to not in more or option[:2] < more[to][:2]:
                                more[to] = option
                if more == best:
                    return best
                best = more

        best = grown({0: (0, "", [])})
        for (_, role, text), fault in zip(own, faults):
            after = {}

            def offer(to, option):
                if to not in after or option[:2] < after[to][:2]:
                    after[to] = option

            for p, (cost, audit, made) in best.items():
                offer(p, (cost + 4, audit + "D", made))
                if fault in (BLANK, DUPLICATE):
                    continue
                extra = 3 * (fault == TRUNCATED)
                for (initial, q), to in steps.items():
                    if q == p and initial == role[:1]:
                        offer(to, (cost + extra, audit + "K", made + [f"{role}:{text}"]))
                    if q == p and initial in names:
                        offer(to, (cost + extra + 3, audit + "R", made + [f"{names[initial]}:{text}"]))
            best = grown(after)
        cost, audit, made = min(best[q] for q in (0, 3) if q in best)
        result[conv] = (
            gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, cost, audit,
            hashlib.sha256("\n".join(made).encode()).hexdigest(),
        )
    return result


def reported(frame):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = frame.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[n] for n in names) for r in rows}


def made_up(seed=3, conversations=60):
    source = random.Random(seed)
    rows = []
    for conv in [None, *range(conversations)]:
        for turn in range(source.randint(0, 9)):
            role = source.choice(["user", "assistant"] * 6 + ["system", "tool", None, "", "unknown"])
            text = source.choice(["Yes.", "Is it?", "no end", "", " \n", None, "Wow!\t", "é.", "a. b", "  x  ", f"n{turn}."])
            rows.append((conv, source.choice([turn] * 8 + [None, turn + 3, -turn]), role, text))
    return rows


@pytest.mark.parametrize("segment", [1, 3, 32_768])
def test_report(spark, segment):
    rows = plain_damage(made_up())
    frame = spark.createDataFrame(rows, SCHEMA)
    repair = Repair(frame, segment)
    want = plain_report(rows, {r[0] for r in rows})
    sha = {r.conv_id: r.repaired_sha256 for r in repair.digests().collect()}
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, sha[r.conv_id]) for r in repair.summary().collect()}
    assert got == want


def test_damage_and_every_conversation(spark):
    rows = [*made_up(11, 300), *((1000 + k, 0, "user", "Only one.") for k in range(60))]
    frame = spark.createDataFrame(rows, SCHEMA)
    spoilt = plain_damage(rows)
    assert sorted(map(tuple, damaged(frame).collect()), key=repr) == sorted(spoilt, key=repr)
    every = {r[0] for r in rows}
    assert every - {r[0] for r in spoilt}, "a conversation should lose all its rows"
    assert reported(repair_report(damaged(frame), frame)) == plain_report(spoilt, every)


def test_one_long_conversation(spark):
    """It spreads over many tasks and segments, in which turns repeat across the borders."""
    source = random.Random(8)
    rows = [(7, k // 2, source.choice(["user", "assistant", "system"]), source.choice(["One.", "two", "Three!", f"{k}.", ""])) for k in range(6000)]
    rows += [(8, 0, "user", "Hello."), (8, 1, "assistant", "Hello!")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert _segments(_faults(_prepared(frame)), 100).where("conv = 7").select("part").distinct().count() > 2
    repair = Repair(frame, 100)
    want = plain_report(rows, {7, 8})
    assert {r.conv_id: (r.cost, r.audit) for r in repair.summary().collect()} == {c: w[5:7] for c, w in want.items()}
    assert {r.conv_id: r.repaired_sha256 for r in repair.digests().collect()} == {c: w[7] for c, w in want.items()}


def test_turns_are_legal_and_whole(spark):
    frame = spark.createDataFrame(plain_damage(made_up(5)), SCHEMA).selectExpr("*", "1 AS place", "'x' AS conv", "2 AS edit")
    rows = Repair(frame).turns().collect()
    by_conv = {}
    for r in sorted(rows, key=lambda r: r.place):
        by_conv.setdefault(r.conv_id, []).append(r)
    for turns in by_conv.values():
        assert [t.place for t in turns] == list(range(len(turns)))
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[:1] for t in turns))
        assert all(t.edit in "KRI" and (t.text or t.edit == "I") for t in turns)


def test_text_ids_and_long_texts(spark):
    rows = [("a", 0, "user", "word " * 400_000 + "."), ("a", 1, "assistant", "Yes."), ("a:1", 0, "user", "a"), ("", 0, "assistant", "B.")]
    frame = spark.createDataFrame(rows, SCHEMA.replace("conv_id long", "conv_id string"))
    assert reported(repair_report(frame, frame)) == plain_report(rows, {"a", "a:1", ""})


def test_nothing(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert repair_report(frame, frame).collect() == []
    assert Repair(frame).turns().collect() == []
