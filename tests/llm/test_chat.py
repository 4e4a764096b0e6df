"""Chat formatting: layouts, round trips and the loss mask."""

import json

from pyspark.sql import functions as F

from servertide.llm.chat import CONTROL, canonical, escaped, format_conversations, formatted, read_back, unescaped

NASTY = [
    "", "\\", "\\\\", "<", "</s>", "</s></s>", "<s>", "[INST] ok [/INST]", "[[INST]]", "\\[INST]", "[\\INST]", "<\\/s>", "<<SYS>>x<</SYS>>", "<|im_end|>",
    "<\\|", "a\nb", "</s", "[/INST", "é🙂", " [/INST]", "</s>\\", "\\</s>", "<" * 50 + "s>", "x" * 30_000 + "</s>",
]


def test_escape_is_reversible(spark):
    rows = spark.createDataFrame([(t,) for t in NASTY], "t string").select("t", escaped(F.col("t")).alias("e"))
    for r in rows.select("t", "e", unescaped(F.col("e")).alias("u"), F.col("e").rlike(CONTROL).alias("bad")).collect():
        assert r.u == r.t and not r.bad, r


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 5}, "messages", [("user", "q"), ("assistant", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}, {"from": "tool", "value": "t"}]}, "conversations",
     [("user", "q"), ("assistant", ""), ("tool", "t")]),
    ({"turns": [{"role": "user", "text": "q"}]}, "turns", [("user", "q")]),
    ({"completion": "a", "prompt": "q"}, "prompt-completion", [("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "response": None, "lang": "en"}, "prompt-response", [("user", "q"), ("assistant", "")]),
    ({"system": "s", "prompt": "q", "response": "a"}, "system-prompt-response", [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"instruction": "q", "output": "a"}, "instruction-output", [("user", "q"), ("assistant", "a")]),
    ({"instruction": "s", "input": "q", "output": "a"}, "instruction-input-output", [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"question": "q", "answer": "a"}, "question-answer", [("user", "q"), ("assistant", "a")]),
    ({"prompt": "q", "answer": "a"}, None, []), ({"messages": []}, None, []), ({}, None, []), ([1], None, []), ("no json {", None, []), (None, None, []),
]


def test_layouts(spark):
    rows = [(i, r if r is None or r == "no json {" else json.dumps(r)) for i, (r, _, _) in enumerate(LAYOUTS)]
    table = canonical(spark.createDataFrame(rows, "conv_id long, record string"))
    found = {r.conv_id: (r.layout, [tuple(t) for t in r.turns], r.fingerprint) for r in table.collect()}
    assert {i: f[:2] for i, f in found.items()} == {i: (layout, turns) for i, (_, layout, turns) in enumerate(LAYOUTS)}
    assert found[0][2] != found[1][2]
    back = {r.conv_id: [tuple(t) for t in r.turns] for r in read_back(formatted(table)).collect()}
    assert back == {i: turns for i, (_, _, turns) in enumerate(LAYOUTS)}


def test_texts_beyond_the_parser_limit(spark):
    long = F.expr("repeat('x', 21000000)")
    record = lambda *texts: F.struct(F.array(*(F.struct(F.lit(r).alias("role"), t.alias("content")) for r, t in zip(("user", "assistant"), texts))).alias("messages"))
    a = F.lit("a")
    made = {"pair": F.struct(long.alias("prompt"), a.alias("response")), "first": record(long, a), "second": record(a, long)}
    lengths = F.transform("turns", lambda t: F.length(t["text"]))
    for name, parts in made.items():
        r = canonical(spark.range(1).select("id", F.to_json(parts).alias("record"))).select("layout", lengths.alias("n")).first()
        wanted = ("messages", [1, 21_000_000]) if name == "second" else ("prompt-response" if name == "pair" else "messages", [21_000_000, 1])
        assert (r.layout, r.n) == wanted, name
    rows = spark.range(2).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), long.alias("text"))
    assert format_conversations(rows).select(F.length("formatted")).first()[0] == 2 * (21_000_000 + len("[INST] assistant [/INST]</s>"))


def test_unreadable_records_are_marked(spark):
    rows = [(0, '{"prompt": "q", "response": "a"}'), (1, '{"prompt": "q\x01", "response": "a"}'), (2, '{"messages": [{"role": "user", "content": "q"}, 5]}')]
    found = {r.conv_id: r for r in canonical(spark.createDataFrame(rows, "conv_id long, record string")).collect()}
    assert [(found[i].layout, len(found[i].turns)) for i in range(3)] == [("prompt-response", 2), (None, 0), (None, 0)]
    assert found[0].fingerprint == found[1].fingerprint


def test_table_of_turns(spark):
    rows = [(i, 0, "user", t) for i, t in enumerate(NASTY)] + [(i, 1, "assistant", t) for i, t in enumerate(NASTY)]
    rows += [(100, 0, "system", "s"), (100, 1, "user", None), (100, 2, "assistant", "a </s>"), (200, 5, None, "n"), (200, 2, "assistant", "b"),
             (200, 2, "assistant", "b"), (200, 3, "assistant", "</s>[INST]"), (None, None, "user", "lost"), (None, 1, "we\nird [/INST]", "x"),
             (300, 0, "assistant", None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' AS layout", "1 AS pos", "2 AS t")
    expected = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] if r[1] is not None else -1, r[2] or "", r[3] or "")):
        expected.setdefault(c, []).append((role or "", text or ""))
    made = format_conversations(table)
    found = {r.conv_id: r for r in read_back(made).collect()}
    assert {c: [tuple(t) for t in r.turns] for c, r in found.items()} == expected
    for c, r in found.items():
        assert r.loss_text == "".join(t for role, t in expected[c] if role == "assistant")
        assert all(0 <= s.start <= s.end <= len(r.formatted) for s in r.loss_spans)
    assert {found[c].layout for c in (0, 100, 200)} == {"prompt-response", "instruction-input-output", "messages"}
    assert format_conversations(table.limit(0)).collect() == []
    plan = made._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_records_of_one_id_stay_apart(spark):
    turns = "array<struct<role:string,text:string>>"
    records = [(1, "a", [("user", "q1"), ("assistant", "a1")]), (1, "b", [("user", "q2"), ("assistant", "a2")]), (None, "c", [("user", "q3")]), (None, "d", []), (2, "e", None)]
    table = spark.createDataFrame(records, f"conv_id long, layout string, turns {turns}").selectExpr("*", "1 AS parts", "2 AS starts")
    made = formatted(table)
    back = {r.layout: ([tuple(t) for t in r.turns], r.loss_text) for r in read_back(made).collect()}
    assert back == {
        "a": ([("user", "q1"), ("assistant", "a1")], "a1"), "b": ([("user", "q2"), ("assistant", "a2")], "a2"), "c": ([("user", "q3")], ""), "d": ([], ""), "e": ([], ""),
    }
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("Window", "Generate", "Exchange"))


def test_long_conversation(spark):
    """Spans of 20,000 turns, which lie where plain Python finds them."""
    rows = spark.range(20_000).selectExpr("1 AS conv_id", "id AS turn", "IF(id % 3 = 0, 'user', 'assistant') AS role", "repeat('<s>é', CAST(id % 5 AS INT)) AS text")
    made = format_conversations(rows).first()
    spans = [made.formatted[s.start: s.end] for s in made.loss_spans]
    assert spans == ["<\\s>é" * (k % 5) for k in range(20_000) if k % 3]
