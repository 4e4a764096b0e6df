"""Chat formatting: records of unlike layouts become turns, turns become training text. DataFrame functions only.

A record is a JSON object. Its fingerprint is a hash of its nested field paths, as far as a
mapping knows them, in sorted order; the fingerprint selects the declarative mapping that
turns the record into canonical turns (role, text). Fields that no mapping knows do not
matter; a record that no mapping fits has no turns and no layout.

Text of a turn: ``[INST] role [/INST]text</s>``. Control strings in roles and texts (those
of this template and of others in use) are broken by a backslash, and backslashes doubled,
so every text can be read back. The loss mask lists where assistant texts lie.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings that a text must not smuggle in: of a bracket or an angle the rest decides.
CONTROL = r"(\[)(?=/?INST\])|(<)(?=/?s>|</?SYS>>|\|)"
#: Texts may have any length: the parser's own limit is 20,000,000 characters. A record that cannot be read keeps its text here.
UNREAD = "__unread"
READ = {"maxStringLen": "2147483647", "columnNameOfCorruptRecord": UNREAD}
OPEN, MIDDLE, END = "[INST] ", " [/INST]", "</s>"
LEARNT = "assistant"


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1$2\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: either single fields in order, or a list with a role and a text field."""

    layout: str
    fields: tuple[tuple[str, str], ...] = ()  # (role, field)
    items: str = ""
    role: str = "role"
    text: str = "content"
    roles: tuple[tuple[str, str], ...] = ()  # (role in the record, canonical role)

    def paths(self) -> list[str]:
        if self.items:
            return sorted([self.items, f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"])
        return sorted(name for _, name in self.fields)


SHARED = (("human", "user"), ("gpt", "assistant"))
MAPPINGS = (
    Mapping("messages", items="messages"),
    Mapping("conversations", items="conversations", role="from", text="value", roles=SHARED),
    Mapping("turns", items="turns", text="text"),
    Mapping("prompt-completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt-response", fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("system-prompt-response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction-output", fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction-input-output", fields=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("question-answer", fields=(("user", "question"), ("assistant", "answer"))),
)


def _item_fields(mappings) -> dict[str, set[str]]:
    lists: dict[str, set[str]] = {}
    for m in mappings:
        if m.items:
            lists.setdefault(m.items, set()).update((m.role, m.text))
    return lists


def _below(name: str):
    return lambda key: F.concat(F.lit(f"{name}[]."), key)


def field_paths(record: Column, mappings=MAPPINGS) -> Column:
    """Sorted field paths of a JSON record that some mapping knows; a list's paths are those of its first item."""
    known = sorted({p for m in mappings for p in m.paths()})
    parts = [F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))]
    for name in sorted(_item_fields(mappings)):
        # get_json_object gives null for an item with a text beyond its limit, which cannot be set.
        long = F.from_json(record, f"`{name}` array<string>, `{UNREAD}` string", READ)[name]
        item = F.coalesce(F.get_json_object(record, f"$.{name}[0]"), F.when(F.array_contains(parts[0], name), F.get(long, F.lit(0))))
        keys = F.json_object_keys(item)
        parts.append(F.coalesce(F.transform(keys, _below(name)), F.array().cast("array<string>")))
    return F.array_sort(F.array_intersect(F.concat(*parts), F.array(*map(F.lit, known))))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def canonical(records: DataFrame, record_col: str = "record", mappings=MAPPINGS) -> DataFrame:
    """``records`` with layout, fingerprint and turns (an array of role and text) in place of the JSON column.

    A null text is empty, a null role stays null. No layout: turns is empty. A record whose
    fingerprint has a mapping but which cannot be read has no layout either; its fingerprint
    tells it from one that no mapping fits.
    """
    singles = sorted({f for m in mappings for _, f in m.fields})
    lists = _item_fields(mappings)
    schema = ", ".join(
        [*(f"`{f}` string" for f in singles), *(f"`{n}` array<struct<{', '.join(f'`{x}`:string' for x in sorted(fs))}>>" for n, fs in lists.items()),
         f"`{UNREAD}` string"]
    )

    def turn(role: Column, text: Column) -> Column:
        return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    def turns(m: Mapping) -> Column:
        parsed = F.col("__parsed")
        if not m.items:
            return F.array(*(turn(F.lit(role), parsed[field]) for role, field in m.fields))
        renamed = lambda r: reduce(lambda c, pair: c.when(r == pair[0], pair[1]), m.roles, F.when(F.lit(False), r)).otherwise(r)
        return F.transform(parsed[m.items], lambda x: turn(renamed(x[m.role]), x[m.text]))

    marked = records.withColumn("__parsed", F.from_json(F.col(record_col), schema, READ)).withColumn(
        "fingerprint", fingerprint(field_paths(F.col(record_col), mappings))
    )
    read = F.col("__parsed")[UNREAD].isNull()
    fits = {m: read & (F.col("fingerprint") == fingerprint(F.array(*map(F.lit, m.paths())))) for m in mappings}
    layout = F.coalesce(*(F.when(fit, m.layout) for m, fit in fits.items()))
    found = F.coalesce(*(F.when(fit, turns(m)) for m, fit in fits.items()), F.array().cast("array<struct<role:string,text:string>>"))
    return marked.withColumn("layout", layout).withColumn("turns", found).drop("__parsed", record_col)


def _sums_before(numbers: str) -> Column:
    """For each element of an array column of numbers the sum of those before it.

    Arrays are added up in about as many pieces as a piece has elements, since an array that
    grows by one element is copied. What a lambda uses besides its arguments is a column, since
    anything else would be computed again for each element.
    """
    zero = F.array(F.lit(0).cast("long"))
    add = lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x))
    size = F.greatest(F.size(numbers), F.lit(1))
    piece = F.ceil(F.sqrt(size)).cast("int")
    within = F.transform(F.sequence(F.lit(1), size, piece), lambda at: F.aggregate(F.slice(numbers, at, piece), zero, add))
    offsets = F.aggregate(F.transform(within, lambda sums: F.element_at(sums, -1)), zero, add)
    # There is one offset more, that behind the last piece.
    moved = F.zip_with(within, offsets, lambda sums, offset: F.transform(F.slice(sums, F.lit(1), F.size(sums) - 1), lambda x: x + offset))
    return F.flatten(F.array_compact(moved))


def formatted(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, layout, formatted, loss_spans) for every row: its ``turns`` as one text, and where the assistant texts lie.

    loss_spans holds (start, end) in code points of the formatted text, in order. Rows are
    formatted one by one: rows that repeat an id, or have none, are records of their own. A null
    role is empty; rows without turns give an empty text and no spans.
    """
    turns = F.coalesce("turns", F.array().cast("array<struct<role:string,text:string>>"))
    parts = F.transform(turns, lambda t: F.struct(
        F.concat(F.lit(OPEN), escaped(F.coalesce(t["role"], F.lit(""))), F.lit(MIDDLE)).alias("head"),
        escaped(F.coalesce(t["text"], F.lit(""))).alias("body"), F.coalesce(t["role"] == LEARNT, F.lit(False)).alias("learnt"),
    ))
    rows = conversations.select(F.col(id_col).alias("id"), "layout", parts.alias("parts"))
    lengths = F.transform("parts", lambda x: (F.length(x["head"]) + F.length(x["body"]) + len(END)).cast("long"))
    rows = rows.select("id", "layout", "parts", lengths.alias("lengths")).select("id", "layout", "parts", _sums_before("lengths").alias("starts"))

    def placed(x: Column, start: Column) -> Column:
        begin = start + F.length(x["head"])
        return F.struct(begin.alias("start"), (begin + F.length(x["body"])).alias("end"), x["learnt"].alias("learnt"))

    learnt = F.filter(F.zip_with("parts", "starts", placed), lambda x: x["learnt"])
    return rows.select(
        F.col("id").alias(id_col), "layout", F.array_join(F.transform("parts", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        F.transform(learnt, lambda x: F.struct(x["start"], x["end"])).alias("loss_spans"),
    )


def read_back(texts: DataFrame) -> DataFrame:
    """``texts`` with turns (role, text) and loss_text as they are read from ``formatted`` and ``loss_spans`` alone."""
    # Marks begin with a control string, which no role or text holds any more; the last part, after the last end, is empty.
    parts = F.split("formatted", F.lit("</s>"), -1)
    closed = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        inner = F.substring(part, F.lit(len(OPEN) + 1), F.length(part))
        at = F.instr(inner, MIDDLE)
        return F.struct(
            unescaped(F.substring(inner, F.lit(1), at - 1)).alias("role"),
            unescaped(F.substring(inner, at + len(MIDDLE), F.length(inner))).alias("text"),
        )

    learnt = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return texts.withColumn("turns", F.transform(closed, turn)).withColumn("loss_text", F.array_join(learnt, ""))


def records_of_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, record): rows (conv_id, turn, role, text) as JSON records, in the layout that a conversation has room for.

    A user and an assistant turn: prompt and response. A system turn before those:
    instruction, input and output. Any other: a list of messages. Turns go by number, then
    role and text; repeated rows are repeated turns; rows without a conversation form one.
    """
    turn = F.struct(F.col("turn"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    roles = F.transform("t", lambda t: F.coalesce(t["role"], F.lit("")))
    text = lambda k: F.col("t")[k]["text"]
    options = {"ignoreNullFields": "false"}
    messages = F.to_json(F.struct(F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")), options)
    pair = F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response")), options)
    triple = F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("input"), text(2).alias("output")), options)
    order = F.array_join(roles, "\n")
    return grouped.select(
        "conv_id",
        F.when(order == "user\nassistant", pair).when(order == "system\nuser\nassistant", triple).otherwise(messages).alias("record"),
    )


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, layout, formatted, loss_spans) of a table of turns."""
    return formatted(canonical(records_of_turns(rows)))
