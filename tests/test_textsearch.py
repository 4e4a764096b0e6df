"""Substring search: equal to the scan, and what it reads."""

import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from servertide.operators.scratch import scratch_path
from servertide.plans import queries
from servertide.sources import textsearch
from servertide.sources.schemas import schema
from servertide.sources.textsearch import TextIndex, pieces

WORDS = ["SELECT", "from", "Orders", "where", "customer_id", "=", "100%", "a\\b", "GRÖSSE", "größe", "Σίσυφος", "ΣΊΣΥΦΟΣ", "x_y", "İd", "😀😀😀ok", "naïve", "join", "ab", "\n"]


@pytest.fixture(scope="module")
def filled(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(WORDS, k=rng.randrange(0, 30))) for _ in range(400)] + ["", None, "ab", "abc", "word " * 20_000 + "needle"]
    rows = [(str(i).encode(), i % 3, i, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame([*rows, rows[0], (None, 1, 1, "no handle")], schema("sql_text"))
    index = TextIndex(spark, scratch_path(spark, "search"), ["sql_handle"], schema("sql_text"), parts=8, slots=64)
    index.add(table.where("objectid % 2 = 0"), "7")
    index.add(table, "all")
    index.add(table, "all")
    index.add(table.limit(50), "more")
    return index, spark.createDataFrame(rows, schema("sql_text")), [t for t in texts if t]


def like(texts, patterns):
    """Every text against every pattern."""
    asked = F.explode(F.array(*[F.lit(p) for p in patterns])).alias("pattern")
    return sorted((r.pattern, bytes(r.sql_handle)) for r in texts.select("*", asked).where(F.ilike("text", F.col("pattern"))).collect())


def test_equal_to_the_scan_for_200_patterns(filled):
    index, rows, texts = filled
    rng = random.Random(6)
    patterns = {"%", "%a%", "ab", "%ab%", "abc", "", "%needle", "%no such text%", "%100\\%%", "%a\\\\b%", "%x\\_y%", "%😀ok%", "%zzz%select%"}
    while len(patterns) < 200:
        text = rng.choice(texts)
        at = rng.randrange(len(text))
        part = re.sub(r"([\\%_])", r"\\\1", text[at: at + rng.randrange(1, 12)])
        part = rng.choice([part, part.upper(), part.lower()])
        patterns.add(rng.choice(["%{}%", "%{}%", "{}%", "%{}", "%{}_%", "%{}%o%"]).format(part))
    patterns = sorted(patterns)
    got = sorted((r.pattern, bytes(r.sql_handle)) for r in index.search(patterns).collect())
    assert got == like(rows, patterns) and len(got) > 1000


def test_many_matches_are_joined(filled, monkeypatch):
    index, rows, _ = filled
    monkeypatch.setattr(textsearch, "FEW", 5)
    patterns = ["%select%", "%größe%from%", "%where%"]
    assert sorted((r.pattern, bytes(r.sql_handle)) for r in index.search(patterns).collect()) == like(rows, patterns)


def test_rare_patterns_read_few_texts(filled):
    index, rows, _ = filled
    found = index.candidates(["%needle%"])
    assert found.count() == 1 < rows.count() / 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan or re.search(r"PartitionFilters: \[\(?slot#\d+ (=|IN)", plan)
    assert index.candidates(["%no such text%"]).count() == 0


def test_statements_of_the_texts_found(filled, spark):
    index, rows, _ = filled
    stats = spark.range(300).select(F.col("id").cast("string").cast("binary").alias("sql_handle"), F.lit(0).alias("statement_start_offset"), F.lit(-1).alias("statement_end_offset"))
    stats = stats.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema("query_stats") if f.name not in stats.columns])
    pattern = "%größe%join%"
    want = sorted(bytes(r.sql_handle) for r in queries.statements_matching(stats, rows, pattern).collect())
    assert want and sorted(bytes(r.sql_handle) for r in queries.statements_matching(stats, index.texts_like(pattern), pattern).collect()) == want


def test_nothing_to_find(spark, rows):
    index = TextIndex(spark, scratch_path(spark, "search"), ["sql_handle"], schema("sql_text"))
    assert index.texts_like("%abc%").collect() == index.texts_like("%").collect() == index.search([]).collect() == []
    index.add(rows("sql_text", []), "1")
    assert index.texts_like("%abc%").collect() == []


@pytest.mark.parametrize("lost", ["lists", "counts", "texts"])
def test_a_call_that_was_cut_off_is_finished_by_repeating_it(spark, rows, monkeypatch, lost):
    index = TextIndex(spark, scratch_path(spark, "search"), ["sql_handle"], schema("sql_text"), parts=2, slots=2)
    first, second = (rows("sql_text", [{"sql_handle": bytes([n]), "text": f"text {n} of all"}]) for n in (1, 2))
    index.add(first, "1")
    append = textsearch.append_batch

    def cut_off(df, path, *rest):
        if path.endswith(lost):
            raise OSError("lost")
        append(df, path, *rest)

    monkeypatch.setattr(textsearch, "append_batch", cut_off)
    with pytest.raises(OSError):
        index.add(second, "2")
    assert [r.text for r in index.texts_like("%of all%").collect()] == ["text 1 of all"]
    monkeypatch.setattr(textsearch, "append_batch", append)
    index.add(second, "2")
    assert sorted(r.text for r in index.texts_like("%of all%").collect()) == ["text 1 of all", "text 2 of all"]


def test_lists_are_rows_of_many_texts(spark):
    """One row for a run and a stretch of texts, so that rows do not grow with texts times runs."""
    index = TextIndex(spark, scratch_path(spark, "search"), ["sql_handle"], schema("sql_text"), parts=2, slots=2)
    texts = spark.range(1000).selectExpr("encode(CAST(id AS STRING), 'utf-8') AS sql_handle", "1 AS dbid", "1 AS objectid", "concat('Select * from orders where customer = ', id) AS text")
    index.add(texts, "1")
    index.add(texts, "2")
    lists, counts = index._read("lists"), index._read("counts")
    postings = counts.agg(F.sum("texts")).first()[0]
    assert postings > 30_000 > 10 * lists.count()
    assert {r.gram: r.texts for r in counts.collect()} == {r.gram: r.n for r in lists.groupBy("gram").agg(F.sum(F.size("numbers")).alias("n")).collect()}
    assert counts.where("gram = 'sel'").first().texts == index.search(["%SELECT%"]).count() == 1000
    assert [r.text for r in index.texts_like("%= 77").collect()] == ["Select * from orders where customer = 77"]


def in_python(rows, stretch):
    """{(slot, run): numbers} as workers find them."""
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[k] for r in rows], pa.int32()) for k in (1, 2)]], names=["low", "slot", "number"])
    found = defaultdict(list)
    for out in textsearch._listed(stretch)([batch]):
        for r in out.to_pylist():
            found[r["slot"], r["gram"]] += r["numbers"]
    return found


def plainly(rows):
    found = defaultdict(list)
    for text, slot, number in rows:
        for run in {text[i: i + 3] for i in range(len(text) - 2)}:
            found[slot, run].append(number)
    return found


@pytest.mark.parametrize("stretch", [1, 3, 40, 10_000])
def test_runs_of_texts_that_are_longer_and_shorter_than_a_stretch(stretch):
    rng = random.Random(stretch)
    rows = [("".join(rng.choices("ab\0é😀\n\uffff\U0010ffff", k=rng.choice([0, 1, 2, 3, 9, 60]))), n // 25, n) for n in range(100)]
    assert in_python(rows, stretch) == plainly(rows)
    assert in_python([], stretch) == {}


def test_runs_of_so_many_letters_that_texts_are_halved():
    letters = [chr(c) for c in range(0x10000, 0x10000 + 140_000)]
    rows = [("".join(letters[n * 35: n * 35 + 35]), 1, n) for n in range(4000)] + [("".join(letters[:5]), 1, 4000)]
    assert len(letters) ** 3 * len(rows) > 2**63
    assert in_python(rows, 10**7) == plainly(rows)


def test_pieces():
    assert pieces("%abcd_ef%ghi\\%jkl%") == ["abc", "bcd", "ghi", "jkl"]
    assert pieces("") == pieces("a%b") == []
