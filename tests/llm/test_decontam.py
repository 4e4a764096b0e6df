"""Benchmark decontamination against a plain edit distance over all stretches of the text."""

import random

import numpy as np

from servertide.llm import decontam
from servertide.llm.decontam import EDITS, Index, clean, contaminations, grams, normal, trimmed


def least_edits(pattern, text):
    """Edits of the pattern against its best stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def plain(text):
    return trimmed(normal(text)[0]).tolist()


def changed(words, edits):
    out = list(words)
    for _ in range(edits):
        at = random.randrange(len(out))
        kind = random.choice("rid")
        if kind == "r":
            out[at] = random.choice("xyz")
        elif kind == "i":
            out.insert(at, random.choice("xyz"))
        elif len(out) > 1:
            del out[at]
    return "".join(out)


def test_finds_all_within_the_budget_and_no_more():
    random.seed(6)
    syllables = ["the", "ing", "on", "er ", "at", "an ", "re"]
    items = [(k, "".join(random.choice(syllables) for _ in range(random.choice([2, 4, 10, 30, 60])))) for k in range(25)]
    items += [(100, "a"), (101, "ab"), (102, "abcdefghij"), (103, "  "), (104, "!!"), (105, "aaaaaaaaaaaaaaaaaaaa")]
    index = Index(items)
    for _ in range(60):
        k, item = random.choice(items)
        noise = lambda: "".join(random.choice(syllables + ["q ", "zz"]) for _ in range(random.randint(0, 30)))
        text = noise() + changed(item, random.choice([0, 1, 2, 5, 9])) + noise()
        found = {i: e for i, e, _, _ in index.matches(text)}
        for i, other in items:
            pattern = plain(other)
            if pattern:
                edits = least_edits(pattern, normal(text)[0].tolist())
                within = edits <= int(len(pattern) * EDITS)
                assert (i in found) == within and (not within or found[i] == edits), (i, other, text)


def test_many_short_items_in_one_block():
    random.seed(8)
    items = [(k, "".join(random.choice("abcdefghij klmnop") for _ in range(40))) for k in range(9_500)]
    assert sum(len(t) for _, t in items) < decontam.BLOCK
    index = Index(items)
    wanted = [0, 4_095, 4_096, 5_000, 8_191, 8_192, 9_499]
    text = " ".join(f"zz {items[k][1]} yy" for k in wanted)
    assert [(i, e) for i, e, _, _ in index.matches(text)] == [(k, 0) for k in wanted]
    for k in wanted:
        edited = items[k][1][:20] + "q" + items[k][1][21:]
        assert [(i, e) for i, e, _, _ in index.matches(f"zz {edited} yy")] == [(k, 1)]


def test_places_and_stretches(monkeypatch):
    random.seed(7)
    item = "What is the capital of Freedonia, and who lives there today?"
    index = Index([(1, item)])
    text = "É. " * 5000 + "«WHAT is   the capital of Freedonja -- and who lives there today?» " + "z " * 5000
    ((i, edits, start, end),) = index.matches(text)
    assert (i, edits) == (1, 1) and text[start:end].startswith("WHAT is") and text[start:end].endswith("today")
    for stretch in (1, 64, 1000):
        monkeypatch.setattr(decontam, "STRETCH", stretch)
        assert index.matches(text[14_000:16_500]) and not index.matches("z " * 3000)


def test_grams():
    points = np.array([1, 2, 3, 1, 2, 3, 4], np.uint32)
    for q in range(1, 8):
        hashes = grams(points, q).tolist()
        runs = [tuple(points[k: k + q]) for k in range(len(points) - q + 1)]
        assert len(hashes) == len(runs) and len(set(zip(hashes, runs))) == len(set(hashes)) == len(set(runs))


def test_tables(spark, docs, monkeypatch):
    items = spark.createDataFrame(
        [(1, "the quick brown fox jumps over the lazy dog"), (2, "pack my box with five dozen liquor jugs"), (3, None), (None, "x"), (4, ""), (2, "another text of the same item number")],
        "item_id long, text string",
    )
    pairs = [(1, "So: The quick brown fox jumps over the lazy dog."), (2, "clean"), (3, None), (4, ""), (None, "pack my box with five dozen liquor jugs"),
             (5, "the quick brown fox jumps over the lazy cat dog. " * 3000), (1, "So: The quick brown fox jumps over the lazy dog."), (6, "another text of the same item number")]
    table = docs(pairs).selectExpr("*", "7 AS item_id", "8 AS edits", "9 AS m")
    for block in (decontam.BLOCK, 20):
        monkeypatch.setattr(decontam, "BLOCK", block)
        assert sorted(((r.doc_id, r.item_id, r.edits) for r in contaminations(table, items).collect()), key=repr) == sorted(
            [(1, 1, 0), (1, 1, 0), (5, 1, 3), (None, 2, 0), (6, 2, 0)], key=repr)
        assert sorted(r.doc_id for r in clean(docs(pairs), items).collect()) == [2, 3, 4]
    assert contaminations(docs([]), items).collect() == [] and contaminations(table, items.limit(0)).collect() == []


def test_items_that_share_their_beginning():
    """Thousands of items with one instruction before them, and texts that repeat it or hold one of them."""
    import random
    import time

    from servertide.llm.decontam import Index

    source = random.Random(6)
    words = ["".join(source.choice("abcdefghijklmnop") for _ in range(source.randint(2, 8))) for _ in range(400)]
    said = "answer the question below by giving the letter of the one choice that is right and say "
    rest = lambda n: " ".join(source.choice(words) for _ in range(n))
    items = [(k, said + rest(20)) for k in range(4000)]
    index = Index(items)
    start = time.perf_counter()
    assert index.matches(said * 800) == []
    spoilt = items[17][1].replace("e", "x", 3)
    found = index.matches(f"{rest(1000)} {items[7][1]} {said * 3} {rest(1000)} {spoilt} {rest(50)}")
    assert time.perf_counter() - start < 30
    assert [(item, edits) for item, edits, _, _ in found] == [(7, 0), (17, 3)]
