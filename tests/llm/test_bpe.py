"""BPE against the tokenizers library: ids, decoded text, and plain merging of long words."""

import hashlib
import random

import pytest
import public_tokenizers
from tokenizers import Tokenizer

from servertide.llm.bpe import LONG, Vocabulary, decode, encode, merge_long, read_vocabulary

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ours():
    return Vocabulary(read_vocabulary(PATH))


@pytest.fixture(scope="module")
def theirs():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


TEXTS = [
    "", " ", "Hello, World!", "don't we'll I'M", "naïve café CAFÉ", "ΣΑΣ ς İ ẞ", "1234 ½ ٣", "a\x1cb\x1dc\x85d e　f",
    "<|startoftext|>x<|endoftext|><|endoftext", "<|STARTOFTEXT|>", "🙂👍🏽 你好", "‍﻿\u0000", "a" * 20_000, "thing" * 4000, "!?" * 3000,
]


def ids_of(vocabulary, text):
    return [int(i) for chunk in vocabulary.encoded([text])[0] for i in chunk[0].split()]


def test_texts(ours, theirs):
    random.seed(2)
    pool = "aAbBzZéÉΣςİ'’<|>dtsm \t\n019½你🙂́‍\x1c "
    texts = TEXTS + ["".join(random.choice(pool) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    for text in texts:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ids_of(ours, text) == ids, text[:80]
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_words_around_the_long_limit(ours, theirs):
    random.seed(3)
    for n in [*range(1, 12), LONG - 1, LONG, LONG + 1, 300]:
        for letters in ("a", "ab", "thingeroan"):
            word = "".join(random.choice(letters) for _ in range(n))
            assert ids_of(ours, word) == theirs.encode(word, add_special_tokens=False).ids


def test_forgetting_changes_nothing(ours, theirs, monkeypatch):
    import servertide.llm.bpe as module

    monkeypatch.setattr(module, "MEMORY", 2)
    monkeypatch.setattr(module, "LETTERS", 10)
    for text in ("one two three one two", "three one seven", "one seven two"):
        assert ids_of(ours, text) == theirs.encode(text, add_special_tokens=False).ids


def test_table(spark, docs, theirs):
    pairs = [*enumerate(TEXTS), (None, "x y"), (3, "again"), (3, "again"), (99, None)]
    table = docs(pairs).selectExpr("*", "1 AS n_tokens", "2 AS ids")
    rows = encode(table, PATH).collect()
    assert len(rows) == len(pairs)
    by_ids = sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)
    expected = []
    for i, text in pairs:
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected.append((i is None, i, len(ids), digest(" ".join(map(str, ids))), digest(theirs.decode(ids, skip_special_tokens=False))))
    assert by_ids == sorted(expected)
    for r in decode(encode(table, PATH), PATH).collect():
        assert hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256
    assert encode(docs([]), PATH).collect() == []


def test_merge_long_takes_the_leftmost_of_equal_ranks():
    assert merge_long(list("aaaaa"), {("a", "a"): 0}) == ["aa", "aa", "a"]
