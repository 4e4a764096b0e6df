"""SimHash fingerprints and components against brute force."""

import random

import xxhash
from pyspark.sql import functions as F

from servertide.llm.simhash import _shards, fingerprint_of, linked, one_of_each, simhash_components


def plain_print(text):
    words, word = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    words += [word] * bool(word)
    runs = [" ".join(words[i: i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(pairs):
    prints = [plain_print(t) for _, t in pairs]
    label = list(range(len(pairs)))
    for _ in pairs:
        for i in range(len(pairs)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    out = []
    for i, (own, _) in enumerate(pairs):
        ids = [p[0] for k, p in enumerate(pairs) if label[k] == label[i] and p[0] is not None]
        out.append((own, f"{prints[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=repr)


TEXTS = [
    None, "", "  \n\t ", "one", "One", "two words", "a b c", "A B  c", "a b c d", "é È é x y", "a b c d e", "\x1ca b c",
    " ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(301)), "same " * 1000, "x" * 70_000,
]


def test_fingerprints():
    random.seed(1)
    for text in TEXTS + ["".join(random.choice("ab \nÉ") for _ in range(50)) for _ in range(100)]:
        assert fingerprint_of(text) % 2**64 == plain_print(text)
    long = " ".join(random.choice("abcdefgh") for _ in range(150_000))
    import servertide.llm.simhash as module

    whole, module.HASHES_AT_A_TIME = fingerprint_of(long), 1000
    try:
        assert fingerprint_of(long) == whole
    finally:
        module.HASHES_AT_A_TIME = 65_536


def test_components(spark, docs):
    base = [f"w{i}" for i in range(400)]
    pairs = list(enumerate(TEXTS)) + [(100 + i, " ".join(base[i:])) for i in range(6)] + [(7, "a b c"), (None, ""), (None, "alone of all texts here"), (3, "one")]
    result = simhash_components(docs(pairs).selectExpr("*", "1 AS fp", "2 AS root", "3 AS component_id"))
    assert sorted(map(tuple, result.collect()), key=repr) == expected(pairs)
    assert simhash_components(docs([])).collect() == []
    kept = one_of_each(docs(pairs)).collect()
    groups = {(r[2], r[1] if r[2] is None else "") for r in expected(pairs)}
    assert len(kept) == len(groups) and sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(c for c, _ in groups if c is not None)
    assert kept[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"}
    assert one_of_each(docs([])).collect() == []


def test_rows_of_one_id_and_rows_without_an_id(spark, docs):
    base = " ".join(f"w{i}" for i in range(400))
    near = next(t for n in range(1, 50) if 0 < (fingerprint_of(t := base + " " + " ".join(f"v{i}" for i in range(n))) ^ fingerprint_of(base)).bit_count() <= 3)
    other = " ".join(f"x{i}" for i in range(400))
    # Id 5 has a copy of text 1 and a text of its own; id 6 has two texts of its own.
    pairs = [(1, base), (5, base), (5, "a text of its own"), (6, "one text"), (6, "quite another text here"), (7, "usual"), (7, "usual")]
    kept = sorted((r.doc_id, r.text) for r in one_of_each(docs(pairs)).collect())
    assert kept == [(1, base), (5, "a text of its own"), (6, "one text"), (6, "quite another text here"), (7, "usual")]
    kept = one_of_each(docs([(None, base), (None, near), (None, other), (None, other)])).collect()
    assert len(kept) == 2 and {r.text for r in kept} - {base, near} == {other}


def test_search_is_exact_for_flipped_bits(spark):
    """All pairs within three bits are connected, wherever the bits lie."""
    random.seed(4)
    prints = set()
    for _ in range(120):
        f = random.getrandbits(64)
        prints |= {f} | {f ^ sum(1 << b for b in random.sample(range(64), k)) for k in (1, 2, 3, 4)}
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in prints]
    links = {frozenset(r) for r in linked(spark.createDataFrame(signed, "fp long")).collect()}
    reach = {f[0]: f[0] for f in signed}
    for _ in signed:
        changed = False
        for link in links:
            a, b = tuple(link)
            low = min(reach[a], reach[b])
            changed |= (reach[a], reach[b]) != (low, low)
            reach[a] = reach[b] = low
        if not changed:
            break
    for a, in signed:
        for b, in signed:
            if ((a ^ b) % 2**64).bit_count() <= 3:
                assert reach[a] == reach[b]
    assert all(((a ^ b) % 2**64).bit_count() <= 3 or reach[a] == reach[b] for a, b in map(tuple, links))


def work(spark, n):
    """Postings and comparisons of n random fingerprints."""
    sizes = (
        spark.range(n).select(F.explode(_shards(F.xxhash64(F.lit(3), "id"))).alias("key")).groupBy("key").count()
        .agg(F.sum("count").alias("postings"), F.sum(F.expr("count * (count - 1) / 2")).alias("pairs")).first()
    )
    return sizes.postings, int(sizes.pairs)


def test_comparisons_do_not_grow_with_the_square(spark):
    (few_rows, few), (many_rows, many) = work(spark, 50_000), work(spark, 200_000)
    assert many_rows <= 16 * 200_000 and many < 200_000
    assert many_rows + many <= 4**1.3 * (few_rows + few)
