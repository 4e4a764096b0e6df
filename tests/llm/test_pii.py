"""Personal data: base spans against the plain patterns, votes and their weights, and edge rows."""

import hashlib
import random
import re

from servertide.llm.pii import KINDS, base_spans, code, decode, find_personal_data, fit_classifier, luhn, votes, weigh
from servertide.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    found = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), k, m.end()))
    return sorted(found)


def test_base_spans():
    random.seed(9)
    fixed = ["a@b.c", "a@b", "@b.c", "x@y@z.w", "a.b+c@d-e.f.g.", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256 001.2.3.4", "4111 1111-1111 1111", "4111  1111",
             "+1 (555) 010-9999.", "+12", "++49 30 1234567 ", "+1 2 3", "é@b.c", "٣.1.1.1", "4111111111111111@x.yz", "0.0.0.0", "1" * 25]
    pool = "ab1234567890@@..--  +()é"
    for text in fixed + ["".join(random.choice(pool) for _ in range(random.randint(0, 60))) for _ in range(6000)]:
        assert base_spans(text) == plain(text), text


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "1 " * 150_000, "a@" * 100_000, "+1" * 100_000, "(12) " * 60_000):
        base_spans(text)


def test_reliabilities():
    """Three good labelers, one that says nothing, one against, one at random."""
    random.seed(1)
    counts, truths = {}, {}
    for _ in range(4000):
        true = random.random() < 0.4
        good = [(1 if true else -1) if random.random() < 0.9 else (-1 if true else 1) for _ in range(3)]
        pattern = code(0, [*good, 0, 0, random.choice([-1, 1])])
        counts[pattern] = counts.get(pattern, 0) + 1
        truths.setdefault(pattern, []).append(true)
    found, table = weigh(counts)
    for pattern, own in truths.items():
        if len(own) > 100:
            assert abs(found[pattern] - sum(own) / len(own)) < 0.1
    assert table[1, 0, 2] > 0.85 and abs(table[1, 5, 2] - table[0, 5, 2]) < 0.1
    sure = fit_classifier({(p, 8): n for p, n in counts.items()}, found)
    assert all((sure[p, 8] > 0.5) == (found[p] > 0.5) for p in counts if counts[p] > 100 and abs(found[p] - 0.5) > 0.3)
    assert weigh({})[0] == {} and fit_classifier({}, {}) == {}


def test_codes():
    for kind in range(4):
        assert decode(code(kind, [1, 0, -1, -1, 0, 1])) == (kind, [1, 0, -1, -1, 0, 1])
    assert votes("call 555", (5, 3, 8), False)[3] == 1


def test_table(spark, docs):
    pairs = [(1, "write to bob@example.com or +49 30 1234567, card 4111 1111 1111 1111 from 10.0.0.1"), (2, None), (3, ""), (4, "nothing here at all dot"),
             (None, "bob@example.com"), (1, "bob@example.com"), (5, "x " * 50_000 + "bob@example.com")]
    pairs += [(100 + k, f"contact bob{k}@mail.example.com, phone +49 30 12345{k:02d}") for k in range(60)]
    pairs += [(200 + k, f"email: bob{k} [at] example [dot] com and tel (030) 1234 56{k:02d}") for k in range(30)]
    table = docs(pairs).selectExpr("*", "1 AS id", "2 AS spans", "3 AS votes")
    rows = find_personal_data(table).collect()
    assert len(rows) == len(pairs)
    texts = {}
    for i, t in pairs:
        texts.setdefault(i, []).append(t or "")
    added = 0
    for r in rows:
        base = [(s.start, s.kind, s.end) for s in r.spans if s.strict]
        assert base in [plain(t) for t in texts[r.doc_id]]
        assert [s.start for s in r.spans] == sorted(s.start for s in r.spans)
        added += len(r.spans) - len(base)
    assert added > 0
    assert all(not r.spans for r in rows if r.doc_id in (2, 3, 4))
    assert find_personal_data(docs([])).collect() == []


def test_query(spark, docs, tmp_path):
    """The contract's columns, whatever the order and number of the kinds in a text."""
    random.seed(5)
    parts = ["bob@example.com", "10.0.0.1", "4111 1111 1111 1111", "+49 30 1234567", "256.1.1.1", "4111111111111112", "x@y", "٣.1.1.1", "\U0001f600é\n", "\ufeff\0\t", "bob [at] example [dot] com", "tel (030) 1234 567"]
    texts = [None, "", *parts, " ".join(parts), " ".join(parts[::-1]), "10.0.0.1 10.0.0.2 10.0.0.3", "+49 30 1234567, +49 30 7654321, a@b.c", "a@b.c " * 3000 + "1.2.3.4"]
    texts += [random.choice(["", " ", "\n"]).join(random.choices(parts, k=random.randint(1, 12))) for _ in range(300)]
    texts += ["".join(random.choices("ab1234567890@@..--  +()é\U0001f600", k=random.randint(0, 60))) for _ in range(700)]
    docs(list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op3_personal_data"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        base = plain(texts[r.doc_id] or "")
        named = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)], texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(r.spans.split(",")) | {""}
