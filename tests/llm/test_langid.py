"""Language ID: held-out accuracy, gradients, and edge rows."""

import numpy as np
import pandas as pd

from servertide.llm import langid
from servertide.llm.langid import Compiled, Network, identify, known_language, normal, predict_texts, windows


def test_windows_cover_every_run_of_bytes():
    for n in (0, 1, 3, 255, 256, 257, 509, 2000):
        data = bytes(1 + k % 250 for k in range(n))
        rows = windows(data)
        assert rows.shape[1] == langid.WINDOW
        for w in langid.WIDTHS:
            seen = {bytes(r[k: k + w]) for r in rows for k in range(len(r) - w + 1)}
            assert {data[k: k + w] for k in range(n - w + 1)} <= seen


def test_gradients_are_those_of_the_loss():
    random = np.random.default_rng(1)
    network = Network(["a", "b", "c"])
    for p in network.parameters():
        p += random.normal(0, 0.3, p.shape).astype(np.float32)
    rows, truth = random.integers(97, 103, (5, 24)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    loss = lambda: -np.log(network.predict(rows).astype(float)[np.arange(5), truth]).mean()
    for p, g in zip(network.parameters(), network.gradients(rows, truth)):
        for at in np.argwhere(np.abs(g) > np.abs(g).max() * 0.5)[:3]:
            at = tuple(at)
            keep, step = p[at], 1e-2
            p[at] = keep + step
            up = loss()
            p[at] = keep - step
            down = loss()
            p[at] = keep
            assert abs((up - down) / (2 * step) - g[at]) < 0.05 * abs(g[at]) + 2e-3


def test_tables_equal_the_filters():
    random = np.random.default_rng(2)
    network = Network(["a", "b"])
    rows = random.integers(0, 256, (7, langid.WINDOW)).astype(np.uint8)
    assert np.allclose(Compiled(network, np.arange(256)).predict(rows), network.predict(rows), atol=1e-5)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(found) == docs.count()
    held = found[found.held_out & found.lang.notna()]
    assert (held.lang == held.lang_pred).mean() >= 0.95
    assert found.score.between(0, 1).all()


def test_edge_rows(spark, docs):
    pairs = [(i, "the cat sat on the mat and the dog ran") for i in range(20)] + [(50, None), (51, ""), (52, "123 !?"), (53, "Ж"), (None, "the cat"), (1, "the cat"),
             (54, "the cat " * 20_000)]
    table = docs(pairs).selectExpr("*", "'x' AS lang_pred", "1 AS score", "2 AS found")
    rows = identify(table).collect()
    assert len(rows) == len(pairs)
    known = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert all(known[i] == ("und", 0.0) for i in (50, 51, 52))
    assert known[53][0] == "en" and known[54][0] == "en"
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert {r.doc_id for r in known_language(docs(pairs)).collect()} == {i for i, _ in pairs} - {50, 51, 52}
    assert identify(docs([])).collect() == []
    nothing = docs([(1, "abc")]).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert [tuple(r) for r in identify(nothing).select("lang_pred", "score").collect()] == [("und", 0.0)]


def test_long_texts_equal_their_windows(spark):
    network = Network(["a", "b"])
    model = Compiled(network, np.arange(256))
    text = "abc déf " * 40_000
    rows = windows(normal(text))
    found = predict_texts(model, pd.Series([text, "x", text]))
    assert abs(found.score[0] - model.predict(rows).astype(float).mean(0).max()) < 1e-6 and abs(found.score[0] - found.score[2]) < 1e-9


def test_sample_is_bounded_whole_and_counts_repeated_rows_once(spark, docs, monkeypatch):
    monkeypatch.setattr(langid, "PER_LANGUAGE", 5)
    pairs = [(i, f"text number {i}") for i in range(3000)] + [(9000, "again")] * 1000
    table = docs(pairs).selectExpr("doc_id", "text", "CASE WHEN doc_id % 3 = 0 THEN 'a' WHEN doc_id < 8 THEN 'rare' ELSE 'b' END AS lang")
    sample = langid._sample(table, "doc_id", "text", "lang")
    learnt = [(r.lang, tuple(r.pieces)) for r in sample]
    assert len(set(learnt)) == len(learnt)
    count = {lang: sum(r.lang == lang for r in sample) for lang in ("a", "b", "rare")}
    assert count["a"] == count["b"] == 5 and 1 <= count["rare"] <= 5
    monkeypatch.setattr(langid, "SAMPLE", 4)
    assert len(langid._sample(table, "doc_id", "text", "lang")) == 4


def test_all_windows_of_a_piece_are_learnt(spark, docs, monkeypatch):
    seen = []
    monkeypatch.setattr(Network, "fit", lambda self, rows, truth: seen.append((rows, truth)))
    langid.train(docs([(1, "é" * 1000)]))
    assert len(seen[0][0]) == len(seen[0][1]) == len(windows(("é" * langid.WINDOW).encode())) > 1
