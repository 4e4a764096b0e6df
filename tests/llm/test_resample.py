"""Importance resampling: weights against plain counts, exact top-k, and edge rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from servertide.llm import resample as module
from servertide.llm.resample import BUCKETS, LENGTH, buckets, largest, resample


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_largest(spark):
    random.seed(3)
    values = [random.choice([random.gauss(0, 1), 1.0, 1e300, -5.0]) for _ in range(3000)] + [float(k) for k in range(5)]
    table = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    for k in (1, 2, 700, 1500, 2999, len(values), 10 * len(values)):
        assert largest(table, "x", k) == sorted(values, reverse=True)[min(k, len(values)) - 1]
    assert largest(table, "x", 0) is None and largest(table.limit(0), "x", 3) is None


def test_stretches(monkeypatch):
    text = " ".join(str(k % 97) for k in range(5000))
    whole = sorted(np.concatenate(list(buckets(text))).tolist())
    assert len(whole) == 5000 + 4999
    monkeypatch.setattr(module, "WORDS_AT_A_TIME", 70)
    assert sorted(np.concatenate(list(buckets(text))).tolist()) == whole
    assert list(buckets(None)) == [] and list(buckets(" \n")) == []


def test_weights_and_sample(spark, docs):
    random.seed(4)
    good, bad = ["alpha", "beta", "gamma", "delta"], ["!!", "$$", "buy", "now"]
    pairs = [(i, " ".join(random.choice(good if i % 5 else bad) for _ in range(random.randint(1, 60)))) for i in range(200)]
    pairs += [(300, None), (301, ""), (None, "alpha beta"), (1, pairs[1][1]), (302, "alpha " * 30_000)]
    labelled = [(i, int(i % 5 > 0), 0) for i in range(0, 200, 2)] + [(None, 1, 0), (4, 1, 0), (7, None, None)]
    table = docs(pairs).selectExpr("*", "1 AS good", "2 AS score", "3 AS bucket")
    rows = resample(table, labels(spark, labelled).selectExpr("*", "'x' AS text"), keep=0.8).collect()
    assert len(rows) == len(pairs)
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    wanted = {i for i, q, _ in labelled if q == 1 and i is not None}
    for i, t in pairs:
        for own in buckets(t):
            np.add.at(raw, own, 1)
            if i in wanted:
                np.add.at(target, own, 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    texts = dict(pairs[:200]) | {300: None, 301: "", 302: pairs[-1][1]}
    for r in rows:
        if r.doc_id is not None:
            own = [b for part in buckets(texts[r.doc_id]) for b in part.tolist()]
            assert r.n_grams == len(own) and math.isclose(r.log_weight, LENGTH * ratio[own].mean() if own else 0.0, abs_tol=1e-6)
    chosen = sorted((r.score for r in rows if r.selected), reverse=True)
    k = math.ceil(0.8 * len(rows))
    assert chosen == [s for s in sorted((r.score for r in rows), reverse=True) if s >= chosen[-1]] and k <= len(chosen) <= k + 1
    assert sum(r.selected for r in rows if r.doc_id in range(0, 200, 5)) < 10


def test_noise_is_gumbel(spark, docs):
    rows = resample(docs([(i, "x") for i in range(4000)]), labels(spark, []), keep=0.5).collect()
    noise = np.array([r.score - r.log_weight for r in rows])
    assert abs(noise.mean() - 0.5772) < 0.08 and abs(noise.var() - math.pi**2 / 6) < 0.2
    assert sum(r.selected for r in rows) == 2000


def test_empty_tables(spark, docs):
    assert resample(docs([]), labels(spark, [])).collect() == []
    assert len(resample(docs([]), labels(spark, [(1, 1, 0)])).collect()) == 0
